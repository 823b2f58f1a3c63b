"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Fingerprints that differ in at most r bits agree on one of r + 1 bit blocks, so
tiles are built inside blocks of equal value. In such a group the fingerprints
are laid out by population count; a tile meets only tiles whose counts differ
by r or less, and a meeting is one numpy exclusive-or with a bit count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, materialize, ragged_take, row_chunks, text_bytes, text_slices, word_spans
from .components import components, local_stars

SEED = 42
SHINGLE = 3
RADIUS = 2
TILE = 256


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """Fingerprint of each row: a bit is 1 if over half of the shingle hashes have it."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data).astype(np.uint8)
    starts, ends, first = word_spans(data, offsets)
    lengths = ends - starts
    joined_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(joined_starts[-1]), 0x20, dtype=np.uint8)
    joined[ragged_take(joined_starts[:-1], lengths)] = data[ragged_take(starts, lengths)]
    buffer = joined.tobytes()
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    begin, end = joined_starts[:-1].tolist(), (joined_starts[:-1] + lengths).tolist()
    for row in range(len(out)):
        a, b = int(first[row]), int(first[row + 1])
        if a == b:
            continue
        last = max(b - shingle + 1, a + 1)
        tails = end[a + shingle - 1 : b] if b - a >= shingle else [end[b - 1]]
        hashes = np.array([digest(buffer[s:e], seed) for s, e in zip(begin[a:last], tails)], dtype="<u8")
        n = len(hashes)
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 65536):
            bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) of every document: signed form of the 64-bit fingerprint; the columns in keep follow as _0, _1, ...

    Null and wordless texts have fingerprint 0; fewer words than a shingle make
    one shingle of all words. Rows are kept as they come, repeats included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = text_bytes(batch.column(1))
            parts = [np.zeros(0, np.uint64)]
            for a, b in row_chunks(offsets):
                parts.append(_fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64)), *[batch.column(k) for k in places]], ["doc_id", "fp", *names])

    names = [f"_{k}" for k in range(len(keep))]
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)]
    # the text itself is there already
    others = [(n, c) for n, c in zip(names, keep) if c != "text"]
    places = [1 if c == "text" else 2 + [o for o, _ in others].index(n) for n, c in zip(names, keep)]
    return doc_columns(docs, *[F.col(c).alias(n) for n, c in others]).mapInArrow(run, ", ".join(["doc_id long", "fp long", *kinds]))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that share out the 64 bits."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, stars: bool = False) -> DataFrame:
    """(u, v) of all pairs of distinct fingerprints in (fp, rep) with 1 to radius differing bits.

    u and v are the reps. With stars, each batch of tiles gives the links of its
    nodes to their least node instead, which has the same components and no more
    rows than nodes. Groups beyond a tile are split by both sides, so no
    task holds more than two tiles, whatever the size of a group.
    """
    blocks = _blocks(radius)
    keys = F.array(*[F.struct(F.lit(k).alias("b"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("val")) for k, (at, width) in enumerate(blocks)])
    pop = F.bit_count("fp").cast("int")
    rows = prints.select("fp", "rep", pop.alias("pop"), F.explode(keys).alias("key")).select("fp", "rep", "pop", "key.b", "key.val")
    crowded = rows.groupBy("b", "val").count().where("count > 1").drop("count")
    rows = rows.join(crowded, ["b", "val"])
    # q is the population count of a meeting's left tile; its right tile has q to q + radius
    meet = rows.withColumn("q", F.explode(F.sequence(F.col("pop") - radius, F.col("pop"))))
    sizes = meet.groupBy("b", "val", "q").agg(F.count_if(F.col("pop") == F.col("q")).alias("nl"), F.count(F.lit(1)).alias("nr"))
    sizes = sizes.where("nl > 0 and nr > 1").select("b", "val", "q", F.ceil(F.col("nl") / tile).cast("int").alias("tl"), F.ceil(F.col("nr") / tile).cast("int").alias("tr"))
    meet = meet.join(sizes, ["b", "val", "q"])
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = meet.where("pop = q").select("b", "val", "q", own("tl").alias("sl"), F.explode(every("tr")).alias("sr"), F.lit(True).alias("is_left"), "fp", "rep")
    right = meet.select("b", "val", "q", F.explode(every("tl")).alias("sl"), own("tr").alias("sr"), F.lit(False).alias("is_left"), "fp", "rep")
    tiles = left.unionByName(right).groupBy("b", "val", "q", "sl", "sr").agg(
        F.collect_list(F.when(F.col("is_left"), F.struct("fp", "rep"))).alias("l"), F.collect_list(F.when(~F.col("is_left"), F.struct("fp", "rep"))).alias("r")
    )
    masks = [np.uint64(((1 << width) - 1) << at) for at, width in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            sides = []
            for k in (1, 2):
                lists = batch.column(k)
                flat = lists.flatten()
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                sides.append((at, flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()))
            (la, lf, lr), (ra, rf, rr) = sides
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                x, y = lf[la[i] : la[i + 1]], rf[ra[i] : ra[i + 1]]
                if not len(x) or not len(y):
                    continue
                step = max(1, (1 << 21) // len(y))
                for at in range(0, len(x), step):
                    differ = x[at : at + step, None] ^ y[None, :]
                    p, q = np.nonzero((differ != 0) & (np.bitwise_count(differ) <= radius))
                    d = differ[p, q]
                    p = p + at
                    # equal counts meet twice in a tile pair; an earlier block shared reports the pair already
                    keep = (np.bitwise_count(x[p]) != np.bitwise_count(y[q])) | (x[p] < y[q])
                    for k in range(int(block[i])):
                        keep &= (d & masks[k]) != 0
                    us.append(lr[la[i] : la[i + 1]][p[keep]])
                    vs.append(rr[ra[i] : ra[i + 1]][q[keep]])
            u, v = np.concatenate(us), np.concatenate(vs)
            if stars:
                u, v = local_stars(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return tiles.select("b", "l", "r").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; the columns in keep follow as _0, _1, ...

    Documents with equal fingerprints are one class; classes at radius or fewer
    differing bits are linked, and component_id is the smallest doc_id that links
    reach. A null doc_id forms a class but is never a component_id unless alone.
    """
    prints = materialize(fingerprints(docs, shingle, seed, keep))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(classes.where("rep is not null"), radius, stars=True))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *[f"_{k}" for k in range(len(keep))])

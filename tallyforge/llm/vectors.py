"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Cells only spare work. Cells are packed into tiles of about TILE vectors, and a
vector meets a tile when one of its cells could hold a partner: when the angle
to that cell's centre is at most the cell's radius plus the angle of the
threshold. So no link is lost, and a vector is copied once for each tile in
reach, at most as often as its label has tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components, local_stars

#: TILE vectors are compared with as many at once; BLOCK vectors look for their cells at once.
THRESHOLD, ROUNDS, TILE, BLOCK = 0.93, 2, 8192, 2048
#: The centres of a label are fitted on about this many vectors for each of its cells, which are as many as the root of its size.
SAMPLE_PER_CELL = 64
KEYS = ["label", "dim"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(n, -1) if n else x.reshape(0, 1)
    # the largest component first, so that squares neither vanish nor overflow
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sized(rows: DataFrame, block: int, cells: int | None) -> DataFrame:
    """rows with its label's number of cells, of every how many vectors one is in the sample, and the vector's block.

    Every block meets all cells of its label; it is no smaller than their number, so the cells' copies stay in proportion.
    """
    sizes = rows.groupBy(F.col("label").alias("l"), F.col("dim").alias("d")).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("cells", F.lit(cells) if cells else F.ceil(F.sqrt("size")).cast("int"))
    sizes = sizes.select("l", "d", "cells", F.ceil(F.col("size") / F.greatest(F.lit(block), "cells")).cast("int").alias("blocks"), F.ceil(F.col("size") / (F.col("cells") * SAMPLE_PER_CELL)).cast("int").alias("every"))
    joined = rows.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).drop("l", "d")
    return joined.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int"))


def _unit(column: str) -> Column:
    return F.transform(column, lambda x: x / F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, y: a + y * y)))


def _seeds(sample: DataFrame) -> DataFrame:
    """A vector of the sample for each cell."""
    slot = F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")
    first = sample.groupBy(*KEYS, slot.alias("cell")).agg(F.min_by("vec", F.xxhash64("rep", F.lit(1))).cast("array<double>").alias("v"))
    most = F.array_max(F.transform("v", F.abs))
    return first.withColumn("v", F.transform("v", lambda x: x / most)).select(*KEYS, "cell", _unit("v").alias("centre"))


def _met(rows: DataFrame, cells: DataFrame, work, schema: str) -> DataFrame:
    """work(vectors of a block, cells of their label) for every block."""
    blocks = rows.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("block").alias("their_block")).distinct()
    spread = blocks.join(cells, (F.col("l") == F.col("label")) & (F.col("d") == F.col("dim"))).drop("l", "d")
    return rows.groupBy(*KEYS, "block").cogroup(spread.groupBy(*KEYS, "their_block")).applyInArrow(work, schema)


def _centres(cells: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells.column("cell").to_numpy())
    centre = cells.column("centre").combine_chunks()
    return order, centre.flatten().to_numpy(zero_copy_only=False).reshape(len(centre), -1)[order]


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _moved(sample: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres moved to their cells' mean directions; each block sends partial sums. A centre without one stays."""

    def sums(vectors: pa.Table, cells: pa.Table) -> pa.Table:
        if not len(vectors) or not len(cells):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        order, c = _centres(cells)
        x = _matrix(vectors.column("vec"))
        best = (x @ c.T).argmax(axis=1)
        found, back = np.unique(best, return_inverse=True)
        total = np.zeros((len(found), x.shape[1]))
        np.add.at(total, back, x)
        ids = cells.column("cell").to_numpy()[order][found]
        label, dim = (vectors.column(k)[0].as_py() for k in KEYS)
        return pa.Table.from_arrays([pa.array([label] * len(found), kinds[0]), pa.array([dim] * len(found), kinds[1]), pa.array(ids, kinds[2]), pa.array(list(total), kinds[3])], names)

    kinds, names = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())], [*KEYS, "cell", "part"]
    parts = _met(sample, centres, sums, "label long, dim int, cell int, part array<double>")
    each = parts.select(*KEYS, "cell", F.posexplode("part")).groupBy(*KEYS, "cell", "pos").agg(F.sum("col").alias("s"))
    whole = each.groupBy(*KEYS, "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("v"))
    new = whole.where(F.exists("v", lambda x: x != 0)).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("c"), _unit("v").alias("new"))
    both = centres.join(new, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")), "left")
    return both.select(*KEYS, "cell", F.coalesce("new", "centre").alias("centre"))


def _tiled(rows: DataFrame, centres: DataFrame, tile: int) -> DataFrame:
    """centres with radius, and tile and slots: neighbouring small cells share a tile, a large cell has slots tiles of its own."""

    def far(vectors: pa.Table, cells: pa.Table) -> pa.Table:
        if not len(vectors) or not len(cells):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        order, c = _centres(cells)
        x = _matrix(vectors.column("vec"))
        angles = _angles(x, c)
        best = angles.argmin(axis=1)
        found, back = np.unique(best, return_inverse=True)
        most = np.zeros(len(found))
        np.maximum.at(most, back, angles[np.arange(len(x)), best])
        label, dim = (vectors.column(k)[0].as_py() for k in KEYS)
        columns = [[label] * len(found), [dim] * len(found), cells.column("cell").to_numpy()[order][found], most, np.bincount(back)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    kinds, names = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()], ["l", "d", "c", "far", "held"]
    found = _met(rows, centres, far, "l long, d int, c int, far double, held long").groupBy("l", "d", "c").agg(F.max("far").alias("radius"), F.sum("held").alias("held"))
    own = centres.join(found, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")))
    slots = F.ceil(F.col("held") / tile).cast("int")
    before = Window.partitionBy(*KEYS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    small = F.coalesce(F.sum(F.when(slots == 1, F.col("held"))).over(before), F.lit(0))
    large = F.coalesce(F.sum(F.when(slots > 1, slots)).over(before), F.lit(0))
    # tiles of small cells are even, those of large cells odd
    return own.select(*KEYS, "cell", "centre", "radius", slots.alias("slots"), F.when(slots == 1, 2 * F.floor(small / tile)).otherwise(2 * large + 1).cast("long").alias("tile"))


def _placed(rows: DataFrame, cells: DataFrame, reach: float, kind: str) -> DataFrame:
    """(label, dim, a, b, is_a, rep, n, vec): a vector once for each pair of tiles (a, b), its own and one in reach; a <= b."""
    element = pa.float64() if kind == "array<double>" else pa.float32()
    names = [*KEYS, "a", "b", "is_a", "rep", "n", "vec"]

    def run(vectors: pa.Table, near: pa.Table) -> pa.Table:
        if not len(vectors) or not len(near):
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(element)]
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        order, c = _centres(near)
        radius, slots, tile = (near.column(k).to_numpy()[order] for k in ("radius", "slots", "tile"))
        # a column for each tile of each cell, by tile; tiles of one cell are two apart
        column = np.repeat(np.arange(len(slots)), slots)
        number = tile[column] + 2 * (np.arange(len(column)) - np.repeat(np.cumsum(slots) - slots, slots))
        by = np.argsort(number, kind="stable")
        column, number = column[by], number[by]
        first = np.flatnonzero(np.concatenate([[True], np.diff(number) != 0]))
        rep = vectors.column("rep").to_numpy()
        x = _matrix(vectors.column("vec"))
        takes, others, homes = [], [], []
        step = max(1, (1 << 22) // max(len(column), 1))
        for at in range(0, len(x), step):
            angles = _angles(x[at : at + step], c)
            # the nearest cell whose radius covers the vector: products may round in another way than those of the radii
            best = np.where(angles <= radius + 1e-9, angles, 9.0).argmin(axis=1)
            slot = (rep[at : at + step].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slots[best]
            home = tile[best] + 2 * slot
            meets = np.logical_or.reduceat((angles <= radius + reach)[:, column], first, axis=1)
            p, q = np.nonzero(meets | (number[first][None, :] == home[:, None]))
            takes.append(at + p)
            others.append(number[first][q])
            homes.append(home[p])
        take, other, home = (np.concatenate(v) for v in (takes, others, homes))
        index = pa.array(take)
        more = [pa.array(np.minimum(home, other)), pa.array(np.maximum(home, other)), pa.array(home <= other)]
        return pa.Table.from_arrays([*(vectors.column(k).take(index) for k in KEYS), *more, *(vectors.column(k).take(index) for k in ("rep", "n", "vec"))], names)

    return _met(rows, cells, run, f"label long, dim int, a long, b long, is_a boolean, rep long, n long, vec {kind}")


def vector_links(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, rounds: int = ROUNDS, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """(u, m, v) for distinct vectors (label, dim, rep, n, vec) linked inside their label at the threshold or above.

    A pair of tiles gives one row a vector u: m, the rows that it links there, and
    v, the least vector of its component there (null for that one itself). Summed
    over all pairs of tiles m is a vector's number of links, and the pairs (u, v)
    have the links' components, without a row for each pair.
    """
    kind = rows.schema["vec"].dataType.simpleString()
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    rows = _sized(rows, block, cells)
    sample = rows.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.col("every")) == 0)
    centres = materialize(_seeds(sample))
    for _ in range(rounds):
        centres = materialize(_moved(sample, centres))
    packed = materialize(_tiled(rows, centres, tile))

    def run(pair: pa.Table) -> pa.Table:
        is_a = pair.column("is_a").to_numpy()
        same = pair.column("a")[0] == pair.column("b")[0]
        left = np.flatnonzero(is_a)
        right = left if same else np.flatnonzero(~is_a)
        x = _matrix(pair.column("vec"))
        rep, n = pair.column("rep").to_numpy(), pair.column("n").to_numpy()
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, (1 << 21) // max(len(right), 1))
        y = x[right].T
        for at in range(0, len(left), step):
            p, q = np.nonzero(x[left[at : at + step]] @ y >= threshold)
            p, q = left[p + at], right[q]
            keep = rep[p] < rep[q] if same else np.ones(len(p), dtype=bool)
            us.append(p[keep])
            vs.append(q[keep])
        p, q = np.concatenate(us), np.concatenate(vs)
        ids, back = np.unique(np.concatenate([rep[p], rep[q]]), return_inverse=True)
        linked = np.bincount(back, weights=np.concatenate([n[q], n[p]]), minlength=len(ids)).astype(np.int64)
        to = np.full(len(ids), -1, dtype=np.int64)
        if len(p):
            node, root = local_stars(rep[p], rep[q])
            to[np.searchsorted(ids, node)] = np.searchsorted(ids, root)
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(linked), pa.array(ids[to] if len(ids) else ids, pa.int64(), mask=to < 0)], ["u", "m", "v"])

    return _placed(rows, packed, reach, kind).groupBy(*KEYS, "a", "b").applyInArrow(run, "u long, m long, v long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cells: int | None = None, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Components are compared in the precision they come in (float or double), the
    products are made in double. Equal vectors of a label are one class with a
    count, so a hot vector is one row in the products. Rows whose label, id or
    vector is null, whose vector is empty or zero or holds null or non-finite
    components link with nothing; so do vectors of different lengths. Without
    links: n_links 0, own component.
    """
    given = vectors.schema["embedding"].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"), F.col("label").cast("long").alias("label"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0), F.lit(False))
    own = own.withColumn("sound", sound).withColumn("dim", F.size("vec"))
    classes = materialize(own.where("sound").groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("label", "dim", "rep", "n", "vec"))
    links = materialize(vector_links(classes, threshold, tile, block=block, cells=cells))
    degree = links.groupBy(F.col("u").alias("k")).agg(F.sum("m").alias("m"))
    found = components(links.where("v IS NOT NULL").select("u", "v"))
    known = classes.join(degree, F.col("rep") == F.col("k"), "left").join(found, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("cl"), F.col("vec").alias("cv"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    keyed = own.withColumn("kl", F.when(F.col("sound"), F.col("label"))).withColumn("kv", F.when(F.col("sound"), F.col("vec")))
    out = keyed.join(known, (F.col("kl") == F.col("cl")) & (F.col("kv") == F.col("cv")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

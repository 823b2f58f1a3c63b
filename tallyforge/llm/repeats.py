"""Windows of a text that also occur elsewhere, for any corpus size.

Every window of `length` units has one anchor: the last of its least `gram`-unit
names. Neighbouring windows with one anchor are a run, and the text of a run is
its segment. Equal windows have equal anchors, so only segments of one anchor
need to meet. Names (64 bits) only choose where segments meet and so may
collide; what is equal is decided on the texts themselves.

1. Each batch tells which anchors it has seen, in one row an anchor. Anchors
   that occur once in the corpus drop out.
2. The segments of the others go to their anchor's task as text, one copy of
   each a batch; owners of further copies are settled in the batch. Anchors of
   more than HOT runs send each window under a key of its own instead, so that
   no key gathers more than HOT segments that differ.
3. A task decides the windows of a block of segments: the shape's function does
   that, by a difference cover (bytes) or by relative factors (words).
4. The stretches that go come back to their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import factors, suffixes
from .common import give_back, materialize, ragged_take, row_chunks, text_bytes, text_slices, word_spans

#: Runs of an anchor beyond which its windows are dealt out one by one.
HOT = 2048
#: Bytes of segments that one block gathers before it is decided.
BLOCK_BYTES = 1 << 19
#: Bytes of text that a task cuts into runs at once; within them a segment's copies are sent once.
SLICE = 16 << 20
#: Least value that the id of a document without doc_id gets; such documents come before all others.
NO_ID = -(1 << 63)
_SINGLE, _HEAD, _PARKED, _HOT = 0, 1, 2, 3

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S32, _S29 = np.uint64(32), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of x in place."""
    spare = x >> _S32
    x ^= spare
    x *= _A
    np.right_shift(x, _S29, out=spare)
    x ^= spare
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name of the pair of names (a, b)."""
    x = a * _B
    x += b
    return _mix(x)


def _byte_values() -> np.ndarray:
    return joined(np.arange(1, 257, dtype=np.uint64), np.full(256, _C))


_BYTE = _byte_values()


def names_of(unit: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, a name of every stretch of so many units, by doubling.

    Bytes start from stretches of eight, which are read as one number.
    """
    out: dict[int, np.ndarray] = {}
    name, size = unit, 1
    if unit.dtype == np.uint8:
        whole = np.ascontiguousarray(unit)
        eights = np.lib.stride_tricks.as_strided(whole.view(np.uint8), (max(len(unit) - 7, 0), 8), (1, 1))
        name, size = _mix(np.ascontiguousarray(eights).view("<u8").reshape(-1).astype(np.uint64)), 8
    while True:
        for want in sizes:
            if want == size:
                out[want] = name
            elif size < want < 2 * size:
                shift = want - size
                out[want] = joined(name[: len(name) - shift], name[shift:]) if len(name) > shift else name[:0]
        if 2 * size > max(sizes):
            return [out[s] for s in sizes]
        name = joined(name[:-size], name[size:]) if len(name) > size else name[:0]
        size *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of width values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    shift = width - size
    return np.minimum(x[: len(x) - shift], x[shift:]) if shift and len(x) > shift else x if not shift else x[:0]


@dataclass
class Units:
    """The units of a chunk of rows: names, first unit of each row, and each unit's bytes in text.

    For words, text has one space after each word, so that segments don't differ
    by white space alone; a byte is where it is, without starts and ends.
    """

    name: np.ndarray
    offsets: np.ndarray
    text: bytes
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def stretch(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of text from each first unit to the unit before last."""
        return (first, last) if self.starts is None else (self.starts[first], self.ends[last - 1])


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(data, offsets, data.tobytes())


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Names are polynomials over the words' bytes, mixed with their lengths."""
    starts, ends, first = word_spans(data, offsets)
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    n = len(data) + 1
    one = np.ones(1, dtype=np.uint64)
    up = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, base, dtype=np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, inverse, dtype=np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
    size = ends - starts
    name = joined(_mix((sums[ends] - sums[starts]) * down[starts]), size.astype(np.uint64))
    text = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    after = np.cumsum(size + 1)
    inside = np.ones(len(text), dtype=bool)
    inside[after - 1] = False
    text[inside] = data[ragged_take(starts, size)]
    return Units(name, first, text.tobytes(), after - size - 1, after - 1)


@dataclass(frozen=True)
class Shape:
    """What a window is, how texts become units, and how a block of segments is decided.

    decide(bodies, length, rank, place) gives for each window of each body
    whether it goes; rank orders the bodies' documents, place is the unit a body
    starts at.
    """

    length: int
    gram: int
    units: Callable
    as_bytes: bool
    decide: Callable

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


BYTES = Shape(100, 27, byte_units, True, suffixes.later_windows)
WORDS = Shape(35, 18, word_units, False, factors.repeated_windows)


@dataclass
class Runs:
    """The runs of a chunk: row, first unit, number of windows and anchor name."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


def runs_of(shape: Shape, unit: np.ndarray, offsets: np.ndarray) -> Runs:
    (gram,) = names_of(unit, shape.gram)
    least = _least(gram, shape.width)
    per_row = np.maximum(np.diff(offsets) - shape.length + 1, 0)
    at = ragged_take(offsets[:-1], per_row)
    row = np.repeat(np.arange(len(per_row)), per_row)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint64))
    anchor = least[at]
    fresh = np.ones(len(at), dtype=bool)
    # a run ends with its row, when its least name changes, or when an equal one comes in
    fresh[1:] = (np.diff(row) != 0) | (anchor[1:] != anchor[:-1]) | (gram[at[1:] + shape.width - 1] == anchor[:-1])
    first = np.flatnonzero(fresh)
    return Runs(row[first], at[first], np.diff(np.concatenate([first, [len(at)]])), anchor[first])


def _chunks(shape: Shape, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Units]]:
    """(first row, last row, bytes, byte offsets, units) of a text column's chunks."""
    data, offsets = text_bytes(column)
    for a, b in row_chunks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, part, own, shape.units(part, own)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return fresh


def _seen(docs: DataFrame, shape: Shape) -> DataFrame:
    """(a, d, n, kind) of (d, text): an anchor that a batch holds once is a row with its document's number d.

    One it holds more often is a row of kind _HEAD with the number of its runs,
    and rows of kind _PARKED for its documents, which need not meet the head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            ids = batch.column(0).to_numpy()
            parts = []
            for a, _, _, _, units in _chunks(shape, batch.column(1)):
                runs = runs_of(shape, units.name, units.offsets)
                parts.append((runs.anchor, ids[a + runs.row]))
            if not parts:
                continue
            anchor, d = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((d, anchor))
            anchor, d = anchor[order], d[order]
            first = np.flatnonzero(_heads(anchor))
            n = np.diff(np.concatenate([first, [len(anchor)]]))
            many = np.repeat(n > 1, n)
            kind = np.where(many, _PARKED, _SINGLE).astype(np.int8)
            new = _heads(anchor, d)
            first, n = first[n > 1], n[n > 1]
            columns = [np.concatenate(x) for x in ((anchor[new], anchor[first]), (d[new], np.zeros(len(first), np.int64)), (np.ones(int(new.sum()), np.int64), n), (kind[new], np.full(len(first), _HEAD, np.int8)))]
            yield pa.RecordBatch.from_arrays([_signed(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3])], ["a", "d", "n", "kind"])
            parts, columns = [], []

    return docs.mapInArrow(run, "a long, d long, n int, kind tinyint")


def _shared(docs: DataFrame, shape: Shape, hot: int) -> DataFrame:
    """(d, a, hot): the anchors of a document that occur more than once; with hot, a row of an anchor beyond the limit.

    Reads each anchor's rows as a stream and holds one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first row of the last anchor, if it is not yet known to have others
        wait: list[tuple[int, int]] = []
        last, total = None, 0

        def out(d: np.ndarray, a: np.ndarray, is_hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(np.full(len(d), is_hot))], ["d", "a", "hot"])

        for batch in batches:
            a, d, n, kind = (batch.column(k).to_numpy() for k in range(4))
            parked = kind == _PARKED
            if parked.any():
                yield out(d[parked], a[parked], False)
                a, d, n, kind = (x[~parked] for x in (a, d, n, kind))
            if not len(a):
                continue
            fresh = _heads(a)
            fresh[0] = a[0] != last
            if wait and not fresh[0]:
                yield out([wait[0][0]], [wait[0][1]], False)
            if fresh[0] and total > hot:
                yield out([0], [last], True)
            wait = []
            more = np.zeros(len(a), dtype=bool)
            more[:-1] = ~fresh[1:]
            is_head = kind == _HEAD
            given = (~fresh | more) & ~is_head
            yield out(d[given], a[given], False)
            if fresh[-1] and not is_head[-1]:
                wait = [(int(d[-1]), int(a[-1]))]
            first = np.flatnonzero(_heads(a))
            sums = np.add.reduceat(n.astype(np.int64), first)
            if not fresh[0]:
                sums[0] += total
            many = sums[:-1] > hot
            yield out(np.zeros(int(many.sum()), np.int64), a[first[:-1][many]], True)
            last, total = int(a[-1]), int(sums[-1])
        if total > hot:
            yield out([0], [last], True)

    spread = F.when(F.col("kind") == _PARKED, F.xxhash64("a", "d")).otherwise(F.col("a"))
    return _seen(docs, shape).repartition(spread).sortWithinPartitions("a").mapInArrow(run, "d long, a long, hot boolean")


def _segments(asked: DataFrame, shape: Shape) -> DataFrame:
    """(g, body, d, q, s, n, many) of (d, q, text, anchors): a segment's text under its key, once a batch.

    d, q and s are its first owner in the batch and the unit where it starts
    there, n its windows; many tells of other owners, which follow as rows
    without a body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_column, SLICE):
            ids, qs, texts, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("d", "q", "text", "anchors"))
            ids, qs = ids.to_numpy(), qs.to_numpy()
            sizes = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = lists.flatten()
            names = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            is_hot = flat.field(1).to_numpy(zero_copy_only=False)
            parts: list[tuple] = []
            bodies: list[bytes] = []
            for a, b, _, _, units in _chunks(shape, texts):
                runs = runs_of(shape, units.name, units.offsets)
                span = slice(sizes[a], sizes[b])
                owner = np.repeat(np.arange(b - a), np.diff(sizes[a : b + 1])).astype(np.uint64)
                wanted = joined(names[span], owner)
                if not len(wanted) or not len(runs.row):
                    continue
                order = np.argsort(wanted)
                key = joined(runs.anchor, runs.row.astype(np.uint64))
                at = np.minimum(np.searchsorted(wanted[order], key), len(wanted) - 1)
                hit = wanted[order][at] == key
                hot = hit & is_hot[span][order][at]
                whole = np.flatnonzero(hit & ~hot)
                row, first, count, group = runs.row[whole], runs.start[whole], runs.count[whole], runs.anchor[whole]
                single = np.flatnonzero(hot)
                if len(single):
                    half = 1 << (shape.length.bit_length() - 1)
                    (part,) = names_of(units.name, half)
                    n = runs.count[single]
                    window = ragged_take(runs.start[single], n)
                    own = joined(joined(part[window], part[window + shape.length - half]), np.repeat(runs.anchor[single], n))
                    row, first, count, group = (np.concatenate(x) for x in ((row, np.repeat(runs.row[single], n)), (first, window), (count, np.ones(len(window), np.int64)), (group, own)))
                text = units.text
                lo, hi = units.stretch(first, first + count + shape.length - 1)
                bodies += [text[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
                parts.append((group, ids[a + row], qs[a + row], first - units.offsets[row], count))
            if not parts:
                continue
            g, d, q, s, n = (np.concatenate(x) for x in zip(*parts))
            coded = pa.array(bodies, pa.large_binary()).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.lexsort((s, q, d, code))
            first = _heads(code[order])
            differ = _heads(d[order], q[order], s[order]) | first
            order, first = order[differ], first[differ]
            heads = np.flatnonzero(first)
            many = np.zeros(len(order), dtype=bool)
            many[heads] = np.diff(np.concatenate([heads, [len(order)]])) > 1
            g = np.where(first, g[order], joined(g[order], d[order].view(np.uint64) + s[order].astype(np.uint64)))
            body = coded.dictionary.take(pa.array(np.where(first, code[order], 0), mask=~first)).cast(pa.binary())
            bodies, coded, parts = [], None, []
            yield pa.RecordBatch.from_arrays([_signed(g), body, pa.array(d[order]), pa.array(q[order]), pa.array(s[order]), pa.array(n[order].astype(np.int32)), pa.array(many)], ["g", "body", "d", "q", "s", "n", "many"])
            del body

    text_column = asked.columns.index("text")
    return asked.mapInArrow(run, "g long, body binary, d long, q long, s long, n int, many boolean")


def _spans(flags: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, stop) of the runs of true values, within stretches of flags that end at ends."""
    begin = np.concatenate([[0], ends])[:-1]
    padded = np.zeros(len(flags) + len(ends) + 1, dtype=np.int8)
    padded[np.arange(len(flags)) + np.repeat(np.arange(len(ends)), ends - begin) + 1] = flags
    edge = np.flatnonzero(np.diff(padded))
    start, stop = edge[::2], edge[1::2]
    base = begin + np.arange(len(ends))
    owner = np.searchsorted(base, start, side="right") - 1
    return owner, start - base[owner], stop - base[owner]


def _gone(d: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(q), pa.array(lo), pa.array(hi)], ["d", "q", "lo", "hi"])


def _decided(segments: DataFrame, shape: Shape, first_stays: bool) -> DataFrame:
    """(d, q, lo, hi) of rows sorted by g: windows lo to hi of a document go.

    Holds the distinct segments of the keys of one block; a key ends before its block does.
    """

    def distinct(rows: pa.Table) -> tuple[pa.Table, pa.RecordBatch | None]:
        """One row of each segment, that of its first owner, and what other owners lose."""
        code = pa.concat_arrays(rows.column("body").chunks).dictionary_encode().indices.to_numpy()
        g, d, q, s = (rows.column(c).to_numpy() for c in "gdqs")
        order = np.lexsort((s, q, d, code, g))
        first = _heads(g[order], code[order])
        other = ~first & _heads(d[order], q[order], s[order])
        if first.all():
            return rows, None
        heads = np.flatnonzero(first)
        many = np.logical_or.reduceat(rows.column("many").to_numpy()[order] | other, heads)
        kept = rows.take(pa.array(order[heads])).set_column(6, "many", pa.array(many))
        lost = order[other]
        return kept, _gone(d[lost], q[lost], s[lost], s[lost] + rows.column("n").to_numpy()[lost])

    def decide(rows: pa.Table) -> pa.RecordBatch:
        g, d, q, s, n = (rows.column(c).to_numpy() for c in "gdqsn")
        # segments alone under their key repeat as a whole or not at all
        order = np.argsort(g, kind="stable")
        first = np.flatnonzero(_heads(g[order]))
        size = np.diff(np.concatenate([first, [len(g)]]))
        differ = order[np.repeat(size > 1, size)]
        whole = np.zeros(len(g), dtype=bool) if first_stays else rows.column("many").to_numpy().copy()
        parts = [np.flatnonzero(whole)] * 3
        parts = [parts[0], np.zeros(len(parts[0]), np.int64), n[parts[0]].astype(np.int64)]
        asked = differ[~whole[differ]]
        if len(asked):
            # rank orders documents, so that "earlier" is a comparison of numbers
            by = np.lexsort((q[differ], d[differ]))
            rank = np.empty(len(differ), dtype=np.int64)
            rank[by] = np.cumsum(_heads(d[differ][by], q[differ][by]))
            bodies = pa.concat_arrays(rows.column("body").take(pa.array(differ)).chunks)
            flags = shape.decide(bodies, shape.length, rank, s[differ])
            owner, lo, hi = _spans(flags, np.cumsum(n[differ].astype(np.int64)))
            stay = ~whole[differ[owner]]
            parts = [np.concatenate(x) for x in zip(parts, (differ[owner[stay]], lo[stay], hi[stay]))]
        who, lo, hi = parts
        return _gone(d[who], q[who], s[who] + lo, s[who] + hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            settled = rows.filter(rows.column("body").is_null())
            if len(settled):
                d, q, s, n = (settled.column(c).to_numpy() for c in "dqsn")
                yield _gone(d, q, s, s + n)
                rows = rows.filter(rows.column("body").is_valid())
            rows = rows if held is None else pa.concat_tables([held, rows])
            while len(rows):
                # up to the key where a block is full
                size = np.cumsum(pa.compute.binary_length(rows.column("body")).to_numpy().astype(np.int64))
                g = rows.column("g").to_numpy()
                cut = int(np.searchsorted(size, BLOCK_BYTES))
                if cut >= len(g) or g[cut] == g[-1]:
                    break
                cut = int(np.flatnonzero(g[cut:] != g[cut])[0]) + cut
                part, lost = distinct(rows.slice(0, cut))
                if lost is not None:
                    yield lost
                yield decide(part)
                rows = rows.slice(cut)
            held = rows.combine_chunks()
            give_back()
            if len(held) and held.nbytes > 2 * BLOCK_BYTES:
                held, lost = distinct(held)
                if lost is not None:
                    yield lost
        if held is not None and len(held):
            part, lost = distinct(held)
            if lost is not None:
                yield lost
            yield decide(part)

    return segments.mapInArrow(run, "d long, q long, lo long, hi long")


def with_removals(docs: DataFrame, shape: Shape, first_stays: bool, hot: int = HOT) -> DataFrame:
    """docs (d, q, text, ...) with marks: the windows of each document that occur elsewhere.

    q is a number of the document (d and its text), by which its rows meet what
    is known of it; d tells documents apart whose numbers are equal. marks is an
    array of (d, lo, hi), null where there are none. first_stays: only windows
    that start earlier (in the order d, q, place) count as elsewhere, else all
    others do.
    """
    shared = materialize(_shared(docs.select(F.col("q").alias("d"), "text"), shape, hot))
    beyond = materialize(shared.where("hot").select(F.col("a").alias("_a")).distinct())
    # a few rows (one for each `hot` runs at most), joined as Spark's own size check says
    anchors = shared.where("not hot").join(beyond, F.col("a") == F.col("_a"), "left").groupBy(F.col("d").alias("k")).agg(F.collect_list(F.struct("a", F.col("_a").isNotNull().alias("hot"))).alias("anchors"))
    # all columns come along, so that this shuffle of the documents is the last join's as well
    asked = docs.join(anchors, F.col("q") == F.col("k")).drop("k")
    gone = _decided(_segments(asked, shape).repartition("g").sortWithinPartitions("g"), shape, first_stays)
    marks = gone.groupBy(F.col("q").alias("k")).agg(F.collect_list(F.struct("d", "lo", "hi")).alias("marks"))
    return docs.join(marks, F.col("q") == F.col("k"), "left").drop("k")


def covered(shape: Shape, offsets: np.ndarray, marks: pa.Array, ids: np.ndarray) -> np.ndarray:
    """For each unit of a chunk's rows, whether a window that goes covers it."""
    lengths = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    d, lo, hi = (marks.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
    row = np.repeat(np.arange(len(lengths)), lengths)
    own = d == ids[row]
    row, lo, hi = row[own], lo[own], hi[own]
    total = int(offsets[-1]) + 1
    opens = np.bincount(offsets[row] + lo, minlength=total)
    ends = np.bincount(offsets[row] + hi - 1 + shape.length, minlength=total)
    return np.cumsum(opens - ends)[:-1] > 0


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """d (never null), q (a hash of d and the text), doc_id and text of documents; the columns in keep follow as _0, _1, ...

    Documents without an id get ids by their texts, before the ids above -(1 << 62).
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = F.coalesce(doc_id, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))
    return docs.select(d.alias("d"), F.xxhash64(d, text).alias("q"), text.alias("text"), doc_id.alias("doc_id"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])


def removals(docs: DataFrame, shape: Shape, first_stays: bool, hot: int = HOT, text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document of what goes and what is left, by repeated windows.

    Columns: doc_id, the columns in keep, n_units (bytes or words), n_removed, n_spans, kept_sha256,
    and with text also kept: the remaining text. Kept bytes are concatenated,
    kept words joined by one space. In kept, a character goes only with all of
    its bytes, so that it stays valid UTF-8. Null, empty and short texts lose
    nothing. A document is a doc_id with a text: rows that repeat both are one
    document and give equal rows, different texts under one doc_id are different
    documents (ordered by a hash of the text). Documents without an id come first.
    """
    import hashlib

    held = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    kind = ", ".join(["doc_id long", *held, "n_units long, n_removed long, n_spans long, kept_sha256 string"]) + (", kept string" if text else "")
    names = ["doc_id", *keep, "n_units", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0, SLICE):
            ids, marks, ds = batch.column(1), batch.column(2), batch.column(3).to_numpy()
            for a, b, data, offsets, units in _chunks(shape, batch.column(0)):
                ends = units.offsets
                gone = covered(shape, ends, marks.slice(a, b - a), ds[a:b])
                total = np.concatenate([[0], np.cumsum(gone)])[ends]
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = ends[(ends > 0) & (ends < len(gone))]
                opens[inner] = gone[inner]
                spans = np.concatenate([[0], np.cumsum(opens)])[ends]
                out = np.frombuffer(units.text, np.uint8)
                if shape.as_bytes:
                    after, stay, bounds = 0, ~gone, ends
                else:
                    # a word stays with the space after it, and the last space of a row goes
                    after, stay = 1, np.repeat(~gone, units.ends - units.starts + 1)
                    bounds = np.concatenate([units.starts, [len(units.text)]])[ends]
                digests, kept = [], []
                for row in range(b - a):
                    x, y = bounds[row], bounds[row + 1]
                    left = (units.text[x:y] if total[row] == total[row + 1] else out[x:y][stay[x:y]].tobytes())
                    left = left[: len(left) - after] if left else left
                    digests.append(hashlib.sha256(left).hexdigest())
                    if text:
                        kept.append(_whole_characters(data[offsets[row] : offsets[row + 1]], gone[x:y]) if shape.as_bytes else left.decode())
                columns = [ids.slice(a, b - a), *(c.slice(a, b - a) for c in batch.columns[4:]), pa.array(np.diff(ends)), pa.array(np.diff(total)), pa.array(np.diff(spans)), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if text else []), names)

    return with_removals(keyed(docs, keep), shape, first_stays, hot).select("text", "doc_id", "marks", "d", *[f"_{k}" for k in range(len(keep))]).mapInArrow(run, kind)


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters whose bytes all go."""
    if not gone.any():
        return data.tobytes().decode()
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.diff(np.concatenate([heads, [len(data)]]))
    all_gone = np.logical_and.reduceat(gone, heads)
    return data[np.repeat(~all_gone, sizes)].tobytes().decode()

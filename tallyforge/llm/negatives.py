"""Hard negatives of anchor vectors: integer products behind bounds of an orthogonal rotation.

Anchors are a stated share of the rows and meet all rows, block by block. In
each meeting both sides are turned into the principal axes of the block's rows,
which leaves products as they are and puts most of them into the leading
components. After some components a product lies within the partial product
plus or minus the product of what is left of the two lengths, so most rows are
discarded before they are multiplied out; the others are multiplied again in
integers, which alone decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

POSITIVES, NEGATIVES = 5, 3
#: Vectors are read in units of 1/256; a negative has 50 to 95 hundredths of the positive's score.
SCALE, LEAST, MOST = 256, 50, 95
#: Components of the rows and of the anchors that meet in one task (8,192 and 4,096 vectors of 64), and anchors worked on at once.
ROW_VALUES, ANCHOR_VALUES, TILE = 1 << 19, 1 << 18, 64
#: Squared lengths from here on, in units: scores could leave 64 bits.
TOO_LONG = float(1 << 55)
#: Relative slack of a product of rotated vectors of n components, well beyond what double precision loses.
SLACK = 1e-13
#: When so few of a tile's pairs are left, they are multiplied out.
FEW = 1 / 64
_KEY = ["anchor_id", "anchor_twin"]


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, twin, label, dim, units) of the rows that take part, written to the shared folder.

    twin tells rows of one vec_id with other labels or components apart.
    """
    vec = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("long")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), label.alias("label"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", fine), F.lit(False)))
    short = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double")) < TOO_LONG
    own = own.where(short).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    units = F.transform("vec", lambda x: F.floor(x * SCALE).cast("long"))
    own = own.select("vec_id", "label", F.size("vec").alias("dim"), units.alias("units"))
    # numbered once and for all as they are written; what is read back is dealt by the number
    numbered = own.select("vec_id", F.xxhash64("label", "units").alias("twin"), "label", "dim", "units", F.monotonically_increasing_id().alias("number"))
    return materialize(numbered)


def _dealt(rows: DataFrame, anchors: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """rows and anchors under (dim, rb, ab): every block of rows meets every block of anchors of its length."""
    values = lambda df: df.agg(F.sum(F.greatest("dim", F.lit(1)).cast("long"))).first()[0] or 0
    row_blocks, anchor_blocks = -(-values(rows) // ROW_VALUES), -(-values(anchors) // ANCHOR_VALUES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(max(n, 1))).cast("int")
    left = rows.select("dim", own(["number"], row_blocks).alias("rb"), every(anchor_blocks).alias("ab"), "vec_id", "twin", "label", "units")
    right = anchors.select(F.col("dim").alias("adim"), every(row_blocks).alias("arb"), own(["vec_id", "twin"], anchor_blocks).alias("aab"), F.col("vec_id").alias("anchor_id"), F.col("twin").alias("anchor_twin"), F.col("label").alias("anchor_label"), F.col("units").alias("anchor_units"), *more)
    return left.groupBy("dim", "rb", "ab"), right.groupBy("adim", "arb", "aab")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class Meeting:
    """A block of rows and one of anchors, each rotated into the rows' principal axes."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        dim = int(rows.column("dim")[0].as_py())
        ids, twins = (rows.column(k).to_numpy() for k in ("vec_id", "twin"))
        # repeated rows count once; rows stand by vec_id, so that the first of equal scores has the smallest
        order = np.lexsort((twins, ids))
        order = order[np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(twins[order]) != 0)])] if len(order) else order
        self.ids, self.twins, self.labels = ids[order], twins[order], rows.column("label").to_numpy()[order]
        self.x = _matrix(rows.column("units"), dim)[order]
        self.anchor_ids, self.anchor_twins, self.anchor_labels = (anchors.column(k).to_numpy() for k in ("anchor_id", "anchor_twin", "anchor_label"))
        self.a = _matrix(anchors.column("anchor_units"), dim)
        x, a = self.x.astype(np.float64), self.a.astype(np.float64)
        # axes by falling share of the rows' squared lengths
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1] if dim else np.zeros((0, 0))
        self.rx, self.ra = x @ axes, a @ axes
        self.edges = sorted({-(-dim // 8), -(-dim // 4), -(-dim // 2), dim})
        self.x_rest, self.a_rest = self._rests(self.rx), self._rests(self.ra)
        self.x_length, self.a_length = np.sqrt((x * x).sum(axis=1)), np.sqrt((a * a).sum(axis=1))
        self.slack = SLACK * (dim + 64)

    def _rests(self, turned: np.ndarray) -> list[np.ndarray]:
        """The length of what is left of each vector behind each edge."""
        return [np.sqrt((turned[:, e:] ** 2).sum(axis=1)) for e in self.edges]

    def survivors(self, first: int, last: int, mask: np.ndarray, alive_in) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) pairs of anchors first to last inside mask that alive_in(mask, low, high) lets live after each step."""
        columns = np.arange(len(self.x))
        partial, begin, alive = np.zeros(mask.shape), 0, mask
        for step, end in enumerate(self.edges):
            partial += self.ra[first:last, begin:end] @ self.rx[columns, begin:end].T
            begin = end
            room = np.multiply.outer(self.a_rest[step][first:last], self.x_rest[step][columns])
            room += self.slack * np.multiply.outer(self.a_length[first:last], self.x_length[columns])
            alive = alive_in(mask, partial - room, partial + room)
            if alive.sum() <= FEW * alive.size:
                break
            some = alive.any(axis=0)
            if not some.all():
                # rows that nobody here needs any more; those that set the bounds are among the others
                columns, partial, mask, alive = columns[some], partial[:, some], mask[:, some], alive[:, some]
        p, q = np.nonzero(alive)
        return p + first, columns[q]

    def products(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores of pairs."""
        step = max(1, (1 << 20) // max(self.x.shape[1], 1))
        parts = [np.einsum("ij,ij->i", self.a[p[k : k + step]], self.x[q[k : k + step]]) for k in range(0, len(p), step)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def others(self, first: int, last: int) -> np.ndarray:
        """Where a row is not the anchor itself."""
        return (self.anchor_ids[first:last, None] != self.ids) | (self.anchor_twins[first:last, None] != self.twins)


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    if values.shape[1] < k:
        return np.full((len(values), 1), -np.inf)
    return np.partition(values, -k, axis=1)[:, -k, None]


def _first_of_each(owner: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each owner, the lowest place first among equal ones."""
    order = np.lexsort((place, -score, owner))
    own = owner[order]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(own)]])))
    return order[rank < k]


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key over all blocks, with rank; a row found in two blocks (a repeated one) counts once."""
    order = [F.col("score").desc(), F.col("vec_id"), F.col("twin")]
    ranked = found.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.dropDuplicates([*keys, "rank"])


_FOUND = [("anchor_id", pa.int64()), ("anchor_twin", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("twin", pa.int64()), ("score", pa.int64())]


def _found(meeting: Meeting, p: list, windows: list | None, q: list, score: list) -> pa.Table:
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    p, q, score = join(p), join(q), join(score)
    columns = [meeting.anchor_ids[p], meeting.anchor_twins[p], np.zeros(len(p), np.int64) if windows is None else join(windows), meeting.ids[q], meeting.twins[q], score]
    return pa.Table.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _FOUND)], [n for n, _ in _FOUND])


_NOTHING = pa.Table.from_arrays([pa.array([], t) for _, t in _FOUND], [n for n, _ in _FOUND])
_SCHEMA = ", ".join(f"{n} long" for n, _ in _FOUND)


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, anchor_twin, rank, vec_id, twin, score): each anchor's k best other rows of its label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _NOTHING
        meeting, ps, qs, scores = Meeting(left, right), [], [], []

        def alive_in(mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return mask & (high >= _kth_largest(np.where(mask, low, -np.inf), k))

        for first in range(0, len(right), TILE):
            last = min(first + TILE, len(right))
            mask = meeting.others(first, last) & (meeting.anchor_labels[first:last, None] == meeting.labels)
            p, q = meeting.survivors(first, last, mask, alive_in)
            score = meeting.products(p, q)
            best = _first_of_each(p, score, q, k)
            ps.append(p[best])
            qs.append(q[best])
            scores.append(score[best])
        return _found(meeting, ps, None, qs, scores)

    left, right = _dealt(rows, anchors)
    return _best(left.cogroup(right).applyInArrow(run, _SCHEMA).drop("positive_score"), _KEY, k)


def negatives(rows: DataFrame, anchors: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(anchor_id, anchor_twin, positive_score, rank, vec_id, twin, score): the k best rows of other labels below each score.

    anchors have the distinct scores of their positives in the list wanted.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _NOTHING
        meeting, ps, ws, qs, scores = Meeting(left, right), [], [], [], []
        lists = right.column("wanted").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = np.zeros((len(right), int(sizes.max())), np.int64)
        # no positive of these: a score of -1 has no negatives
        wanted[:] = -1
        wanted[np.arange(wanted.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        least, most = -(-LEAST * wanted // 100), MOST * wanted // 100
        for first in range(0, len(right), TILE):
            last = min(first + TILE, len(right))

            def alive_in(mask: np.ndarray, low: np.ndarray, high: np.ndarray, first: int = first, last: int = last) -> np.ndarray:
                alive = np.zeros(mask.shape, dtype=bool)
                for j in range(wanted.shape[1]):
                    floor, top = least[first:last, j, None].astype(np.float64), most[first:last, j, None].astype(np.float64)
                    # a row that is surely inside counts with the least that it can have
                    sure = np.where(mask & (low >= floor) & (high <= top), low, -np.inf)
                    alive |= mask & (low <= top) & (high >= np.maximum(floor, _kth_largest(sure, k)))
                return alive

            mask = meeting.anchor_labels[first:last, None] != meeting.labels
            p, q = meeting.survivors(first, last, mask, alive_in)
            score = meeting.products(p, q)
            for j in range(wanted.shape[1]):
                inside = np.flatnonzero((score >= least[p, j]) & (score <= most[p, j]))
                best = inside[_first_of_each(p[inside], score[inside], q[inside], k)]
                ps.append(p[best])
                ws.append(wanted[p[best], j])
                qs.append(q[best])
                scores.append(score[best])
        return _found(meeting, ps, ws, qs, scores)

    left, right = _dealt(rows, anchors, "wanted")
    return _best(left.cogroup(right).applyInArrow(run, _SCHEMA), [*_KEY, "positive_score"], k)


def hard_negatives(vectors: DataFrame, anchor: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    Anchors are the rows for which anchor holds (vec_id divisible by 50).
    Repeated rows are one row; rows of one vec_id with different labels or
    vectors are different ones. Rows whose id, label or vector is null, whose
    vector has null or non-finite components or, in units of 1/256, a squared
    length of 2^55 or more take no part; vectors of different lengths don't
    meet, empty ones score 0. Positives with a negative score have no negatives.
    """
    rows = integer_rows(vectors)
    anchors = materialize(rows.where(F.col("vec_id") % 50 == 0 if anchor is None else anchor).dropDuplicates(["vec_id", "twin"]).drop("number"))
    found = materialize(positives(rows, anchors))
    asked = found.where("score >= 0").groupBy(F.col("anchor_id").alias("i"), F.col("anchor_twin").alias("t")).agg(F.collect_set("score").alias("wanted"))
    near = negatives(rows, anchors.join(asked, (F.col("vec_id") == F.col("i")) & (F.col("twin") == F.col("t"))).drop("i", "t"))
    pairs = found.select(F.col("anchor_id").alias("i"), F.col("anchor_twin").alias("t"), F.col("vec_id").alias("positive_id"), F.col("score").alias("s"))
    both = pairs.join(near, (F.col("i") == F.col("anchor_id")) & (F.col("t") == F.col("anchor_twin")) & (F.col("s") == F.col("positive_score")))
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same by all pairs of anchors and rows, for tables without repeated ids, long vectors or vectors of several lengths.
ORACLE_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""

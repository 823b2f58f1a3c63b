"""Ranked lexical search: blocked sparse products of items' terms and documents' impacts.

An item is a row of term multiplicities, a block of documents a sparse matrix
with a row of (document, impact) for each term. Their product is made row by row
as Gustavson does: an item's row merges its terms' rows, each times its
multiplicity, into one accumulator over the block. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_columns, give_back, materialize, ragged_take, row_chunks, text_bytes, text_slices, word_spans

TOP = 20
#: Rows (item, term) that one pass over the documents answers; they go to the tasks by way of the driver.
PASS_TERMS = 400_000
#: Postings (document, term) of a block.
BLOCK_POSTINGS = 1 << 21
#: What a term's weight and a document's length count.
WEIGHT_UNIT, IMPACT_UNIT, TF_UNIT, LENGTH_SHARE, LENGTH_FACTOR = 1000, 1_000_000_000, 1000, 25, 12
#: Bytes that separate terms: all ASCII but digits and letters.
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _terms(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column in order, A-Z lower-cased, and term offsets by row."""
    data, offsets = text_bytes(text)
    starts, ends, first = word_spans(data, offsets, NO_TERM)
    lengths = ends - starts
    joined = _LOWER[data[ragged_take(starts, lengths)]]
    places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(joined)]), first


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term binary, times) of (item_id, text): the terms of an item's distinct texts with their multiplicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            terms, first = _terms(batch.column(1))
            coded = terms.dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            key, times = np.unique(row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            at, term = np.divmod(key, max(len(coded.dictionary), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), coded.dictionary.take(pa.array(term)).cast(pa.binary()), pa.array(times)], ["item_id", "term", "times"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    return own.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Items:
    """The item-term matrix of a pass: rows by item, columns by the place of a term in the sorted vocabulary."""

    def __init__(self, rows: pa.Table):
        known = rows.column("item_id").combine_chunks()
        coded = pc.dictionary_encode(known, null_encoding="encode")
        # a null id is an item as any other
        self.ids = coded.dictionary
        term = rows.column("term").combine_chunks().cast(pa.large_binary()).dictionary_encode()
        self.terms = term.dictionary
        item = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(item, kind="stable")
        self.column = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.times = rows.column("times").to_numpy().astype(np.int64)[order]
        self.begin = np.searchsorted(item[order], np.arange(len(self.ids) + 1))


def postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(doc_id, n, terms array<int>, tf array<int>) of every document with a term: n counts all its terms, the lists hold those among terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found, first = _terms(batch.column(1))
            place = pc.index_in(found, value_set=terms)
            kept = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            n = np.diff(first)
            row = np.repeat(np.arange(batch.num_rows), n)[kept]
            width = max(len(terms), 1)
            key, tf = np.unique(row * width + place.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * width)
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (key % width, tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(n > 0))

    return doc_columns(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _document_frequencies(posted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the size terms; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    sums = posted.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return out


def _best_of(score: np.ndarray, doc: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores above 0; equal ones by ascending doc, rows without an id last."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        # ties of the last place stay for now
        some = some[score[some] >= np.partition(score[some], -k)[-k]]
    return some[np.lexsort((doc[some], missing[some], -score[some]))[:k]]


def _ranked_block(items: Items, weights: np.ndarray, documents: int, length: int, k: int):
    """For mapInArrow: the k best documents of each item among a task's rows of postings, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(items.ids)
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            for a, b in row_chunks(ends, BLOCK_POSTINGS):
                part = batch.slice(a, b - a)
                doc, missing = part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(0).is_null().to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                size = 100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // length
                term = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(doc)), np.diff(ends[a : b + 1]))
                impact = weights[term] * (IMPACT_UNIT * tf // (TF_UNIT * tf + LENGTH_FACTOR * size[row]))
                # the term-document matrix by rows: a term's documents and impacts lie together
                order = np.argsort(term, kind="stable")
                row, impact = row[order], impact[order]
                begin = np.searchsorted(term[order], np.arange(len(weights) + 1))
                sums = np.zeros(len(doc), np.int64)
                for i in range(len(items.ids)):
                    sums[:] = 0
                    for t, times in zip(items.column[items.begin[i] : items.begin[i + 1]].tolist(), items.times[items.begin[i] : items.begin[i + 1]].tolist()):
                        x, y = begin[t], begin[t + 1]
                        # a document occurs once in a term's row
                        sums[row[x:y]] += impact[x:y] * times
                    s, d, m = held[i]
                    best = _best_of(sums, doc, missing, k)
                    s, d, m = np.concatenate([s, sums[best]]), np.concatenate([d, doc[best]]), np.concatenate([m, missing[best]])
                    best = _best_of(s, d, m, k)
                    held[i] = (s[best], d[best], m[best])
            give_back()
        owner = np.repeat(np.arange(len(held)), [len(s) for s, _, _ in held])
        score, doc, missing = (np.concatenate([np.zeros(0, t), *[h[j] for h in held]]).astype(t) for j, t in enumerate((np.int64, np.int64, bool)))
        yield pa.RecordBatch.from_arrays([items.ids.take(pa.array(owner)), pa.array(doc, pa.int64(), mask=missing), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    Every row of docs is a document, repeats included; a null text has no terms
    and a null doc_id stands behind others of equal score. Rows of items with
    one item_id are one item, which has the terms of its distinct texts; items
    without terms have no rows. Items are answered in passes over the documents
    of about pass_terms (item, term) rows each, so what goes to the tasks is
    bounded whatever the number of items; an item itself is never split.
    """
    matrix = materialize(item_terms(items))
    passes = max(1, -(-matrix.count() // pass_terms))
    results = None
    for k_pass in range(passes):
        mine = Items(matrix.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k_pass).toArrow())
        posted = materialize(postings(docs, mine.terms))
        total = posted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        documents, length = total["documents"], max(total["length"], 1)
        df = _document_frequencies(posted, len(mine.terms))
        weights = np.floor(WEIGHT_UNIT * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        best = posted.mapInArrow(_ranked_block(mine, weights, documents, length, k), "item_id long, doc_id long, score long")
        results = best if results is None else results.unionByName(best)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH asked AS (
  SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark
), held AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM documents
), totals AS (
  SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM held
), sized AS (
  SELECT doc_id, 75 + (25 * count(*) * any_value(docs)) // any_value(terms) AS m FROM held, totals GROUP BY doc_id
), counted AS (
  SELECT doc_id, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counted, totals GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term) JOIN counted USING (term) JOIN weighed USING (term) JOIN sized USING (doc_id)
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

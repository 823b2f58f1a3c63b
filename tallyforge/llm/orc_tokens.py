"""Token ids in ORC files: run-length encoded stripes, row indexes, Bloom filters on doc_id."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_columns, ragged_take, row_chunks, shared_dir, split_words, text_slices

#: Word ids are gathered for about this many bytes of text at a time.
GATHER_BYTES = 4 << 20

#: Bytes of text whose distinct words are encoded together.
ENCODE_BYTES = 24 << 20
#: A worker keeps the ids of words that a batch holds twice, up to so many words.
CACHED_WORDS = 200_000

#: Latin letters (but for one whose lower case is more than a letter) and signs that don't begin an ending like 's.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)[!-&(-/:-;=?@\[-`{}~]*").fullmatch

_TOKENIZERS: dict = {}
_ENDS: dict = {}
_WORDS: dict[str, dict[str, bytes]] = {}


def load_tokenizer(path: str):
    """The tokenizers library's object for a .json file, once a worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        _TOKENIZERS[path] = tokenizers.Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _word_ends(tokenizer, path: str) -> np.ndarray | None:
    """For each id, whether it ends a word; None where the file's tokens don't say so."""
    if path not in _ENDS:
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        for token, k in tokenizer.get_vocab(with_added_tokens=False).items() if suffix else ():
            ends[k] = token.endswith(suffix)
        _ENDS[path] = ends if suffix else None
    return _ENDS[path]


def _encode_into(ids: list, tokenizer, path: str, words: list[str], chosen: list[int]) -> None:
    """Put the ids of the chosen words, as bytes, into their places of ids.

    Latin letters are one pre-token and signs after them another, and the last
    id alone of a pre-token ends a word; such words go to the library many at a
    time, put apart by spaces, and the ids are told apart by the ends. Other
    words go one by one.
    """
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    ends = _word_ends(tokenizer, path)
    plain: list[tuple[int, int]] = []
    other: list[int] = []
    for k in chosen:
        m = _PLAIN(words[k]) if ends is not None else None
        if m:
            plain.append((k, (m.end(1) > 0) + (m.end(1) < m.end())))
        else:
            other.append(k)
    lines = [plain[at : at + 400] for at in range(0, len(plain), 400)]
    for first in range(0, len(lines), 50):
        some = lines[first : first + 50]
        for line, e in zip(some, encode([" ".join([words[k] for k, _ in line]) for line in some], add_special_tokens=False)):
            found = np.array(e.ids, dtype=np.uint32)
            cuts = (4 * np.flatnonzero(ends[found]) + 4).tolist()
            if len(cuts) != sum([n for _, n in line]):
                other.extend([k for k, _ in line])
                continue
            data, at, seen = found.tobytes(), 0, -1
            for k, n in line:
                seen += n
                ids[k] = data[at : cuts[seen]]
                at = cuts[seen]
    for at in range(0, len(other), 20000):
        some = other[at : at + 20000]
        for k, e in zip(some, encode([words[k] for k in some], add_special_tokens=False)):
            ids[k] = np.array(e.ids, dtype=np.uint32).tobytes()


def encode_column(text: pa.Array, path: str, end_id: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) pieces of a text column, encoded by the library.

    The tokenizer drops white space and never joins across it, so each distinct
    white-space word is encoded once and documents are put together from those.
    """
    tokenizer = load_tokenizer(path)
    words, codes, first = split_words(text)
    cache = _WORDS.setdefault(path, {})
    distinct = words.to_pylist()
    ids = list(map(cache.get, distinct))
    new = [k for k, x in enumerate(ids) if x is None]
    _encode_into(ids, tokenizer, path, distinct, new)
    if len(cache) < CACHED_WORDS and new:
        often = np.bincount(codes, minlength=len(distinct)) > 1
        cache.update((distinct[k], ids[k]) for k in new if often[k])
    length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    ids.append(b"" if end_id is None else np.array([end_id], dtype=np.uint32).tobytes())
    length = np.append(length, 0 if end_id is None else 1)
    flat = np.frombuffer(b"".join(ids), dtype=np.uint32)
    start = np.cumsum(length) - length
    for a, b in row_chunks(first * 6, GATHER_BYTES):
        # each document's words and the end's id
        own = np.insert(codes[first[a] : first[b]], first[a + 1 : b + 1] - first[a], len(ids) - 1)
        n = length[own]
        ends = np.concatenate([[0], np.cumsum(n)])[first[a : b + 1] - first[a] + np.arange(b - a + 1)]
        yield b - a, flat[ragged_take(start[own], n)], ends


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, compression: str = "zstd") -> None:
    """Write (doc_id, part, part_start, n, ids) as ORC under path, ascending by doc_id.

    n is the number of ids, so that offsets are read without the ids.

    Files are ranges of doc_id, so readers take stripes in parallel and skip
    files, stripes and row groups by the ids' minima, maxima and Bloom filters.
    Rows with one doc_id are ordered by text; null ids come first. A document
    without tokens holds the end id alone.
    """
    ordered = doc_columns(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, limit=ENCODE_BYTES):
            at = 0
            for rows, ids, ends in encode_column(batch.column(1), tokenizer_path, end_id):
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                starts = pa.array(before + ends[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(np.full(rows, part, np.int32)), starts, pa.array(np.diff(ends).astype(np.int32)), lists], ["doc_id", "part", "part_start", "n", "ids"])
                at, before = at + rows, before + int(ends[-1])

    ordered.mapInArrow(run, "doc_id long, part int, part_start long, n int, ids array<int>").write.option("compression", compression).option("orc.bloom.filter.columns", "doc_id").option(
        "orc.create.index", "true"
    ).option("orc.row.index.stride", "10000").orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): start counts the ids of all documents before, from the files alone."""
    rows = spark.read.schema("doc_id long, part int, part_start long, n int, ids array<int>").orc(path)
    # one row a file range: a sum over a table as long as the list of files
    parts = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n")).alias("n"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    order = Window.orderBy(F.col("has_null").desc(), F.col("least").asc_nulls_first())
    bases = parts.select(F.col("part").alias("p"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(bases), F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            view = memoryview(flat.tobytes())
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the ids of every document to ORC and report per document from the files read back."""
    path = path or shared_dir(docs.sparkSession)
    write_token_ids(docs, path, tokenizer_path, end_id)
    return token_digests(read_token_ids(docs.sparkSession, path))

"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: list[tuple[SparkSession, str]] = []
#: Bytes of text that one numpy step works on; bounds a task's temporary arrays.
CHUNK_BYTES = 1 << 20
#: Bytes of text whose words are worked on at once.
SLICE_BYTES = 8 << 20
#: Separator bytes [\x20\x09-\x0D] of the word contracts.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which executors and driver share.

    Without that setting a local session, whose one machine shares its disk, gets
    a temporary folder; on a cluster the setting must be given. Folders are
    deleted when the Python process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_clear)
    _FOLDERS.append((spark, path))
    return path


def _clear() -> None:
    """Delete the folders of this process, where their session still runs."""
    for spark, path in _FOLDERS:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  a stopped session can't delete
            continue


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_columns(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, so that extra columns can't clash; a null text is empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of every row in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about limit bytes of text, which bounds what a task holds of them at once."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        for a, b in row_chunks(offsets, limit):
            yield batch.slice(a, b - a)
            give_back()


def give_back() -> None:
    """Hand freed memory to the system, so that a worker that is used again doesn't keep the peaks of all its stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the concatenation of the ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of every row, and the number of the first word of each row.

    A word is a longest run of bytes that space doesn't mark ([\\x20\\x09-\\x0D]); rows end words.
    """
    inside = ~space[data]
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], before[1:] = True, ~inside[:-1]
        after[-1], after[:-1] = True, ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges] = True
        after[edges - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct ASCII-white-space words of a column, the code of each word, and word offsets by row."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(text.cast(pa.large_string()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    kept = keep.to_numpy(zero_copy_only=False)
    if len(kept) and not kept.all():
        rows = np.repeat(np.arange(len(counts)), counts)[kept]
        counts = np.bincount(rows, minlength=len(counts))
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets

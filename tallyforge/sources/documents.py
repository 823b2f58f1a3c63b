"""Document sources: binary files by kind, pages of documents, content-addressed storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_kind(path: Column, mime: Column | None = None) -> Column:
    p, m = F.lower(path), F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    return (
        F.when((m == "application/pdf") | p.endswith(".pdf"), "pdf")
        .when(m.contains("word") | p.rlike("\\.docx?$"), "word")
        .when(m.startswith("image/") | p.rlike("\\.(png|jpe?g|webp)$"), "image")
    )


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, sha256, content) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_kind(F.col("path")).alias("kind"), "length", F.sha2("content", 256).alias("sha256"), "content")


def storage_key(sha256: Column, suffix: Column) -> Column:
    return F.concat(F.lit("uploads/sha256/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit("."), suffix)


def write_blobs(files: DataFrame, path: str) -> None:
    """Content-addressed write: one row per hash, in folders of its first two letters; repeats overwrite."""
    rows = files.groupBy("sha256").agg(F.first("content").alias("content")).withColumn("shard", F.substring("sha256", 1, 2))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def safe_key(key: Column) -> Column:
    return key.startswith("derived/") & ~key.contains("..") & ~key.contains("\\") & ~key.startswith("/")


def list_prefix(keys: DataFrame, prefix: str) -> DataFrame:
    return keys.where(F.col("key").startswith(prefix)).orderBy("key")


def page_rows(docs: DataFrame, render: Callable[[str, bytes], Iterator[bytes]], key: str = "path") -> DataFrame:
    """(key, page, content): each document's pages, by a renderer that the caller gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch[key], batch["content"]):
                # one document's pages at a time
                rows = [(k, n, bytes(p)) for n, p in enumerate(render(k, data), 1)]
                yield pd.DataFrame(rows, columns=[key, "page", "content"])

    return docs.select(key, "content").mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, page int, content binary")


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, part, body): the paragraphs of web pages, in order."""
    parts = F.regexp_extract_all(F.col("html"), F.lit("<p>([^<]*)"), F.lit(1))
    return pages.select("page_id", F.posexplode(parts).alias("part", "body"))


def read_parts(files: DataFrame, render: Callable, convert: Callable) -> DataFrame:
    """(path, mode, page, content) of files (path, kind, content): each by the mode of its kind.

    Images go whole ('direct', no page), PDF files by page ('pages'), Word files
    by page of what convert makes of them ('word'). Other kinds are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[convert(k, d) for k, d in zip(batch["path"], batch["content"])])

    direct = files.where("kind = 'image'").select("path", F.lit("direct").alias("mode"), F.lit(None).cast("int").alias("page"), "content")
    paged = page_rows(files.where("kind = 'pdf'"), render).withColumn("mode", F.lit("pages"))
    word = files.where("kind = 'word'").select("path", "content").mapInPandas(run, "path string, content binary")
    return direct.unionByName(paged).unionByName(page_rows(word, render).withColumn("mode", F.lit("word")))


def read_documents(spark: SparkSession, path: str, mode: str, render: Callable | None = None, convert: Callable | None = None) -> DataFrame:
    """Documents whole ('direct'), by page ('pages') or by page after a conversion ('word')."""
    files = read_binary(spark, path)
    if mode == "direct":
        return files.withColumn("page", F.lit(None).cast("int"))
    return read_parts(files.where(F.col("kind") == {"pages": "pdf", "word": "word"}[mode]), render, convert)


def exists(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """keys with found: whether the store holds them."""
    return keys.join(stored.select("key").distinct().withColumn("_there", F.lit(True)), "key", "left").withColumn("found", F.col("_there").isNotNull()).drop("_there")


def delete_blobs(stored: DataFrame, dropped: DataFrame, used: DataFrame) -> DataFrame:
    """What the store holds after keys are dropped; a key that is still used stays, one that isn't there is no error."""
    gone = dropped.select("key").distinct().join(used.select("key").distinct(), "key", "left_anti")
    return stored.join(gone, "key", "left_anti")


#: Name and version of the figure cutter in storage paths.
CROP, CROP_VERSION = "figure-crop", 1


def figure_records(rows: DataFrame) -> DataFrame:
    """One asset record a usable figure of rows (..., question_id, sha256, figures); the pixels are cut elsewhere.

    A figure (id, source_page, bbox, description) is usable with an id, a page
    from 1 and a box of four numbers. size_bytes is null until the cut is stored.
    """
    each = rows.withColumn("f", F.explode("figures")).drop("figures")
    usable = (F.trim(F.coalesce(F.col("f.id"), F.lit(""))) != "") & (F.col("f.source_page") > 0) & (F.size("f.bbox") == 4) & F.forall("f.bbox", lambda x: x.isNotNull())
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-")
    key = F.concat(F.lit("question-"), safe(F.col("question_id")), F.lit("-"), safe(F.col("f.id")), F.lit(".png"))
    found = each.where("sha256 IS NOT NULL").where(usable).withColumn("asset_key", key)
    path = F.concat_ws("/", F.lit("derived"), "sha256", F.lit(CROP), F.lit(str(CROP_VERSION)), "asset_key")
    record = {"storage_path": path, "source_page": F.col("f.source_page"), "bbox": F.col("f.bbox"), "bbox_unit": F.lit("page_percent"), "alt": F.coalesce("f.description", F.lit("")), "size_bytes": F.lit(None).cast("long")}
    return found.withColumns(record).drop("f")


def backfill_summary(scanned: DataFrame, records: DataFrame, key: str, failed: DataFrame | None = None) -> DataFrame:
    """One row: rows scanned, rows without a usable figure, records made, and rows that failed."""
    bad = (failed if failed is not None else scanned.limit(0)).select(key).distinct()
    rows = {"scanned": scanned, "skipped": scanned.join(records.select(key), key, "left_anti"), "generated": records.join(bad, key, "left_anti"), "failed": bad}
    each = reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(name).alias("what")) for name, df in rows.items()])
    return each.agg(*[F.count_if(F.col("what") == name).alias(name) for name in rows])


def store_root(driver: str, root: str) -> str:
    """The path prefix of a storage driver; drivers without a connector are refused."""
    schemes = {"fs": "file://", "hdfs": "hdfs://"}
    if driver not in schemes:
        raise NotImplementedError(f"storage driver {driver}")
    return f"{schemes[driver]}{root.rstrip('/')}"

"""The folder that driver and executors share, for what is written once and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a temporary folder for a local session, and none for a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def fresh_folder(spark: SparkSession) -> str:
    """A new folder there; it goes when the process ends."""
    path = f"{shared_base(spark)}/tallyforge-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _MADE:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  a stopped session can't delete
            continue


def written(rows: DataFrame) -> DataFrame:
    """rows, written and read back: what made them runs once, whoever reads them how often."""
    path = fresh_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

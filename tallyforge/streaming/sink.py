"""A sink of micro-batches that holds each batch once, whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchSink:
    """Parquet folders by batch id, each with a mark once it is whole.

    A batch is written over what an earlier try left in its own folder, and
    marked after that: a stream that is killed in between and replays the batch
    leaves its rows once. Only marked batches are read. A batch that is already
    marked isn't written again, so a replay costs nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def is_whole(self, batch: int) -> bool:
        files, place = self._place(f"_marks/{batch}")
        return files.exists(place)

    def write(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch."""
        if self.is_whole(batch):
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self.mark(batch)

    def mark(self, batch: int) -> None:
        files, place = self._place(f"_marks/{batch}")
        files.create(place, True).close()

    def batches(self) -> list[int]:
        files, place = self._place("_marks")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(place)) if files.exists(place) else []

    def read(self, schema: str) -> DataFrame:
        """All rows of marked batches, with their batch."""
        whole = self.batches()
        if not whole:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.option("basePath", self.path).schema(f"{schema}, batch long").parquet(*[f"{self.path}/batch={b}" for b in whole])
        return rows.withColumn("batch", F.col("batch").cast("long"))

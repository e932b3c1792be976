"""Incidents of a stream as a stored table with one row each, merged day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.scalar import utc_day
from wardline.operators.incidents import merge_incidents
from wardline.sources.records import read_table

CELL = ["day", "bucket"]


class IncidentStore:
    """`current` holds every incident once; `fragments` what each micro-batch added to it.

    Both are partitioned by day and by a hash of the incident. A batch replaces its own fragments, then the cells it
    touches are merged again from the fragments of these cells and swapped in whole. So a replayed batch counts once, a
    late one finds its day, and the rows read follow the cells of the batch and not the history.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8):
        self.spark, self.fragments, self.current, self.buckets = spark, f"{folder}/incident_fragments", f"{folder}/incidents", buckets

    def _placed(self, incidents: DataFrame) -> DataFrame:
        # An incident's key holds its quarter hour, so all its fragments fall on one day.
        return incidents.withColumns({"day": utc_day(F.col("created_us")).cast("string"), "bucket": F.pmod(F.hash("incident_key"), F.lit(self.buckets))})

    def _write(self, rows: DataFrame, path: str, *parts: str) -> None:
        rows.repartition(*CELL).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    def touched(self, cells: list) -> DataFrame:
        """The fragments of the given (day, bucket) pairs; only their folders are listed and read."""
        by_day: dict[str, list[int]] = {}
        for day, bucket in cells:
            by_day.setdefault(day, []).append(bucket)
        chosen = F.lit(False)
        for day, buckets in by_day.items():
            chosen = chosen | ((F.col("day") == day) & F.col("bucket").isin(buckets))
        return self.spark.read.option("basePath", self.fragments).parquet(*[f"{self.fragments}/day={d}" for d in by_day]).withColumn("day", F.col("day").cast("string")).where(chosen)

    def upsert(self, incidents: DataFrame, batch_id: int) -> None:
        """Merge the incidents that one batch correlated."""
        fresh = self._placed(incidents)
        # A batch that is replayed with other rows may have written to other cells before: its old fragments go, too.
        old = read_table(self.spark, self.fragments)
        stale = [] if old is None else [tuple(r) for r in old.where(F.col("batch_id") == batch_id).select(F.col("day").cast("string"), "bucket").distinct().collect()]
        cells = sorted({tuple(r) for r in fresh.select(*CELL).distinct().collect()} | set(stale))
        if not cells:
            return
        empty = [c for c in stale if c not in {tuple(r) for r in fresh.select(*CELL).distinct().collect()}]
        self._write(fresh.withColumn("batch_id", F.lit(batch_id)), self.fragments, *CELL, "batch_id")
        for day, bucket in empty:
            self._drop(f"{self.fragments}/day={day}/bucket={bucket}/batch_id={batch_id}")
            self._drop(f"{self.current}/day={day}/bucket={bucket}")
        rows = self.touched(cells).select(*incidents.columns)
        self._write(self._placed(merge_incidents(rows.limit(0), rows)), self.current, *CELL)

    def _drop(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def incidents(self) -> DataFrame | None:
        stored = read_table(self.spark, self.current)
        return None if stored is None else stored.drop(*CELL)

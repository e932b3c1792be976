"""Shared helpers of the corpus operators: tables in the shared folder, row locators, global prefix sums."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, ROW = "_w_file", "_w_row"
LOCATOR = (FILE, ROW)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a private one only on a purely local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wardline-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def drop_table(table: DataFrame) -> None:
    """Delete a table made by `write_table` once nothing reads it any more."""
    spark = table.sparkSession
    folder = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for file in table.inputFiles()[:1]:
        parent = os.path.dirname(file)
        if folder in parent and "/llm-" in parent:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def session_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings for the jobs started inside the block; `__` stands for a dot."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back.

    The job's shuffle files are not needed after that and go at its end.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = 256):
    """Bound the rows of an Arrow batch: documents may be very long."""
    return session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def anchored(df: DataFrame) -> DataFrame:
    """`df` itself if it is a plain Parquet read, else a copy in the shared folder: its rows then have fixed places."""
    plain = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return df if plain and all(f.endswith(".parquet") for f in df.inputFiles()[:1]) else write_table(df, "rows")


def with_locator(df: DataFrame) -> DataFrame:
    """Add a unique and stable row address: the file and the row's number in it.

    Repeated rows and null keys stay apart, and every later pass sees the same rows.
    """
    df = anchored(df)
    meta = df.metadataColumn("_metadata")
    return df.withColumns({FILE: meta.getField("file_path"), ROW: meta.getField("row_index")})


def in_written_order(table: DataFrame) -> DataFrame:
    """The rows of a table made by `write_table` in the order of its part files, which follow the partitions written.

    A plain scan takes the largest pieces of the files first.
    """
    return with_locator(table).repartitionByRange(*LOCATOR).sortWithinPartitions(*LOCATOR).select(*table.columns)


def source_rows(docs: DataFrame, **wanted: str | None) -> DataFrame:
    """The locator and the wanted columns under fixed names; an absent or unnamed column is null."""
    placed = with_locator(docs)
    return placed.select(*LOCATOR, *[
        (placed[c] if c is not None and c in docs.columns else F.lit(None).cast("string")).alias(name) for name, c in wanted.items()])


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of `docs` whose locator is not in `dropped`; columns as in `docs`."""
    names = docs.columns
    placed = with_locator(docs)
    gone = dropped.select(F.col(FILE).alias("_g_file"), F.col(ROW).alias("_g_row"))
    return placed.join(gone, (placed[FILE] == gone["_g_file"]) & (placed[ROW] == gone["_g_row"]), "left_anti").select(*[placed[c] for c in names])


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str], tag: str) -> DataFrame:
    """Add for each `name: column` the total of `column` over all rows before this one in `order`.

    Two passes: rows are range-partitioned, summed by partition, and the one row per partition is summed up in
    order and sent to all tasks (its size is the number of partitions). `order` must be unique, so that a hot
    leading key is split among partitions.
    """
    part = "_w_part"
    ranged = write_table(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), tag)
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    parts = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(part).alias("_b_part"), *[F.coalesce(F.sum(f"_t_{n}").over(parts), F.lit(0)).alias(f"_b_{n}") for n in sums])
    local = ranged.withColumns({f"_l_{n}": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    joined = local.join(F.broadcast(bases), local[part] == bases["_b_part"])
    return joined.select(*[local[c] for c in df.columns], *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def long_id(df: DataFrame, column: str) -> Column:
    """The id as bigint where it is a whole number, else as it is."""
    kind = df.schema[column].dataType
    return F.col(column).cast("long") if isinstance(kind, T.IntegralType) else F.col(column)

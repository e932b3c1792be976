"""Exact deduplication by a keyed streaming state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, anchored, session_conf, source_rows, table_path, without_rows, write_table

STORE_ROWS = 250_000  # rows per state store: each store is a database with several MB of its own on disk
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _rank() -> Column:
    """Order of rows inside a group: smallest id, null ids last, then the place of the row."""
    return F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))


def keyed_state(rows: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """One row per key of `rows` (key, id, locator): `keep` (id and content locator of the row that stays) and `n`.

    The rows pass through a streaming aggregation whose state lives in RocksDB on the executors' disks and in
    the shared folder; the number of stores follows the number of rows. There is no watermark: no key expires. Each micro-batch writes its updated keys under
    its own number, so a repeated batch replaces its output; the newest entry of a key counts.
    """
    spark = rows.sparkSession
    spool, out, state = (table_path(spark, t) for t in ("spool", "keys", "state"))
    rows.write.parquet(spool)
    stores = max(spark.sparkContext.defaultParallelism, -(-spark.read.schema(rows.schema).parquet(spool).count() // STORE_ROWS))
    with session_conf(
        spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="256",
        spark__sql__streaming__internal__stateStore__partitions=str(stores),
    ):
        reader = spark.readStream.schema(rows.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        keys = reader.parquet(spool).groupBy("key").agg(F.min(_rank()).alias("keep"), F.count(F.lit(1)).alias("n"))
        keys.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start().awaitTermination()
    kind = f"key {rows.schema['key'].dataType.simpleString()}, keep struct<unknown:boolean,id:{rows.schema['id'].dataType.simpleString()},file:string,row:bigint>, n bigint, batch int"
    spark.createDataFrame([], "n bigint").write.mode("append").parquet(f"{out}/batch=-1")
    written = spark.read.schema(kind).parquet(out).filter("batch >= 0")
    return written.groupBy("key").agg(F.max_by(F.struct("keep", "n"), "batch").alias("last")).select("key", "last.keep", "last.n")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_chars: int = 64, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of `docs`: locator, id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when identical after `normalised`. The row with the smallest id stays; null ids come last,
    and among repeated rows with one id the first by place stays, so exactly one row of a group is kept. Null
    and empty texts form one group. An empty table gives an empty result; other columns are not read.

    Method: a streaming state keyed by digest (`keyed_state`). Where a digest was hit more than once, the full
    texts are compared by grouping on the text itself; a digest that holds different texts is split by text.
    `key_chars` shortens the digest and exists to test that path.
    """
    src = source_rows(docs, id=id_col, text=text_col)
    text = normalised(F.col("text"))
    sha = F.sha2(text, 256)
    rows = write_table(src.select(*LOCATOR, "id", F.substring(sha, 1, key_chars).alias("key"), sha.alias("text_sha256")), "digests")
    state = write_table(keyed_state(rows.select(*LOCATOR, "id", "key"), files_per_batch), "state-keys")
    hits = state.filter("n > 1").select(F.col("key").alias("hit"))
    texts = src.select(*LOCATOR, "id", F.substring(sha, 1, key_chars).alias("key"), text.alias("norm"))
    copies = texts.join(hits, F.col("key") == F.col("hit")).select("key", "norm", _rank().alias("place"))
    classes = copies.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("m"))
    mixed = write_table(classes.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("key"), "mixed-keys")
    joined = rows.join(state, "key")
    plain = joined if mixed.isEmpty() else joined.join(mixed, "key", "left_anti")
    result = plain.select(*LOCATOR, "id", "text_sha256", "keep", "n")
    if not mixed.isEmpty():
        bad = texts.join(mixed, "key")
        split = bad.groupBy(F.col("key").alias("k"), F.col("norm").alias("t")).agg(F.min(_rank()).alias("keep"), F.count(F.lit(1)).alias("n"))
        result = result.unionByName(bad.join(split, (F.col("key") == F.col("k")) & (F.col("norm") == F.col("t"))).select(
            *LOCATOR, "id", F.sha2("norm", 256).alias("text_sha256"), "keep", "n"))
    return result.select(
        *LOCATOR, "id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("keep.file") == F.col(FILE)) & (F.col("keep.row") == F.col(ROW))).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns."""
    placed = anchored(docs)
    dropped = write_table(deduplicate(placed, id_col, text_col).filter("not kept").select(*LOCATOR), "dropped")
    return without_rows(placed, dropped)

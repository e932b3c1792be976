"""Identifiers a stream has seen, in hash buckets with Bloom filters, so that a batch does not read all history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import cut_lineage
from wardline.sources.records import drop_batch, read_table, write_batch

HASHES = 8
BITS = 32  # bits of a filter per identifier: one unseen identifier in about 175,000 is looked up for nothing
FILTER = "bucket int, generation int, first_batch int, last_batch int, ids bigint, bits binary"


def places(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions per identifier from two hashes of it."""
    step = second.astype(np.uint64) | np.uint64(1)
    return (first.astype(np.uint64)[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def holds(bits: bytes, at: np.ndarray) -> np.ndarray:
    flags = np.frombuffer(bits, dtype=np.uint8)
    return ((flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def with_ids(bits: bytes, at: np.ndarray) -> bytes:
    flags = np.frombuffer(bits, dtype=np.uint8).copy()
    np.bitwise_or.at(flags, (at >> np.uint64(3)).ravel().astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())
    return flags.tobytes()


class SeenIds:
    """The ids of a stream: `ids` by bucket and batch, one open filter per bucket, and closed filters.

    A filter takes `capacity` ids; then it is closed and a new generation begins. A batch probes the filters of its
    buckets, and reads stored ids only for (bucket, generation) pairs that a filter names: as a rule those of true
    repeats. Everything is written by batch id, so a replayed batch sees the state before it and replaces its own rows.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, capacity: int = 100_000):
        self.spark, self.ids, self.open, self.closed = spark, f"{folder}/seen_ids", f"{folder}/seen_open", f"{folder}/seen_closed"
        self.buckets, self.capacity = buckets, capacity

    def _keyed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.col(key).alias("id"), F.pmod(F.hash(key), F.lit(self.buckets)).alias("bucket"),
                           F.xxhash64(key).alias("first"), F.xxhash64(F.lit("second"), F.col(key)).alias("second"))

    def _filters(self, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(open, closed) filters before this batch."""
        empty = self.spark.createDataFrame([], FILTER)
        names = empty.columns
        opened, closed = read_table(self.spark, self.open, batch_id), read_table(self.spark, self.closed, batch_id)
        if opened is not None:
            newest = opened.agg(F.max("batch_id")).first()[0]
            opened = opened.where(F.col("batch_id") == newest).select(*names) if newest is not None else empty
        return empty if opened is None else opened, empty if closed is None else closed.select(*names)

    def suspects(self, rows: DataFrame, batch_id: int, key: str = "event_id") -> DataFrame:
        """`id`, `bucket`, `first_batch`, `last_batch`: ids that a filter seems to hold, and where they would be stored."""
        opened, closed = self._filters(batch_id)

        def probe(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            found = []
            for f in filters.itertuples(index=False):
                hit = ids["id"][holds(f.bits, places(ids["first"].to_numpy(), ids["second"].to_numpy(), len(f.bits) * 8))] if len(ids) else []
                found += [(i, f.bucket, f.first_batch, f.last_batch) for i in hit]
            return pd.DataFrame(found, columns=["id", "bucket", "first_batch", "last_batch"])

        keyed = self._keyed(rows.select(key).distinct(), key)
        return keyed.groupBy("bucket").cogroup(opened.unionByName(closed).groupBy("bucket")).applyInPandas(probe, "id string, bucket int, first_batch int, last_batch int")

    def stored(self, suspects: DataFrame, batch_id: int) -> DataFrame | None:
        """The stored ids of the buckets and batches that suspects point to; None if nothing has to be read."""
        cells = suspects.select("bucket", "first_batch", "last_batch").distinct().collect()
        table = read_table(self.spark, self.ids, batch_id) if cells else None
        if table is None:
            return None
        chosen = F.lit(False)
        for c in cells:
            chosen = chosen | ((F.col("bucket") == c["bucket"]) & F.col("batch_id").between(c["first_batch"], c["last_batch"]))
        return table.where(chosen).select("id")

    def unseen(self, rows: DataFrame, batch_id: int, key: str = "event_id") -> DataFrame:
        """The rows whose id no earlier batch stored."""
        suspects = cut_lineage(self.suspects(rows, batch_id, key))
        stored = self.stored(suspects, batch_id)
        if stored is None:
            return rows
        repeats = stored.join(suspects.select("id").distinct(), "id", "left_semi").select(F.col("id").alias(key)).distinct()
        return rows.join(repeats, key, "left_anti")

    def store(self, rows: DataFrame, batch_id: int, key: str = "event_id") -> None:
        """Add the ids of rows that `unseen` let through."""
        for path in (self.ids, self.open, self.closed):
            drop_batch(self.spark, path, batch_id)
        keyed = cut_lineage(self._keyed(rows.select(key).distinct(), key).repartition("bucket"))
        if keyed.isEmpty():
            return
        keyed.select("id", "bucket", F.lit(batch_id).alias("batch_id")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(self.ids)
        opened, _ = self._filters(batch_id)
        capacity = self.capacity

        def grow(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            out = filters.to_dict("records")
            if len(ids):
                # A batch is stored whole in one generation; a filter is made as large as its first batch needs.
                if not out or out[-1]["ids"] >= capacity:
                    last = out[-1]["generation"] if out else -1
                    size = max(capacity, len(ids)) * BITS // 8
                    out.append({"bucket": int(ids["bucket"].iloc[0]), "generation": last + 1, "first_batch": batch_id, "last_batch": batch_id, "ids": 0, "bits": bytes(size)})
                new = out[-1]
                new["bits"] = with_ids(new["bits"], places(ids["first"].to_numpy(), ids["second"].to_numpy(), len(new["bits"]) * 8))
                new["ids"], new["last_batch"] = new["ids"] + len(ids), batch_id
            return pd.DataFrame(out, columns=[c.split()[0] for c in FILTER.split(", ")])

        grown = cut_lineage(keyed.groupBy("bucket").cogroup(opened.groupBy("bucket")).applyInPandas(grow, FILTER))
        newest = grown.groupBy(F.col("bucket").alias("b")).agg(F.max("generation").alias("g"))
        full = grown.join(newest, (F.col("bucket") == F.col("b")) & (F.col("generation") < F.col("g")), "left_semi")
        if not full.isEmpty():
            write_batch(full, self.closed, batch_id)
        write_batch(grown.join(newest, (F.col("bucket") == F.col("b")) & (F.col("generation") == F.col("g")), "left_semi"), self.open, batch_id)
        # Versions before the last one serve no replay any more.
        for old in read_table(self.spark, self.open, batch_id).select("batch_id").distinct().orderBy(F.desc("batch_id")).collect()[1:]:
            drop_batch(self.spark, self.open, old[0])

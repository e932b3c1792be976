"""Bounded labelled samples and their split by a checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import write_table

MAX_LABELLED = 40_000  # labelled rows that a classifier is fitted on at most, chosen by a digest of the id


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return (F.crc32(id_.cast("string")) % 5).cast("int")


def labelled_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", folds: tuple[int, ...] = (1, 2, 3, 4), most: int = MAX_LABELLED) -> DataFrame:
    """(label_id, label, fold): one row per id with a label of 0 or 1 in the given folds, `most` rows at most.

    Of contradicting labels of one id the larger counts; null ids and labels are left out.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    usable = usable.withColumn("fold", fold(F.col("label_id"))).filter(F.col("fold").isin(*folds))
    return write_table(usable.orderBy(F.xxhash64("label_id"), "label_id").limit(most), "labelled")

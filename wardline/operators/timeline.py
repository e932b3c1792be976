"""Running totals over keyed timelines that do not depend on how evenly keys are spread.

A window partitioned by key alone puts every row of a hot entity, address or organisation into one
task. Everything here partitions by (key, time slot) instead. Totals of earlier slots come from a
pre-aggregated table with one row per key and slot, so the largest task is one slot of one key.
All frames start at the beginning of their partition, which Spark evaluates in one pass; a sliding
frame would be recomputed for each row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import DAY, floor_div
from wardline.session import cut_lineage, work_folder

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.coalesce(left, right * 0) + F.coalesce(right, left * 0)
    return F.greatest(left, right) if how == "max" else F.least(left, right)


def running_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                   measures: Mapping[str, str], slot: str | None = None, width: int = DAY,
                   strict: bool = False, prefix: str = "prior_") -> DataFrame:
    """For each row, totals of `measures` over the earlier rows of its key.

    `measures` maps a column to sum, max or min. With `strict` only rows with a smaller first order
    column count, so equal timestamps do not see each other. The first order column is `us` unless
    the caller supplies its own monotone `slot` column.
    """
    keys = list(keys)
    if slot is None:
        slot = "_slot"
        rows = rows.withColumn(slot, floor_div(order[0], width))
    inside = Window.partitionBy(*keys, slot).orderBy(*(order[:1] if strict else order))
    inside = (inside.rangeBetween(Window.unboundedPreceding, -1) if strict
              else inside.rowsBetween(Window.unboundedPreceding, -1))
    across = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)

    carry = rows.groupBy(*keys, slot).agg(*[_COMBINE[how](m).alias(m) for m, how in measures.items()])
    carry = carry.select(*keys, slot, *[_COMBINE[how](m).over(across).alias("_c_" + m)
                                        for m, how in measures.items()])
    local = rows.select("*", *[_COMBINE[how](m).over(inside).alias("_l_" + m) for m, how in measures.items()])
    joined = local.join(carry, [*keys, slot])
    kept = [c for c in rows.columns if c != "_slot"]
    totals = []
    for m, how in measures.items():
        value = _merge(how, F.col("_l_" + m), F.col("_c_" + m))
        if how == "sum":
            value = F.coalesce(value, F.lit(0))
        totals.append(value.alias(prefix + m))
    return joined.select(*kept, *totals)


def ranged_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[str], prefix: str = "prior_", total: str = "all_") -> DataFrame:
    """For each row the sums of `measures` over the earlier rows of its key (`prefix`) and over all of them (`total`).

    Rows are range-partitioned by key and order, so partitions are even whatever the values; the second pass adds
    up one row per partition and key, which is broadcast. `order` must be unique within a key.
    """
    keys = list(keys)
    ranged = cut_lineage(cut_lineage(rows).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys)
    carry = ranged.groupBy("_part", *keys).agg(*[F.sum(m).alias(m) for m in measures]).select(
        F.col("_part").alias("_p"), *[F.col(k).alias("_k_" + k) for k in keys],
        *[F.coalesce(F.sum(m).over(across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c_" + m) for m in measures],
        *[F.sum(m).over(across).alias(total + m) for m in measures])
    local = ranged.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias("_l_" + m) for m in measures])
    joined = local.join(F.broadcast(carry), [local["_part"] == carry["_p"], *[local[k].eqNullSafe(carry["_k_" + k]) for k in keys]])
    return joined.select(*rows.columns, *[(F.col("_l_" + m) + F.col("_c_" + m)).alias(prefix + m) for m in measures], *[total + m for m in measures])


def position_index(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
                   slot: str | None = None, width: int = DAY) -> DataFrame:
    """Number the rows of each key from 1 in total order."""
    counted = running_before(rows.withColumn("_one", F.lit(1).cast("long")), keys, order,
                             {"_one": "sum"}, slot=slot, width=width, prefix="_n")
    return counted.withColumn(name, F.col("_n_one").cast("long") + 1).drop("_one", "_n_one")


def dealt_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: str, how: str, salts: Column | int = 16, table_salts: Column | int | None = None) -> DataFrame:
    """Join on `keys` whose rows of one key are dealt over `salts` tasks by the digest of `by`.

    `table` holds few rows per key and is repeated once per salt. What follows may group by a part of the keys: a join
    on the keys alone would be taken as its partitioning, and a whole key would stay in one task.
    """
    number = F.lit(salts) if isinstance(salts, int) else salts
    copies = number if table_salts is None else table_salts
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), number).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


SENT_KEYS = 200_000  # keys that a semi-join sends to every task, a few dozen bytes each


def few_keys(wanted: DataFrame) -> bool:
    return wanted.limit(SENT_KEYS + 1).count() <= SENT_KEYS


def sliced(rows: DataFrame, position: str, chunk: int, keys: Sequence[str]) -> Iterator[DataFrame]:
    """Rows whose `position` (from 1) lies in the first `chunk`, the second and so on, for replays in rounds.

    They are written once with a folder per chunk, so all rounds together read each row once.
    """
    folder = work_folder(rows.sparkSession, "chunks")
    placed = rows.withColumn("_chunk", F.floor((F.col(position) - 1) / chunk))
    placed.repartition("_chunk", *keys).write.partitionBy("_chunk").parquet(folder)
    written = rows.sparkSession.read.schema(placed.schema).parquet(folder)
    for number in range((written.agg(F.max("_chunk")).first()[0] or 0) + 1):
        yield written.where(F.col("_chunk") == number).drop("_chunk")


def covering_totals(probes: DataFrame, spans: DataFrame, keys: Sequence[str],
                    measures: Sequence[str], width: int) -> DataFrame:
    """For each probe (keys, us), sum the measures of spans with `start < us <= stop`.

    A span is cut at slot borders: it enters each slot it touches and leaves in its last one. The
    spans covering a probe are then a running sum of signed entries within one slot.
    """
    keys = list(keys)
    base = F.col("_slot") * F.lit(width)
    last = floor_div("stop", width)
    pieces = (spans.where(F.col("stop") > F.col("start"))
              .withColumn("_slot", F.explode(F.sequence(floor_div("start", width), last))))
    enter = F.struct(F.greatest(F.col("start"), base - 1).alias("us"), F.lit(1).alias("sign"))
    leave = F.struct(F.col("stop").alias("us"), F.lit(-1).alias("sign"))
    edges = pieces.select(*keys, "_slot", *measures, F.explode(
        F.when(F.col("_slot") == last, F.array(enter, leave)).otherwise(F.array(enter))).alias("_e"))
    edges = edges.select(*keys, "_slot", F.col("_e.us").alias("us"), F.lit(1).alias("_phase"),
                         *[(F.col(m) * F.col("_e.sign")).alias(m) for m in measures])
    marked = (probes.withColumn("_slot", floor_div("us", width)).withColumn("_phase", F.lit(0)))
    # At equal times a probe comes before every entry and exit, so starts are exclusive and stops inclusive.
    window = (Window.partitionBy(*keys, "_slot").orderBy("us", "_phase")
              .rowsBetween(Window.unboundedPreceding, -1))
    combined = marked.unionByName(edges, allowMissingColumns=True)
    summed = combined.select("*", *[F.coalesce(F.sum(m).over(window), F.lit(0)).alias("in_" + m)
                                    for m in measures])
    return summed.where("_phase = 0").select(*probes.columns, *["in_" + m for m in measures])


def previous_within(rows: DataFrame, keys: Sequence[str], reach: int, width: int | None = None) -> DataFrame:
    """Add `prev_us` (previous row of the key) and `earlier_us` (latest strictly earlier one).

    Rows further back than `reach` need not be found, so a row is also shown to the next slot
    only when it lies within reach of the border.
    """
    width = width or 4 * reach
    if width < reach:
        raise ValueError("slots must be at least as wide as the reach")
    own = floor_div("us", width)
    crosses = floor_div(F.col("us") + reach, width) > own
    spread = rows.withColumn("_slot", F.explode(F.when(crosses, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(*keys, "_slot").orderBy("us")
    found = spread.select(
        "*", F.lag("us").over(window).alias("prev_us"),
        F.max("us").over(window.rangeBetween(Window.unboundedPreceding, -1)).alias("earlier_us"))
    return found.where(F.col("_slot") == own).drop("_slot")


def last_rows(rows: DataFrame, keys: Sequence[str], count: int, payload: Column, name: str,
              position: str = "position", chunk: int = 4096) -> DataFrame:
    """Collect the payload of the `count` preceding rows of the key, oldest first.

    Rows are cut into chunks by position and the last `count` of each chunk are repeated at the head
    of the next one, so a task holds at most one chunk of one key.
    """
    chunk = max(chunk, count)
    own = F.floor((F.col(position) - 1) / chunk)
    ahead = F.floor((F.col(position) - 1 + count) / chunk)
    spread = (rows.withColumn("_pay", payload)
              .withColumn("_chunk", F.explode(F.when(ahead > own, F.array(own, own + 1)).otherwise(F.array(own)))))
    window = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(-count, -1)
    return (spread.withColumn(name, F.collect_list("_pay").over(window))
            .where(F.col("_chunk") == own).drop("_chunk", "_pay"))

"""Exact quantiles without a single collecting task, and the robust scaler built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.timeline import running_before
from wardline.session import cut_lineage

# Width between the 10th and the 90th percentile of a unit normal distribution.
UNIT_RANGE = 2.5631031310892007
SLOTS = 16_384
COARSE = 256  # slots of the first of two passes


def value_slot(value) -> Column:
    """Order-preserving slot of a double, finest around zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(F.asinh(value.cast("double")) * SLOTS).cast("long")


def unpivot(df: DataFrame, columns, ids=()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*ids, F.explode(pairs).alias("_p")).select(*ids, "_p.name", "_p.value")


def long_quantiles(values: DataFrame, fractions, keys=("name",), value: str = "value") -> DataFrame:
    """Linear-interpolation quantiles per key, as `count` and `q0`, `q1`, ...

    Values are counted per distinct value first, ranked through ordered slots, and the two
    neighbours of each quantile are picked by rank, so no group is gathered anywhere.
    """
    keys = list(keys)
    counts = cut_lineage(values.where(F.col(value).isNotNull()).groupBy(*keys, value)
                         .agg(F.count("*").alias("n")).withColumn("slot", value_slot(value)))
    ranked = running_before(counts, keys, [value], {"n": "sum"}, slot="slot", prefix="below_")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("count"))
    return _picked(ranked.join(totals, keys), fractions, keys, value)


def _place(fraction) -> Column:
    return (F.col("count") - 1) * F.lit(float(fraction))


def _picked(placed: DataFrame, fractions, keys: list[str], value: str) -> DataFrame:
    """Quantiles from values with their number `n`, the number of rows below (`below_n`) and of all rows of the key (`count`)."""
    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below_n") <= rank) & (rank < F.col("below_n") + F.col("n")), F.col(value)))

    picks = []
    for i, q in enumerate(fractions):
        place = _place(q)
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    picked = placed.groupBy(*keys).agg(F.max("count").alias("count"), *picks)
    result = []
    for i, q in enumerate(fractions):
        place = _place(q)
        share = place - F.floor(place)
        result.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(f"q{i}"))
    return picked.select(*keys, "count", *result)


def column_quantiles(rows: DataFrame, columns, fractions) -> DataFrame:
    """The `long_quantiles` of some columns of a stored table, in two passes that shuffle little.

    The first pass counts rows per coarse slot of a column. The second counts and ranks only the values of the slots
    that hold a wanted rank, two at most per column and fraction.
    """
    values = unpivot(rows, columns).where("value IS NOT NULL").withColumn("part", F.floor(F.asinh("value") * COARSE).cast("long"))
    parts = cut_lineage(values.groupBy("name", "part").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.withColumn("begin", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        parts.groupBy("name").agg(F.sum("n").alias("count")), "name")
    ranks = F.array(*[rank(_place(q)) for q in fractions for rank in (F.floor, F.ceil)])
    wanted = begun.where(F.exists(ranks, lambda r: (F.col("begin") <= r) & (r < F.col("begin") + F.col("n")))).drop("n")
    counts = cut_lineage(values.join(F.broadcast(wanted), ["name", "part"]).groupBy("name", "part", "begin", "count", "value")
                         .agg(F.count("*").alias("n")).withColumn("slot", value_slot("value")))
    ranked = running_before(counts, ["name", "part"], ["value"], {"n": "sum"}, slot="slot", prefix="within_")
    return _picked(ranked.withColumn("below_n", F.col("begin") + F.col("within_n")), fractions, ["name"], "value")


def fit_scaler(normal_rows: DataFrame, columns, stored: bool = False) -> DataFrame:
    """Median and unit-normal scale per column; a zero range counts as one. `stored` rows are cheap to read twice."""
    q = column_quantiles(normal_rows, columns, (.1, .5, .9)) if stored else long_quantiles(unpivot(normal_rows, columns), (.1, .5, .9))
    spread = F.col("q2") - F.col("q0")
    scale = F.when(spread == 0, F.lit(1.0)).otherwise(spread) / F.lit(UNIT_RANGE)
    return q.select("name", F.col("q1").alias("center"), scale.alias("scale"))


def scaler_parameters(fitted: DataFrame) -> dict[str, tuple[float, float]]:
    """One row per feature, so this is a few dozen numbers."""
    return {r["name"]: (r["center"], r["scale"]) for r in fitted.collect()}


def apply_scaler(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    scaled = [((F.col(c) - F.lit(parameters[c][0])) / F.lit(parameters[c][1])).alias(c) for c in parameters]
    return df.select(*[c for c in df.columns if c not in parameters], *scaled)


def scaled_long(values: DataFrame, fitted: DataFrame) -> DataFrame:
    """Scale (id, name, value) rows; the parameter side has one row per feature name."""
    return values.join(F.broadcast(fitted), "name").withColumn("value", (F.col("value") - F.col("center")) / F.col("scale")).drop("center", "scale")

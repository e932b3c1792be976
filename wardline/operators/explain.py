"""Evidence behind a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalar import number, python_round
from wardline.schema import UNIT_BASELINE_FEATURES


def feature_evidence(values: dict[str, str], scaled: dict[str, str]) -> Column:
    """Value, resting value and absolute scaled deviation of each feature, as an array of structs."""
    return F.array(*[F.struct(
        F.lit(n).alias("feature"), number(values[n]).alias("value"),
        F.lit(1.0 if n in UNIT_BASELINE_FEATURES else 0.0).alias("baseline"), F.abs(number(scaled[n])).alias("deviation"))
        for n in values])


def contributions(df: DataFrame, names: list[str], scaled: dict[str, str], importances: dict[str, float] | None = None,
                  limit: int = 4, name: str = "top_features") -> DataFrame:
    """Features with the largest `abs(scaled) * (.5 + importance / max importance)`; ties go to the later one.

    The candidates of one event are a fixed-size array, so they are sorted in place.
    """
    importances = importances or {n: 1.0 for n in names}
    largest = max(max(importances.values()), 1e-9)
    items = F.array(*[F.struct(
        (F.abs(number(scaled[n])) * F.lit(.5 + importances[n] / largest)).alias("strength"), F.lit(i).alias("place"),
        F.lit(n).alias("feature"), number(n).alias("value"), F.abs(number(scaled[n])).alias("deviation"))
        for i, n in enumerate(names)])
    return df.withColumn(name, F.slice(F.sort_array(items, False), 1, limit))


def sentence(items, kind, cold) -> Column:
    """Explanation text from the first three contributions."""
    parts = F.transform(F.slice(items, 1, 3), lambda x: F.concat(
        F.replace(x["feature"], F.lit("_"), F.lit(" ")), F.lit(" was "), F.format_string("%.2f", python_round(x["value"], 2))))
    prefix = F.when(cold, F.lit("Cold-start scoring used a peer/global baseline. ")).otherwise(F.lit(""))
    return F.concat(prefix, F.lit("Risk increased because "), F.array_join(parts, ", "), F.lit(" relative to the "), kind,
                    F.lit(" behavioral baseline."))

"""Arithmetic between model outputs and risk: ranges, blends, calibration, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalar import clip, col, number
from wardline.operators.scaling import long_quantiles
from wardline.operators.timeline import last_rows, position_index
from wardline.schema import ATTACKS


def score_range(rows: DataFrame, column: str, low: float = .02, high: float = .995) -> DataFrame:
    """One row with the two quantiles that bound normalisation."""
    values = rows.select(F.lit(column).alias("name"), F.col(column).cast("double").alias("value"))
    return long_quantiles(values, (low, high)).select(F.col("q0").alias("low"), F.col("q1").alias("high"))


def normalise(value, low, high, mode: str = "linear_clip") -> Column:
    relative = F.greatest(F.lit(0.0), (number(value) - low) / F.greatest(high - low, F.lit(1e-9)))
    if mode == "bounded_exp":
        return 1 - F.exp(-relative)
    if mode != "linear_clip":
        raise ValueError(f"unknown normalisation {mode}")
    return F.least(F.lit(1.0), relative)


def normalised(df: DataFrame, column: str, bounds: DataFrame, mode: str = "linear_clip", name: str = "value") -> DataFrame:
    """Normalise against a one-row range."""
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, normalise(column, F.col("low"), F.col("high"), mode)).drop("low", "high")


def ensemble(whole, domains) -> Column:
    columns = [number(c) for c in domains]
    mean = sum(columns[1:], columns[0]) / float(len(columns))
    return clip(F.lit(.35) * number(whole) + F.lit(.45) * F.greatest(*columns) + F.lit(.20) * mean, 0, 1)


def class_weights(rows: DataFrame, label: str = "label", low: float = .2, high: float = 12.0) -> DataFrame:
    """Balanced weights, and square-root weights tempered to mean one and clipped."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    raw = F.sqrt(F.col("total") / F.col("classes") / F.col("n"))
    w = counts.crossJoin(F.broadcast(totals)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("balanced"), raw.alias("raw"))
    mean = w.agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("mean_raw"))
    return w.crossJoin(F.broadcast(mean)).withColumn("tempered", clip(F.col("raw") / F.col("mean_raw"), low, high)).drop("raw", "mean_raw")


def calibrated_map(raw: dict[str, Column], calibrators: dict[str, tuple[float, float] | None]) -> Column:
    """Sigmoid per class (slope, intercept), pass-through where none was fitted, then rows sum to one."""
    values = {}
    for name, p in raw.items():
        fitted = calibrators.get(name)
        values[name] = p if fitted is None else 1 / (1 + F.exp(-(F.lit(fitted[0]) * p + F.lit(fitted[1]))))
    return F.map_from_arrays(F.array(*[F.lit(n) for n in values]), shares(F.array(*values.values())))


def shares(values: Column) -> Column:
    """Divide an array by its sum (at least 1e-12); the one-element array evaluates the input once."""
    def divide(held: Column) -> Column:
        total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
        return F.transform(held, lambda x: x / F.greatest(total, F.lit(1e-12)))

    return F.element_at(F.transform(F.array(values), divide), 1)


def attack_probabilities(probabilities) -> Column:
    """Probabilities of the six attack classes in contract order; a class the model lacks counts zero."""
    return F.array(*[F.coalesce(col(probabilities)[a], F.lit(0.0)) for a in ATTACKS])


def enriched(scaled, domains, attacks) -> Column:
    return F.concat(col(scaled), col(domains), col(attacks))


def entity_sequences(rows: DataFrame, payload: Column, window: int, entity: str = "entity_id", name: str = "sequence",
                     order=("us", "event_id"), chunk: int = 4096, width: int | None = None) -> DataFrame:
    """The last `window` payloads of the entity before each row, oldest first."""
    options = {} if width is None else {"width": width}
    numbered = position_index(rows, [entity], list(order), "position", **options)
    return last_rows(numbered, [entity], window, payload, name, chunk=chunk)


def top_residual(predicted, observed, count: int) -> Column:
    gaps = F.zip_with(col(predicted), col(observed), lambda a, b: F.abs(a - b))
    best = F.slice(F.sort_array(gaps, False), 1, max(count, 1))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)


def best_candidate(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("macro_f1"), F.desc("malicious_pr_auc"), "candidate").limit(1)


def training_population(rows: DataFrame) -> DataFrame:
    hit = F.col("label") != "normal"
    return rows.agg(F.count("*").alias("total_rows"), F.count_if(~hit).alias("normal_rows"), F.count_if(hit).alias("attack_rows"))

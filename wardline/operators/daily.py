"""Entity-day roll-ups, identity ranking and the daily evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import utc_day
from wardline.operators.evaluate import attack, count_of, ranking_quality, ratio, tuned_threshold
from wardline.operators.scaling import long_quantiles, unpivot
from wardline.operators.timeline import position_index

GROUP = ["entity_id", "day"]
HORIZON = 30
# Above this many events a day of one entity is ranked across tasks instead of inside one.
CROWDED_DAY = 50_000


def daily_rollup(events: DataFrame, columns, crowded: int = CROWDED_DAY) -> DataFrame:
    """95th percentile of each column, event count and day label per entity and UTC day.

    `percentile` keeps the distinct values of a group in memory. That is right for ordinary days;
    crowded ones, found by a count first, take the distributed quantile.
    """
    columns = list(columns)
    rows = events.withColumn("day", utc_day("us"))
    attacked = F.col("label") != "normal"
    summary = rows.groupBy(*GROUP).agg(
        F.count("*").alias("event_count"),
        F.min(F.when(attacked, F.struct("us", "event_id", "label")))["label"].alias("_attack"))
    summary = summary.withColumn("label", F.coalesce("_attack", F.lit("normal"))).drop("_attack")
    busy = summary.where(F.col("event_count") > crowded).select(*GROUP)
    calm = rows.join(busy, GROUP, "left_anti").groupBy(*GROUP).agg(
        *[F.percentile(F.col(c).cast("double"), F.lit(.95)).alias(c) for c in columns])
    tall = long_quantiles(unpivot(rows.join(busy, GROUP, "left_semi"), columns, GROUP), (.95,), (*GROUP, "name"))
    wide = tall.groupBy(*GROUP).agg(*[F.max(F.when(F.col("name") == c, F.col("q0"))).alias(c) for c in columns])
    return calm.unionByName(wide).join(summary, GROUP)


def latest_days(daily: DataFrame, horizon: int = HORIZON) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("day")))
    return daily.withColumn("back", rank).where(F.col("back") <= horizon)


def identity_ranking(daily: DataFrame, threshold: float, horizon: int = HORIZON) -> DataFrame:
    """Rank identities on their latest observed days.

    Each identity contributes at most `horizon` rows, so its newest-first score list is small.
    """
    last = daily.agg(F.max("day").alias("latest_day"))
    recent = latest_days(daily, horizon)
    flagged = F.col("score") >= threshold
    per = recent.groupBy("entity_id").agg(
        F.max("score").alias("maximum_drift_30d"), F.count_if(flagged).alias("drift_days_30d"),
        F.max(F.when(flagged, F.col("day"))).alias("last_drift_date"),
        F.sort_array(F.collect_list("score"), False).alias("_scores"),
        F.min(F.when(~flagged, F.col("back"))).alias("_first_calm"), F.count("*").alias("_days"),
        F.max_by("score", "day").alias("latest_score"), F.max((F.col("label") != "normal").cast("int")).alias("_hit"))
    top = F.slice("_scores", 1, 3)
    mean_top = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    days = F.datediff("latest_day", "last_drift_date")
    recency = F.when(F.col("last_drift_date").isNull(), F.lit(0.0)).otherwise(F.exp(-days / 7.0))
    rated = per.join(F.broadcast(last)).select(
        "entity_id", "maximum_drift_30d", "drift_days_30d",
        (F.coalesce("_first_calm", F.col("_days") + 1) - 1).cast("long").alias("consecutive_drift_days"),
        mean_top.alias("mean_top_3_drift"), "last_drift_date", "latest_score", (F.col("_hit") == 1).alias("has_attack"),
        (100 * (.60 * F.col("maximum_drift_30d") + .25 * F.least(F.col("drift_days_30d") / 7.0, F.lit(1.0))
                + .10 * mean_top + .05 * recency)).alias("rank_score"))
    ordered = rated.select("*", (-F.col("rank_score")).alias("_a"), (-F.col("maximum_drift_30d")).alias("_b"),
                           (-F.col("drift_days_30d")).alias("_c"), F.lit(0).alias("_all"),
                           F.floor(-F.col("rank_score") * 1000).cast("long").alias("_sl"))
    return position_index(ordered, ["_all"], ["_a", "_b", "_c", "entity_id"], "rank", slot="_sl").drop("_a", "_b", "_c", "_all", "_sl")


def daily_threshold(daily: DataFrame, max_normal_fpr: float = .01) -> DataFrame:
    return tuned_threshold(daily, "score", max_normal_fpr, fallback=1.0)


def daily_evaluation(daily: DataFrame, threshold: float) -> DataFrame:
    """One row of day-level metrics and ranking precision on the same horizon."""
    flagged, hit = F.col("score") >= threshold, attack()
    tp, fp = count_of(hit & flagged), count_of(~hit & flagged)
    days = daily.agg(
        F.count("*").alias("daily_count"), F.avg(hit.cast("double")).alias("attack_day_prevalence"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, count_of(hit)).alias("recall"),
        ratio(fp, count_of(~hit)).alias("false_positive_rate"))
    ranked = identity_ranking(daily, threshold)
    size = ranked.agg(F.count("*").alias("ranked_entity_count"))
    placed = ranked.crossJoin(F.broadcast(size))
    one_percent = F.greatest(F.lit(1), F.ceil(F.col("ranked_entity_count") * .01))
    top_ten = F.least(F.lit(10), F.col("ranked_entity_count"))
    hits = F.col("has_attack").cast("long")
    entities = placed.groupBy("ranked_entity_count").agg(
        F.sum(hits).alias("attacked_entity_count"),
        (F.sum(F.when(F.col("rank") <= one_percent, hits)) / F.max(one_percent)).alias("top_1_percent_precision"),
        (F.sum(F.when(F.col("rank") <= top_ten, hits)) / F.max(top_ten)).alias("top_10_precision"),
        F.sum(F.when(F.col("rank") <= top_ten, hits)).alias("_ten"))
    entities = entities.withColumn("top_10_recall", ratio(F.col("_ten"), F.col("attacked_entity_count"))).drop("_ten")
    # Each side is one row.
    return days.crossJoin(F.broadcast(ranking_quality(daily, "score", hit))).crossJoin(F.broadcast(entities))


def entity_history(daily: DataFrame, ranking: DataFrame, entity: str, threshold: float) -> DataFrame:
    days = daily.where(F.col("entity_id") == entity).select(
        "entity_id", "day", "score", (F.col("score") >= threshold).alias("is_drift_day"), "event_count")
    return days.join(ranking.select("entity_id", "rank", "rank_score"), "entity_id", "left")

"""Concept-drift monitoring of trusted signals over count-based blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalar import HOUR, circular_hours
from wardline.operators.drift_replay import REVIEW_RESULTS, START, replay
from wardline.operators.timeline import position_index, sliced
from wardline.schema import RECOMMENDATIONS, SIGNALS
from wardline.session import cut_lineage


@dataclass(frozen=True)
class DriftPolicy:
    block: int = 20
    effect: float = 2.5
    ks: float = .55


SERIES = ["subject", "feature"]


def monitored_values(trusted: DataFrame, subject: str = "entity_id") -> DataFrame:
    """Each trusted event's signals as rows, numbered within the subject; absent signals count as zero.

    All signals of an event share its number, so events are numbered before they are unpivoted.
    """
    have = set(trusted.columns)
    rows = trusted.select(F.col(subject).alias("subject"), "us", "event_id",
                          *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in SIGNALS if s in have])
    numbered = position_index(rows, ["subject"], ["us", "event_id"], "seq", width=HOUR)
    pairs = F.array(*[F.struct(F.lit(s).alias("feature"), (F.col(s) if s in have else F.lit(0.0)).alias("value")) for s in SIGNALS])
    return numbered.select("subject", "us", "event_id", "seq", F.explode(pairs).alias("p")).select(
        "subject", "us", "event_id", "seq", "p.*")


def circular_mean(values: Column) -> Column:
    turn = F.lit(2 * math.pi / 24)
    n = F.size(values)
    east = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.cos(v * turn)) / n
    north = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.sin(v * turn)) / n
    full = F.lit(2 * math.pi)
    return F.pmod(F.atan2(north, east), full) / full * 24


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _spread(values: Column, center: Column, hours: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.pow(
        F.when(hours, circular_hours(v, center)).otherwise(v - center), F.lit(2.0)))
    return F.sqrt(squares / F.size(values))


def block_summaries(values: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """Each block of observations with its sorted values, centre and spread (at most `block` values)."""
    block = F.floor((F.col("seq") - 1) / policy.block)
    grouped = values.groupBy(*SERIES, block.alias("block")).agg(
        F.sort_array(F.collect_list("value")).alias("values"), F.count("*").alias("n"),
        F.max("us").alias("last_us"), F.max_by("event_id", "seq").alias("last_event_id"), F.max("seq").alias("last_seq"))
    hours = F.col("feature") == "access_hour"
    centered = grouped.withColumn("mean", F.when(hours, circular_mean(F.col("values"))).otherwise(_mean(F.col("values"))))
    return centered.withColumn("std", _spread(F.col("values"), F.col("mean"), hours))


def distribution(prefix: str = "") -> Column:
    """Mean, deviation, count, extremes and index-picked quantiles of a sorted block."""
    values, n = F.col(prefix + "values"), F.size(prefix + "values")
    at90 = F.least(n - 1, F.floor(n * .9).cast("int"))
    return F.struct(F.col(prefix + "mean").alias("mean"), F.col(prefix + "std").alias("std"), n.alias("count"),
                    F.element_at(values, 1).alias("minimum"), F.element_at(values, -1).alias("maximum"),
                    F.element_at(values, (F.floor(n / 2) + 1).cast("int")).alias("p50"),
                    F.element_at(values, at90 + 1).alias("p90"))


def ks_distance(left, right) -> Column:
    """Largest gap between two empirical distributions; both arrays are bounded by the block size."""
    left, right = F.col(left), F.col(right)

    def share(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= x)) / F.size(values).cast("double")

    return F.array_max(F.transform(F.array_union(left, right), lambda x: F.abs(share(left, x) - share(right, x))))


def compare_blocks(blocks: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """Each full block against the one before it."""
    full = blocks.where(F.col("n") == policy.block)
    before = full.select(*SERIES, (F.col("block") + 1).alias("block"),
                         *[F.col(c).alias("old_" + c) for c in ("values", "mean", "std")])
    floors = F.create_map(*[F.lit(x) for s, (_, f) in SIGNALS.items() for x in (s, f)])
    joined = full.join(before, [*SERIES, "block"]).withColumn("floor", floors[F.col("feature")])
    hours = F.col("feature") == "access_hour"
    shift = F.when(hours, circular_hours("mean", "old_mean")).otherwise(F.abs(F.col("mean") - F.col("old_mean")))
    scale = F.greatest((F.col("std") + F.col("old_std")) / 2, F.col("floor") / policy.effect)
    rated = joined.withColumn("absolute_shift", shift).withColumn("effect_size", F.col("absolute_shift") / scale)
    # The distance is only worth computing where shift and effect already pass.
    rated = rated.withColumn("ks_distance", ks_distance("values", "old_values"))
    return rated.withColumn("significant", (F.col("absolute_shift") >= F.col("floor"))
                            & (F.col("effect_size") >= policy.effect) & (F.col("ks_distance") >= policy.ks))


def confidence(effect="effect_size", ks="ks_distance") -> Column:
    return F.least(F.lit(.999), F.lit(.5) + .28 * (1 - F.exp(-F.col(effect) / 3)) + .2 * F.col(ks))


def drift_severity(effect="effect_size") -> Column:
    return F.when(F.col(effect) >= 6, "critical").when(F.col(effect) >= 4, "high").otherwise("medium")


def recommendation(feature="feature") -> Column:
    return F.create_map(*[F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair])[F.col(feature)]


def findings(compared: DataFrame) -> DataFrame:
    """The first significant block of each series; detection freezes the series after it."""
    # Comparing blocks is the costly part; its few significant rows are read twice.
    compared = cut_lineage(compared.where("significant"))
    first = compared.groupBy(*SERIES).agg(F.min("block").alias("block"))
    domains = F.create_map(*[F.lit(x) for s, (d, _) in SIGNALS.items() for x in (s, d)])
    return compared.join(first, [*SERIES, "block"], "left_semi").select(
        *SERIES, "block", F.col("effect_size").alias("magnitude"), "absolute_shift", "ks_distance",
        confidence().alias("drift_confidence"), drift_severity().alias("severity"), domains[F.col("feature")].alias("domain"),
        recommendation().alias("recommendation"), F.lit("pending").alias("review_status"),
        F.col("block").alias("baseline_version"), F.col("last_us").alias("detected_us"), F.col("last_seq").alias("detected_seq"),
        distribution("old_").alias("previous_distribution"), distribution().alias("current_distribution"))


def series_state(values: DataFrame, found: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """Window of each series without reviews: sizes, status, version and observations until a freeze."""
    totals = values.groupBy(*SERIES).agg(F.max("seq").alias("seen"), F.max("us").alias("last_us"))
    joined = totals.join(found.select(*SERIES, "detected_seq", F.col("block").alias("frozen_at"), "detected_us"), SERIES, "left")
    frozen, size = F.col("detected_seq").isNotNull(), policy.block
    used = F.coalesce("detected_seq", "seen")
    reference = F.least(used, F.lit(size))
    current = F.when(frozen, F.lit(size)).otherwise(F.when(used >= size, used % size).otherwise(0))
    version = F.when(frozen, F.col("frozen_at")).otherwise(F.greatest(F.floor(used / size), F.lit(1)))
    status = (F.when(frozen, "pending_review").when(used < size, "collecting_reference").otherwise("collecting_current"))
    return joined.select(*SERIES, reference.cast("long").alias("reference_count"), current.cast("long").alias("current_count"),
                         status.alias("status"), version.cast("long").alias("baseline_version"), used.alias("trusted_observations"),
                         F.coalesce("detected_us", "last_us").alias("last_observed_us"))


def window_status(state: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    flagged = F.array_sort(F.collect_list(F.when(F.col("status") == "pending_review", F.col("feature"))))
    grouped = state.groupBy("subject").agg(
        F.min("reference_count").alias("reference_count"), F.min("current_count").alias("current_count"),
        flagged.alias("flagged_features"), F.max("baseline_version").alias("baseline_version"),
        F.max("last_observed_us").alias("last_observed_us"), F.max("trusted_observations").alias("trusted_events"))
    status = (F.when(F.size("flagged_features") > 0, "review_required")
              .when(F.col("reference_count") < policy.block, "collecting_reference")
              .when(F.col("current_count") < policy.block, "collecting_current").otherwise("monitoring"))
    return grouped.withColumn("status", status)


def drift_summary(status: DataFrame, found: DataFrame) -> DataFrame:
    windows = status.agg(F.count("*").alias("monitored_entities"), F.coalesce(F.sum("trusted_events"), F.lit(0)).cast("long").alias("trusted_events"),
                         F.count_if(F.col("status").startswith("collecting")).alias("_collecting"))
    review = F.col("review_status")
    counts = found.agg(F.count_if(review.isin("pending", "investigating")).alias("pending_reviews"),
                       F.count_if(review == "approved_adaptation").alias("approved_adaptations"),
                       F.count_if(review == "rejected_change").alias("rejected_changes"))
    state = F.when(F.col("pending_reviews") > 0, "action_required").when(F.col("_collecting") > 0, "learning").otherwise("stable")
    return windows.crossJoin(counts).select("monitored_entities", "trusted_events", "pending_reviews", "approved_adaptations",
                                            "rejected_changes", F.lit(len(SIGNALS)).alias("signals_monitored"), state.alias("state"))


def reviewed(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with their review status: the first final review stands, later ones are ignored."""
    ranked = reviews.withColumn("outcome", F.create_map(*[F.lit(x) for p in REVIEW_RESULTS.items() for x in p])[F.col("action")])
    final = F.col("action") != "investigate"
    status = ranked.groupBy(*SERIES).agg(
        F.min_by("outcome", F.when(final, F.col("created_us"))).alias("_final"),
        F.max((~final).cast("int")).alias("_looked"),
        F.array_sort(F.collect_list(F.struct("created_us", "action", "analyst", "comment"))).alias("review_history"))
    joined = found.drop("review_status").join(status, SERIES, "left")
    return joined.select(*[c for c in joined.columns if c not in ("_final", "_looked")], F.coalesce(
        "_final", F.when(F.col("_looked") == 1, F.lit("investigating")), F.lit("pending")).alias("review_status"))


def newest_findings(found: DataFrame, limit: int = 100) -> DataFrame:
    return found.orderBy(F.desc("detected_us"), "subject", "feature").limit(limit)


def detector_quality(found: DataFrame, truth: DataFrame, policy: DriftPolicy = DriftPolicy(), feature: str = "access_hour") -> DataFrame:
    """Entity-level precision, recall, stable false-positive rate and mean delay in events."""
    hits = found.where(F.col("feature") == feature).select("subject", "detected_seq")
    joined = truth.join(hits, "subject", "left")
    drifted, caught = F.col("drifted"), F.col("detected_seq").isNotNull()
    tp, fp = F.count_if(drifted & caught), F.count_if(~drifted & caught)
    return joined.agg(
        tp.alias("true_positive_entities"), fp.alias("false_positive_entities"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("entity_precision"), (tp / F.greatest(F.count_if(drifted), F.lit(1))).alias("entity_recall"),
        (fp / F.greatest(F.count_if(~drifted), F.lit(1))).alias("stable_entity_false_positive_rate"),
        F.avg(F.when(drifted & caught, F.col("detected_seq") - policy.block)).alias("mean_detection_delay_events"))


# ---- reviews over a whole log ----------------------------------------------------------------------------

REPLAY = "subject string, feature string, us long, event_id string, status string, baseline_version long, magnitude double, absolute_shift double, ks_distance double, analyst string, kind string"
STATE = "reference array<double>, current array<double>, observed long"
CHUNK = 200_000


def reviewed_log(values: DataFrame, reviews: DataFrame, policy: DriftPolicy = DriftPolicy(), chunk: int = CHUNK) -> DataFrame:
    """Findings and review outcomes of a whole log, equal to the keyed stream of `streaming.drift_state`.

    `values` carries subject, feature, us, event_id and seq (1, 2, .. per series in order of (us, event_id)), `reviews`
    subject, feature, us, action and analyst. At one instant values come before reviews; reviews of one instant are
    ordered by (action, analyst). A finding freezes its series: later values are not learnt until a final review
    (`approve_adaptation`, `reject_change`, `dismiss`) resumes it. Reviews that meet no finding, and unknown actions,
    are refused. Null subjects, features or times take no part; repeated reviews are refused like any other.

    All series are replayed side by side, `chunk` rows of each per round; from one round to the next only two blocks
    of each series are carried. A task holds one chunk of one series, and the number of rounds is the length of the
    longest series by `chunk`, however many reviews there are. Refused reviews carry no status.
    """
    complete = "subject IS NOT NULL AND feature IS NOT NULL AND us IS NOT NULL"
    none = F.lit(None).cast("string")
    rows = values.where(complete).select(*SERIES, "us", F.lit("value").alias("kind"), "seq", "event_id", F.col("value").cast("double").alias("value"),
                                         none.alias("action"), none.alias("analyst"))
    rows = rows.unionByName(reviews.where(complete).select(*SERIES, "us", F.lit("review").alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("event_id"),
                                                           F.lit(None).cast("double").alias("value"), "action", "analyst"))
    # Descending: a value before the reviews of its instant.
    placed = position_index(rows, SERIES, ["us", F.desc("kind"), "seq", "action", "analyst"], width=HOUR)
    schema = f"{REPLAY}, {STATE}"
    names = [f.split()[0] for f in schema.split(", ")]

    def advance(key, part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(part):  # the series has ended
            return pd.DataFrame(columns=names, dtype=object)
        part = part.sort_values("position")
        before = tuple(held.iloc[0][["reference", "current", "status", "baseline_version", "observed", "us"]]) if len(held) else START
        after, out = replay(key[1], before, *[part[c].to_numpy() for c in ("us", "event_id", "kind", "value", "action", "analyst")], policy)
        found = [(*key, us, event, *((None, None) if kind == "refused" else (status, version)), effect, shift, ks, analyst, kind, None, None, None)
                 for kind, us, event, status, version, effect, shift, ks, analyst in out]
        reference, current, status, version, observed, since = after
        state = (*key, since, None, status, version, None, None, None, None, "state", reference, current, observed)
        return pd.DataFrame([*found, state], columns=names, dtype=object)

    held, whole = values.sparkSession.createDataFrame([], schema), None
    for part in sliced(placed, "position", chunk, SERIES):
        done = cut_lineage(part.groupBy(*SERIES).cogroup(held.groupBy(*SERIES)).applyInPandas(advance, schema))
        held, found = done.where("kind = 'state'"), done.where("kind <> 'state'").drop("reference", "current", "observed")
        whole = found if whole is None else whole.unionByName(found)
    return whole

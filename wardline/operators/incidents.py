"""Alert selection, 15-minute incident correlation and the tables analysts work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import bucket_15m, python_round
from wardline.schema import ATTACKS

RESOLVED = ("confirmed_threat", "false_positive", "closed")
OPEN_STATES = ("open", "investigating", "confirmed_threat")
FINAL_REVIEWS = ("approved_adaptation", "rejected_change", "dismissed")


def alerting(scored: DataFrame, threshold: float, digits: int = 2) -> DataFrame:
    """Events at or over the threshold; the live path compares the rounded risk."""
    return scored.where(python_round("risk_score", digits) >= threshold)


def incident_key() -> Column:
    return F.concat_ws(":", "entity_id", "predicted_attack", bucket_15m("us"))


def correlate(alerts: DataFrame, carried=("severity", "classifier_confidence", "event_type", "country", "city",
                                          "destination_host")) -> DataFrame:
    """One incident per entity, class and quarter hour.

    The anchor is the earliest event among those with the highest rounded risk. All parts are plain
    aggregates, so a busy incident is reduced before the shuffle.
    """
    present = [c for c in carried if c in alerts.columns]
    risk = python_round("risk_score", 2)
    best = F.min(F.struct((-risk).alias("minus_risk"), "us", "event_id", *present))
    grouped = alerts.groupBy("entity_id", "predicted_attack", bucket_15m("us").alias("bucket")).agg(
        F.count("*").alias("event_count"), best.alias("anchor"), F.max("us").alias("last_us"), F.min("us").alias("created_us"))
    return grouped.select(
        F.concat_ws(":", "entity_id", "predicted_attack", "bucket").alias("incident_key"), "entity_id", "predicted_attack",
        "bucket", "event_count", (-F.col("anchor.minus_risk")).alias("risk_score"), F.col("anchor.event_id").alias("event_id"),
        F.col("anchor.us").alias("us"), "last_us", "created_us", *[F.col("anchor." + c).alias(c) for c in present])


def merge_incidents(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fold newly correlated incidents into stored ones; an equal risk keeps the earlier anchor."""
    both = stored.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in fresh.columns if c not in ("incident_key", "event_count", "last_us", "created_us")]
    anchor = F.min(F.struct((-F.col("risk_score")).alias("minus_risk"), F.col("us").alias("at"),
                            F.col("event_id").alias("id"), F.struct(*rest).alias("row")))
    merged = both.groupBy("incident_key").agg(
        F.sum("event_count").alias("event_count"), F.max("last_us").alias("last_us"), F.min("created_us").alias("created_us"),
        anchor.alias("a"))
    return merged.select("incident_key", "event_count", "last_us", "created_us", "a.row.*").select(*fresh.columns)


def current_status(incidents: DataFrame, feedback: DataFrame) -> DataFrame:
    """Latest disposition per incident, and whether its anchor event became trusted."""
    latest = feedback.groupBy("incident_key").agg(
        F.max_by("status", F.struct("created_us", "feedback_id")).alias("status"), F.max("created_us").alias("updated_us"),
        F.max((F.col("status") == "false_positive").cast("int")).alias("_fp"), F.count("*").alias("feedback_count"))
    return incidents.join(latest, "incident_key", "left").select(
        *incidents.columns, F.coalesce("status", F.lit("open")).alias("status"),
        F.coalesce("updated_us", "last_us").alias("updated_us"), (F.coalesce("_fp", F.lit(0)) == 1).alias("trusted"),
        F.coalesce("feedback_count", F.lit(0)).cast("long").alias("feedback_count"))


# ---- dimensions ------------------------------------------------------------------------------

def entity_dimension(events: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("entity_type", "user_role", "department"), F.struct("us", "event_id"))
    return events.groupBy("entity_id").agg(F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), latest.alias("l")).select(
        "entity_id", "first_seen", "last_seen", "l.*")


def device_dimension(events: DataFrame) -> DataFrame:
    at = F.struct("us", "event_id")
    return events.groupBy("device_id").agg(
        F.max("us").alias("last_seen"), F.max_by("device_fingerprint", at).alias("device_fingerprint"),
        F.sum(F.col("trusted").cast("long")).alias("trusted_event_count"), F.min_by("entity_id", at).alias("first_owner"))


# ---- queues and feeds ---------------------------------------------------------------------------

def top(df: DataFrame, limit: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def alert_queue(incidents: DataFrame, severity=None, attack=None, entity=None, status=None, limit: int = 100) -> DataFrame:
    for column, wanted in (("severity", severity), ("predicted_attack", attack), ("entity_id", entity), ("status", status)):
        if wanted is not None:
            incidents = incidents.where(F.col(column) == wanted)
    return top(incidents, limit, F.desc("risk_score"), "incident_key")


def latest_per_entity(events: DataFrame, limit: int) -> DataFrame:
    """The newest rows of each entity; tasks drop what cannot qualify before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("us"), F.desc("event_id")))
    return events.withColumn("recency", rank).where(F.col("recency") <= limit)


def alert_timelines(incidents: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    """Every incident with the newest events of its entity."""
    newest = latest_per_entity(events.join(incidents.select("entity_id").distinct(), "entity_id", "left_semi"), limit)
    return incidents.select("incident_key", "entity_id").join(
        newest.select("entity_id", F.col("event_id").alias("timeline_event_id"), F.col("us").alias("timeline_us"), "recency"), "entity_id")


def event_feed(events: DataFrame, predictions: DataFrame, entity=None, event_type=None, limit: int = 100) -> DataFrame:
    if entity is not None:
        events = events.where(F.col("entity_id") == entity)
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    newest = top(events, limit, F.desc("us"), F.desc("event_id"))
    return newest.join(predictions, "event_id", "left")


def search_identities(entities: DataFrame, text: str, limit: int = 20) -> DataFrame:
    pattern = f"%{text}%"
    match = F.col("entity_id").ilike(pattern) | F.col("user_role").ilike(pattern) | F.col("department").ilike(pattern)
    return top(entities.where(match) if text else entities, limit, F.desc("last_seen"), "entity_id")


def entity_timeline(events: DataFrame, predictions: DataFrame, entity: str, limit: int = 100) -> DataFrame:
    return event_feed(events, predictions.select("event_id", "risk_score", "predicted_attack"), entity=entity, limit=limit)


# ---- overview -----------------------------------------------------------------------------------

def overview(incidents: DataFrame, events: DataFrame, as_of_us: int, day_us: int = 86_400_000_000) -> DataFrame:
    """All alert counters in one pass over the incidents."""
    recent = F.col("updated_us") >= as_of_us - day_us
    status = F.col("status")
    reviewed = status.isin(*RESOLVED)
    counters = incidents.agg(
        F.count("*").alias("total_alerts"), F.count_if(status == "open").alias("open_alerts"),
        F.count_if(status == "investigating").alias("investigating_alerts"),
        F.count_if(status.isin(*OPEN_STATES)).alias("unresolved_alerts"), F.count_if(reviewed).alias("reviewed_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        (F.count_if(recent & (status == "false_positive")) / F.greatest(F.count_if(recent & reviewed), F.lit(1)))
        .alias("analyst_false_positive_rate_24h"))
    return counters.crossJoin(events.agg(F.count("*").alias("events_analyzed")))


def average_latency(predictions: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Mean time to score an event over all predictions; zero without any."""
    return predictions.agg(F.coalesce(F.avg(F.col(latency).cast("double")), F.lit(0.0)).alias("average_ms"))


def detections_by_class(incidents: DataFrame) -> DataFrame:
    names = incidents.sparkSession.createDataFrame([(a,) for a in ATTACKS], "predicted_attack string")
    sums = incidents.groupBy("predicted_attack").agg(F.sum("event_count").alias("n"))
    return names.join(sums, "predicted_attack", "left").select(
        "predicted_attack", F.coalesce("n", F.lit(0)).cast("long").alias("detections"))


def risk_trend(predictions: DataFrame, limit: int = 50) -> DataFrame:
    return top(predictions, limit, F.desc("us"), F.desc("event_id")).orderBy("us", "event_id").select("event_id", "us", "risk_score")


def risk_load(predictions: DataFrame, points: int = 20) -> DataFrame:
    """Rounded mean risk of the newest points; halves round up."""
    newest = top(predictions, points, F.desc("us"), F.desc("event_id"))
    return newest.agg(F.floor(F.coalesce(F.avg("risk_score"), F.lit(0.0)) + .5).cast("long").alias("risk_load"))


def notifications(incidents: DataFrame, findings: DataFrame, alerts: int = 5, drifts: int = 3, scanned: int = 20) -> DataFrame:
    """Newest critical incidents, and open findings among the newest ones."""
    critical = top(incidents.where("severity = 'critical'"), alerts, F.desc("created_us"), "incident_key").select(
        F.lit("critical_alert").alias("type"),
        F.concat(F.replace("predicted_attack", F.lit("_"), F.lit(" ")), F.lit(" · "), "entity_id").alias("message"),
        F.col("created_us").alias("created_us"))
    recent = top(findings, scanned, F.desc("detected_us"), "subject", "feature")
    pending = top(recent.where(~F.col("review_status").isin(*FINAL_REVIEWS)), drifts, F.desc("detected_us"), "subject", "feature")
    return critical.unionByName(pending.select(
        F.lit("drift_warning").alias("type"),
        F.concat("subject", F.lit(" · "), F.replace("feature", F.lit("_"), F.lit(" "))).alias("message"),
        F.col("detected_us").alias("created_us")))


# ---- triage -------------------------------------------------------------------------------------

VIEWS = ("unresolved", "false_positive", "low_confidence", "impossible_travel", "investigating")


def view_predicate(name: str) -> Column:
    return {
        "unresolved": F.col("status").isin(*OPEN_STATES), "false_positive": F.col("status") == "false_positive",
        "low_confidence": F.col("classifier_confidence") < .6,
        "impossible_travel": F.col("predicted_attack") == "impossible_travel",
        "investigating": F.col("status") == "investigating",
    }[name]


def free_text(text: str, columns) -> Column:
    """Case-insensitive search over the whole row with underscores read as spaces."""
    row = F.lower(F.replace(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]), F.lit("_"), F.lit(" ")))
    return F.contains(row, F.lit(text.lower()))


def triage(incidents: DataFrame, text: str = "", severity: str = "all", view: str | None = None, sort: str = "risk") -> DataFrame:
    rows = incidents if severity == "all" else incidents.where(F.col("severity") == severity)
    if text:
        rows = rows.where(free_text(text, incidents.columns))
    if view:
        rows = rows.where(view_predicate(view))
    order = {"risk": (F.desc("risk_score"), F.desc("event_count")), "newest": (F.desc("us"),), "oldest": (F.asc("us"),)}[sort]
    return rows.orderBy(*order)


def severity_facets(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity").agg(F.count("*").alias("n"))


def live_rate(events: DataFrame, now_us: int, seconds: int = 5) -> DataFrame:
    recent = events.where((F.col("us") >= now_us - seconds * 1_000_000) & (F.col("us") <= now_us))
    return recent.agg((F.count("*") / F.lit(float(seconds))).alias("events_per_second"))

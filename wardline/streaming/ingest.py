"""Micro-batch ingestion: validate, deduplicate, score, correlate, trust and publish.

Events are judged as if they came one by one: an event's trust depends on its risk, its risk on the
trusted events before it, those of its own batch included. A batch is therefore judged in rounds until
the trust of its events no longer changes. Every table is partitioned by batch id and a replayed batch
overwrites its own partition, so a lost executor or a restart cannot write anything twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.scalar import criticality, hour_of_day, python_round
from wardline.operators import incidents, profiles, validate
from wardline.operators.features import behaviour_features
from wardline.operators.windows import Spans
from wardline.plans import scoring
from wardline.schema import EVENT_FIELDS, FEATURES, SIGNALS
from wardline.session import cut_lineage
from wardline.sources.records import parse_lines, read_table, write_batch
from wardline.streaming.incident_store import IncidentStore
from wardline.streaming.seen_ids import SeenIds

PUBLISHED = ("event_id", "us", "entity_id", "predicted_attack", "risk_score", "severity", "anomaly_score", "sequence_anomaly_score",
             "classifier_confidence", "model_confidence", "explanation", "recommended_actions", "baseline_kind", "baseline_confidence",
             "behavioral_score", "cold_start", "model_version", "feature_schema_version")


@dataclass
class Ingestion:
    """Where results go and how a batch is judged."""

    spark: SparkSession
    folder: str
    bundle: scoring.Bundle
    now_us: int | None = None
    max_trusted_risk: float = 29.0
    spans: Spans = Spans()
    policy: profiles.ProfilePolicy = profiles.ProfilePolicy()
    priors: DataFrame | None = None
    buckets: int = 8

    def __post_init__(self) -> None:
        self.seen = SeenIds(self.spark, self.folder, self.buckets)
        self.incidents = IncidentStore(self.spark, self.folder, self.buckets)

    def table(self, name: str, before: int | None = None) -> DataFrame | None:
        return read_table(self.spark, f"{self.folder}/{name}", before)

    def admit(self, lines: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(new events, quarantine) of a batch of raw lines."""
        checked = parse_lines(lines, self.now_us)
        # Parsed once: both sides of the split would otherwise parse every line again.
        valid, bad = validate.split_valid(cut_lineage(checked))
        fresh = validate.first_by_id(valid, ("us", "raw"))
        return self.seen.unseen(fresh.drop("raw"), batch_id), bad.select("raw", "event_id", "violations")

    def history(self, batch_id: int) -> DataFrame | None:
        """Earlier events with their stored trust."""
        return self.table("events", batch_id)

    def related(self, stored: DataFrame, fresh: DataFrame, batch_id: int) -> DataFrame:
        """The earlier events that can matter for this batch.

        Those of its entities and devices, those recently on its addresses, and the peers of events that
        no entity or device profile covers yet. If a peer group is too small as well, the organisation's
        profile may judge, and the whole history is needed.
        """
        facts = self.table("profile_facts", batch_id)
        if facts is None:
            return stored
        levels = fresh.select("event_id", F.explode(profiles.level_keys()).alias("l")).select("event_id", "l.*")
        counts = facts.join(levels.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
        sized = levels.join(counts, "key", "left")

        def at(kind: str, value) -> Column:
            return F.max(F.when(F.col("kind") == kind, value))

        n = F.coalesce("n", F.lit(0))
        per = cut_lineage(sized.groupBy("event_id").agg(
            *[at(k, F.col("key")).alias(k) for k in ("entity", "device", "peer")],
            (F.greatest(at("entity", n), at("device", n)) < self.policy.entity_minimum).alias("cold"),
            (at("peer", n) < self.policy.peer_minimum).alias("lonely")))
        if not per.where("cold AND lonely").isEmpty():
            return stored
        start = fresh.agg(F.min("us")).first()[0] - self.spans.medium
        wanted = (per.select(F.explode(F.array("entity", "device", F.when(F.col("cold"), F.col("peer")))).alias("key"))
                  .unionByName(fresh.select(F.concat(F.lit("address:"), "source_ip").alias("key"))).where("key IS NOT NULL").distinct())
        address = F.when(F.col("us") >= start, F.concat(F.lit("address:"), "source_ip"))
        keys = F.concat(F.transform(profiles.level_keys(), lambda x: x["key"]), F.array(address))
        touched = stored.select("event_id", F.explode(keys).alias("key")).join(wanted, "key", "left_semi").select("event_id").distinct()
        return stored.join(touched, "event_id", "left_semi")

    def with_history(self, fresh: DataFrame, batch_id: int, trust: DataFrame | None = None) -> DataFrame:
        """The new events with the earlier ones that matter to them; `trust` says which new ones later ones may learn from."""
        columns = [*EVENT_FIELDS, "us"]
        rows = fresh.select(*columns).withColumns({"trusted": F.lit(False), "fresh": F.lit(True)})
        if trust is not None:
            rows = rows.drop("trusted").join(trust, "event_id").select(*columns, "trusted", "fresh")
        stored = self.history(batch_id)
        if stored is None:
            return rows
        return self.related(stored, fresh, batch_id).select(*columns, "trusted").withColumn("fresh", F.lit(False)).unionByName(rows)

    def features(self, fresh: DataFrame, batch_id: int, trust: DataFrame | None = None) -> DataFrame:
        rows = self.with_history(fresh, batch_id, trust)
        priors = None if self.priors is None else self.priors.select(*EVENT_FIELDS, "us", "trusted")
        computed = behaviour_features(rows, self.spans, self.policy, runtime=True, priors=priors).drop("scope")
        return computed.join(fresh.select("event_id", "us", "entity_id", criticality("resource_sensitivity", "is_privileged_action").alias("criticality")), "event_id")

    def score(self, features: DataFrame, batch_id: int) -> DataFrame:
        """Scores of the new events, with earlier feature vectors as sequence context."""
        context = self.table("feature_vectors", batch_id)
        rows = features.withColumn("fresh", F.lit(True))
        if context is not None:
            touched = features.select("entity_id").distinct()
            earlier = context.drop("batch_id").join(touched, "entity_id", "left_semi")
            rows = rows.unionByName(earlier.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
        return scoring.infer(rows, self.bundle).where("fresh").drop("fresh")

    def judged(self, fresh: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(features, scores with trust) of the new events, as if each had come alone.

        Trust is first assumed, then decided from the scores it leads to, until both agree. An event depends on earlier
        ones only, so each round settles at least the earliest event that was still wrong, and the agreement reached is
        the one-by-one result; as nearly all events are normal, it is reached after two or three rounds.
        """
        trust = fresh.select("event_id", F.lit(True).alias("trusted"))
        while True:
            features = cut_lineage(self.features(fresh, batch_id, trust))
            scored = cut_lineage(profiles.trusted_live(self.score(features, batch_id), self.max_trusted_risk))
            decided = scored.select("event_id", "trusted")
            if decided.join(trust.withColumnRenamed("trusted", "assumed"), "event_id").where("trusted <> assumed").isEmpty():
                return features, scored
            trust = decided

    def process(self, lines: DataFrame, batch_id: int) -> None:
        fresh, bad = self.admit(lines, batch_id)
        fresh, bad = cut_lineage(fresh), cut_lineage(bad)
        if not bad.isEmpty():
            write_batch(bad, f"{self.folder}/quarantine", batch_id)
        if fresh.isEmpty():
            return
        features, scored = self.judged(fresh, batch_id)
        events = fresh.join(scored.select("event_id", "trusted"), "event_id")
        write_batch(features, f"{self.folder}/feature_vectors", batch_id)
        write_batch(scored.select(*PUBLISHED, "class_probabilities", "risk_composition", "feature_evidence", "trusted"), f"{self.folder}/predictions", batch_id)
        alerts = incidents.alerting(scored.join(fresh.select("event_id", "event_type", "country", "city", "destination_host"), "event_id"), self.bundle.alert_threshold)
        self.incidents.upsert(cut_lineage(incidents.correlate(alerts)), batch_id)
        trusted = events.where("trusted")
        write_batch(fact_rows(trusted), f"{self.folder}/profile_facts", batch_id)
        signals = [s for s in SIGNALS if s in FEATURES or s in ("anomaly_score", "sequence_anomaly_score")]
        values = scored.where("trusted").select("entity_id", "us", "event_id", hour_of_day("us").alias("access_hour"), *signals)
        write_batch(values, f"{self.folder}/drift_values", batch_id)
        write_batch(scored.select(*PUBLISHED, "trusted"), f"{self.folder}/feed", batch_id, "json")
        # Ids and events come last: later batches only see complete ones.
        self.seen.store(fresh, batch_id)
        write_batch(events, f"{self.folder}/events", batch_id)

    def start(self, source: str, checkpoint: str, max_files: int = 100):
        """Process what has arrived in `source` and stop; `max_files` bounds a batch."""
        lines = self.spark.readStream.option("maxFilesPerTrigger", max_files).text(source)
        return (lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def fact_rows(trusted: DataFrame) -> DataFrame:
    """Profile facts of trusted events, one row per key."""
    return profiles.fan_out(trusted).select("key", "kind", "event_id", "us")


def profile_counts(facts: DataFrame) -> DataFrame:
    """Trusted events per key over all appended batches."""
    return facts.groupBy("key", "kind").agg(F.count("*").alias("event_count"), F.max("us").alias("last_us"))


# ---- stream-to-stream forms --------------------------------------------------------------------------

def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First record of each id within the watermark."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def incident_stream(scored: DataFrame, threshold: float, delay: str = "1 day") -> DataFrame:
    """Quarter-hour incidents as a streaming aggregation for update mode."""
    alerts = incidents.alerting(scored, threshold).withWatermark("timestamp", delay)
    best = F.min(F.struct((-python_round("risk_score", 2)).alias("minus_risk"), "us", "event_id"))
    grouped = alerts.groupBy("entity_id", "predicted_attack", F.window("timestamp", "15 minutes")).agg(
        F.count("*").alias("event_count"), best.alias("anchor"), F.max("us").alias("last_us"))
    bucket = F.floor(F.unix_micros("window.start") / 900_000_000).cast("long")
    return grouped.select(F.concat_ws(":", "entity_id", "predicted_attack", bucket).alias("incident_key"), "entity_id", "predicted_attack",
                          "event_count", (-F.col("anchor.minus_risk")).alias("risk_score"), F.col("anchor.event_id").alias("event_id"), "last_us")


def live_rate_stream(events: DataFrame, window: str = "5 seconds", slide: str = "1 second", delay: str = "1 minute") -> DataFrame:
    seconds = float(window.split()[0])
    return (events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", window, slide))
            .agg((F.count("*") / seconds).alias("events_per_second")))

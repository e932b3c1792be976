"""Queries over keyed state and stored tables of the streaming part, fed with the events table in several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import incidents as I
from wardline.operators.corpus import label_join
from wardline.plans import oracle as O
from wardline.plans.queries_base import NOVELTY, PROFILE, RANGE, SPANS, STATISTIC
from wardline.plans.queries_ops import over_alerts
from wardline.plans.registry import d6, events, over_t, query, rounded, scored
from wardline.session import cut_lineage, work_folder
from wardline.sources import records
from wardline.streaming import live_profiles
from wardline.streaming.incident_store import IncidentStore
from wardline.streaming.seen_ids import SeenIds

BATCHES = 3
LIVE = tuple(f for f in (*NOVELTY, *STATISTIC, *RANGE))


@query("p16_live_profiles", f"""WITH {PROFILE}, {O.STATS_CTE}, {O.NOVELTY_CTE}
 SELECT b.event_id, b.baseline_kind, b.baseline_count, {", ".join(f"{d6(n)} AS {n}" for n in LIVE)}
 FROM base b JOIN statistic USING (event_id) JOIN novelty USING (event_id) WHERE mature""")
def live(spark, d):
    """Entity and device profiles kept as stream state over batches in time order: features of all events they judge."""
    rows = cut_lineage(events(spark, d))
    borders = rows.select(F.percentile_approx("us", [i / BATCHES for i in range(1, BATCHES)]).alias("at")).first()["at"] or []
    folder, stream = work_folder(spark, "live"), None
    for number in range(len(borders) + 1):
        low, high = borders[number - 1] if number else None, borders[number] if number < len(borders) else None
        part = rows if low is None else rows.where(F.col("us") >= low)
        (part if high is None else part.where(F.col("us") < high)).write.parquet(f"{folder}/in/{number:03d}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
        live_profiles.follow(spark, stream, f"{folder}/out", f"{folder}/check", spans=SPANS)
    judged = spark.read.parquet(f"{folder}/out").where("baseline_kind IS NOT NULL")
    return rounded(judged.select("event_id", "baseline_kind", "baseline_count", *LIVE))


@query("s03_split_files", over_t("""SELECT event_id, split, label, scenario_id, us, resource_id, bytes_uploaded FROM t"""))
def split_files(spark, d):
    """Splits written as event and label files and read back from them."""
    folder = work_folder(spark, "splits")
    records.write_split(events(spark, d).withColumn("timestamp", F.timestamp_micros("us")), folder)
    written = spark.read.schema("event_id string, timestamp timestamp, resource_id string, bytes_uploaded bigint, split string").json(f"{folder}/events")
    labels = records.read_labels(spark, f"{folder}/labels").drop("split")
    return label_join(written, labels, strict=False).select("event_id", "split", "label", "scenario_id", F.unix_micros("timestamp").alias("us"), "resource_id", "bytes_uploaded")


@query("i03_incident_upsert", over_alerts("SELECT incident_key, entity_id, predicted_attack, event_count, risk2 AS risk_score, event_id, us, last_us FROM incidents"))
def upserted(spark, d):
    """Alerts in three batches out of order, the second one twice, merged into the stored table."""
    rows = cut_lineage(I.alerting(scored(spark, d), 50.0))
    store = IncidentStore(spark, work_folder(spark, "incidents"), buckets=1)
    for batch in (0, 1, 1, 2):
        store.upsert(I.correlate(rows.where(F.crc32("event_id") % BATCHES == (batch + 1) % BATCHES)), batch)
    return store.incidents().select("incident_key", "entity_id", "predicted_attack", "event_count", "risk_score", "event_id", "us", "last_us")


@query("v05_seen_ids", over_t(""" SELECT event_id, min(batch) AS batch FROM (SELECT event_id, eid % 3 AS batch FROM t UNION ALL SELECT event_id, (eid + 1) % 3 FROM t WHERE eid % 50 = 0) GROUP BY 1"""))
def admitted(spark, d):
    """Three batches that share ids: each id is admitted by the first one that brings it."""
    rows = cut_lineage(events(spark, d).select("event_id", "eid"))
    store, kept = SeenIds(spark, work_folder(spark, "seen"), buckets=2), None
    for batch in range(3):
        part = rows.where(F.col("eid") % 3 == batch).unionByName(rows.where((F.col("eid") % 50 == 0) & ((F.col("eid") + 1) % 3 == batch)))
        fresh = cut_lineage(store.unseen(part, batch))
        store.store(fresh, batch)
        fresh = fresh.select("event_id", F.lit(batch).cast("long").alias("batch"))
        kept = fresh if kept is None else kept.unionByName(fresh)
    return kept

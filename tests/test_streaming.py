import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import BASE, DAY, MINUTE, START, frame
from test_models import bundle_rows
from wardline.operators import classifier as C
from wardline.operators import incidents as I
from wardline.operators import reservoir
from wardline.plans import scoring, training
from wardline.schema import FEATURES, TEMPORAL_FEATURES
from wardline.session import cut_lineage
from wardline.streaming import ingest


@pytest.fixture(scope="module")
def bundle(spark):
    rows = bundle_rows(spark)
    scaler = {f: (0.0, 1.0) for f in FEATURES}
    scaled = scoring.scale(rows, scaler)
    forests, ranges = training.fit_anomaly(scaled.where("label = 'normal'").select("event_id", "scaled"), training.TrainingPlan(trees=4, domain_trees=2, sample=32))
    model = C.AttackClassifier("random_forest", 1, trees=3, depth=3).fit(scaled, "scaled")
    sequence = reservoir.fit(scaled.withColumn("temporal", scoring.temporal_vector()), "temporal", reservoir.Reservoir(len(TEMPORAL_FEATURES), hidden=8))
    return scoring.Bundle("v1", scaler, forests, ranges, sequence, model, alert_threshold=10.0, behaviour_threshold=1.1)


def event(i, **changes):
    stamp = START + i * MINUTE
    iso = f"2026-01-12T{10 + i // 60:02d}:{i % 60:02d}:00+00:00"
    assert stamp >= START
    row = {**BASE, "event_id": f"e{i:03d}", "timestamp": iso, "resource_id": f"r{i % 3}", "entity_id": f"u{i % 2}", "user_id": f"u{i % 2}", **changes}
    return json.dumps(row)


def drop(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as handle:
        handle.write("\n".join(lines) + "\n")


def run(spark, bundle, tmp_path, name, batches, **options):
    folder = str(tmp_path / name)
    job = ingest.Ingestion(spark, f"{folder}/out", bundle, now_us=START + 365 * DAY, **options)
    for i, lines in enumerate(batches):
        drop(f"{folder}/in", f"{i:03d}.jsonl", lines)
        job.start(f"{folder}/in", f"{folder}/check", max_files=1).awaitTermination()
    return job


def test_ingestion(spark, bundle, tmp_path):
    first = [event(i) for i in range(6)] + [event(3), event(7, latitude=999.0), ""]
    second = [event(8), event(2), event(9, timestamp="2026-01-10T10:00:00+00:00")]
    job = run(spark, bundle, tmp_path, "flow", [first, second])
    events = job.table("events")
    assert sorted(r["event_id"] for r in events.collect()) == [f"e{i:03d}" for i in (0, 1, 2, 3, 4, 5, 8, 9)]
    reasons = {r["event_id"]: r["violations"] for r in job.table("quarantine").collect()}
    assert reasons == {"e007": ["latitude"]}
    predictions = job.table("predictions")
    assert predictions.count() == 8 and predictions.where("risk_score BETWEEN 0 AND 100").count() == 8
    assert spark.read.json(f"{job.folder}/feed").count() == 8
    trusted = events.where("trusted").count()
    counts = {r["key"]: r["event_count"] for r in ingest.profile_counts(job.table("profile_facts")).collect()}
    assert counts.get("global:organization", 0) == trusted and job.table("drift_values").count() == trusted
    folded = job.incidents.incidents()
    assert folded.agg(F.sum("event_count")).first()[0] == predictions.where("risk_score >= 10").count()
    # Replaying a batch changes nothing.
    job.process(spark.createDataFrame([(x,) for x in second], "value string"), 1)
    assert job.table("events").count() == 8 and job.table("predictions").count() == 8
    again = job.incidents.incidents()
    assert again.count() == again.select("incident_key").distinct().count() and again.agg(F.sum("event_count")).first()[0] == job.table("predictions").where("risk_score >= 10").count()


def test_batch_of_one_follows_the_recursion(spark, bundle, tmp_path):
    """Each event is judged by the trust decided before it, so the profile grows only by trusted events."""
    job = run(spark, bundle, tmp_path, "single", [[event(i)] for i in range(4)], max_trusted_risk=100.0)
    rows = {r["event_id"]: r for r in job.table("predictions").collect()}
    vectors = {r["event_id"]: r for r in job.table("feature_vectors").collect()}
    seen = {"u0": 0, "u1": 0}
    for i in range(4):
        entity, key = f"u{i % 2}", f"e{i:03d}"
        others = sum(seen.values())  # all share the device
        assert vectors[key]["subject_history_count"] == max(seen[entity], others)
        seen[entity] += int(rows[key]["trusted"])


@pytest.mark.parametrize("low, step", [(40.0, 1.0), (60.0, .001)])
def test_incident_stream_matches_batch(spark, tmp_path, low, step):
    rows = [(f"e{i}", f"u{i % 2}", START + i * 4 * MINUTE, low + i * step, "brute_force") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id string, entity_id string, us bigint, risk_score double, predicted_attack string").withColumn("timestamp", F.timestamp_micros("us"))
    expected = sorted(map(tuple, I.correlate(I.alerting(df, 50.0)).select("incident_key", "event_count", "risk_score", "event_id", "last_us").collect()))
    for cut in (1, 3):
        folder = str(tmp_path / f"cut{cut}")
        for part in range(cut):
            df.where(F.expr(f"cast(substr(event_id, 2) as int) % {cut} = {part}")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        latest = {}
        query = (ingest.incident_stream(stream, 50.0).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True)
                 .foreachBatch(lambda b, _: latest.update({r["incident_key"]: r for r in b.collect()})).start())
        query.awaitTermination()
        found = sorted((r["incident_key"], r["event_count"], r["risk_score"], r["event_id"], r["last_us"]) for r in latest.values())
        assert found == expected


def test_stream_deduplication(spark, tmp_path):
    df = spark.createDataFrame([(f"e{i % 6}", START + i) for i in range(12)], "event_id string, us bigint").withColumn("timestamp", F.timestamp_micros("us"))
    for part in range(3):
        df.where(F.col("us") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (ingest.deduplicated(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("event_id").count().where("count > 1").count() == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_related_history_gives_the_same_features(spark, bundle, tmp_path):
    """Pruned history must not change a feature of the batch."""
    policy = ingest.profiles.ProfilePolicy(entity_minimum=2, peer_minimum=3)
    lines = [event(i, entity_id=f"u{i % 3}", device_id=f"d{i % 4}", source_ip=f"10.0.0.{i % 2}", user_role=["engineer", "analyst"][i % 3 == 2]) for i in range(16)]
    job = run(spark, bundle, tmp_path, "pruned", [lines], max_trusted_risk=100.0, policy=policy)
    job.bundle.behaviour_threshold = 1.1
    fresh, _ = job.admit(spark.createDataFrame([(event(40, entity_id="u0", device_id="d0", user_role="engineer", source_ip="10.0.0.1"),), (event(41, entity_id="new", device_id="new", user_role="engineer", source_ip="10.0.0.1"),)], "value string"), 1)
    fresh = fresh.cache()
    kept = job.related(job.history(1), fresh, 1)
    trusted = job.table("events").where("trusted").count()
    assert trusted > 6 and kept.count() < 16
    pruned = sorted(map(tuple, job.features(fresh, 1).select("event_id", "baseline_kind", "baseline_count", *FEATURES).collect()))
    job.related = lambda stored, *_: stored
    assert pruned == sorted(map(tuple, job.features(fresh, 1).select("event_id", "baseline_kind", "baseline_count", *FEATURES).collect()))


class Baselines(ingest.Ingestion):
    """An ingestion whose features are the baselines, and whose trust hangs on the number of trusted events before."""

    def features(self, fresh, batch_id, trust=None):
        P = ingest.profiles
        sizes = None if self.priors is None else P.bootstrap_priors(self.priors)
        chosen = P.choose_baseline(P.positions(self.with_history(fresh, batch_id, trust)), self.policy, runtime=True, priors=sizes)
        return chosen.join(fresh.select("event_id"), "event_id", "left_semi")

    def score(self, features, batch_id):
        odd = (F.crc32("event_id") + F.col("subject_history_count")) % 3 == 0
        return features.withColumns({"risk_score": F.when(odd, 90.0).otherwise(10.0), "predicted_attack": F.lit("normal")})

    def learn(self, fresh, batch_id):
        features, scored = self.judged(fresh, batch_id)
        events = cut_lineage(fresh.join(scored.select("event_id", "trusted"), "event_id"))
        ingest.write_batch(ingest.fact_rows(events.where("trusted")), f"{self.folder}/profile_facts", batch_id)
        ingest.write_batch(events, f"{self.folder}/events", batch_id)
        return {r["event_id"]: (r["baseline_kind"], r["baseline_count"], r["subject_history_count"], r["trusted"]) for r in scored.collect()}


def test_batch_cuts_do_not_show(spark, tmp_path):
    """The events of a batch teach each other in event order: one batch, three and single events give the same answers."""
    policy = ingest.profiles.ProfilePolicy(entity_minimum=2, peer_minimum=3)
    rows = frame(spark, [{"event_id": f"e{i}", "entity_id": f"u{i % 2}", "device_id": f"d{i % 3}"} for i in range(9)]).drop("trusted").cache()
    answers = []
    for size in (9, 3, 1):
        job, found = Baselines(spark, str(tmp_path / f"cut{size}"), None, policy=policy), {}
        for batch, start in enumerate(range(0, 9, size)):
            found |= job.learn(cut_lineage(rows.where(F.substring("event_id", 2, 1).cast("int").between(start, start + size - 1))), batch)
        answers.append(found)
    assert answers[0] == answers[1] == answers[2]
    assert {r[3] for r in answers[0].values()} == {True, False} and {r[0] for r in answers[0].values()} >= {"entity", "peer"}


def test_stored_organisation_profile_comes_before_priors(spark, tmp_path):
    """Forty stored facts and a lonely newcomer: the organisation's own profile judges it, not the training priors."""
    job = Baselines(spark, str(tmp_path), None)
    stored = frame(spark, [{"entity_id": f"u{i}", "device_id": f"d{i}", "user_role": f"role{i}"} for i in range(40)])
    ingest.write_batch(ingest.fact_rows(stored), f"{job.folder}/profile_facts", 0)
    ingest.write_batch(stored, f"{job.folder}/events", 0)
    job.priors = frame(spark, [{"event_id": f"p{i}", "us": START - DAY + i * MINUTE} for i in range(30)])
    newcomer = frame(spark, [{"event_id": "x", "us": START + DAY, "entity_id": "new", "device_id": "new", "user_role": "other"}]).drop("trusted")
    row = job.features(newcomer, 1).first()
    assert (row["baseline_kind"], row["baseline_count"], row["baseline_confidence"]) == ("global", 40, .85)
    job.priors = None
    assert job.features(newcomer, 1).first()["baseline_kind"] == "global"

import random
import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DAY, HOUR, MINUTE, START, by_id, frame
from wardline.operators import corpus, daily, drift, evaluate as E, incidents as I, scaling, timeline
from wardline.streaming import drift_state


# ---- timelines -----------------------------------------------------------------------------------

def test_running_totals_across_slots(spark):
    rows = spark.range(500).select(F.lit("hot").alias("k"), (F.col("id") * HOUR).alias("us"), F.col("id").alias("v"))
    out = timeline.running_before(rows, ["k"], ["us"], {"v": "sum"}, width=DAY).orderBy("us").collect()
    assert [r["prior_v"] for r in out] == [sum(range(i)) for i in range(500)]


def test_hot_key_spreads_over_tasks(spark):
    rows = spark.range(2000).select((F.col("id") % 1).alias("k"), (F.col("id") * HOUR).alias("us"), F.lit(1).alias("v"))
    plan = timeline.running_before(rows, ["k"], ["us"], {"v": "sum"}, width=DAY)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Window [" in line and "_l_v" in line]
    assert sorts and all("_slot" in line for line in sorts)
    assert re.search(r"hashpartitioning\(k#\d+L?, _slot", plan)


def test_last_rows_over_chunk_borders(spark):
    rows = spark.range(50).select(F.lit("k").alias("k"), (F.col("id") + 1).alias("position"), F.col("id").alias("v"))
    out = timeline.last_rows(rows, ["k"], 5, F.col("v"), "held", chunk=8).orderBy("position").collect()
    assert [list(r["held"]) for r in out] == [list(range(max(0, i - 5), i)) for i in range(50)]


# ---- scaler and quantiles --------------------------------------------------------------------------

def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 3, 400), np.zeros(300), [1e9, -1e9]])
    df = spark.createDataFrame([("x", float(v)) for v in values], "name string, value double")
    row = scaling.long_quantiles(df, (.02, .5, .9, .995)).first()
    assert np.allclose([row[f"q{i}"] for i in range(4)], np.quantile(values, [.02, .5, .9, .995]))


def test_zero_range_scales_by_one(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(7.0,)], "x double")
    fitted = scaling.scaler_parameters(scaling.fit_scaler(df.where("x < 1"), ["x"]))
    assert scaling.apply_scaler(df, fitted).agg(F.max("x")).first()[0] == pytest.approx(7 * 2.5631031, abs=1e-5)


# ---- evaluation --------------------------------------------------------------------------------------

def curve(spark, rows):
    return spark.createDataFrame([(f"e{i}", s, "brute_force" if y else "normal") for i, (s, y) in enumerate(rows)], "event_id string, score double, label string")


def test_average_precision_is_the_step_rule(spark):
    df = curve(spark, [(.9, 1), (.8, 0), (.7, 1), (.6, 0), (.5, 0), (.4, 1)])
    row = E.ranking_quality(df, "score", E.attack()).first()
    assert row["pr_auc"] == pytest.approx((1 + 2 / 3 + 3 / 6) / 3) and row["roc_auc"] == pytest.approx(5 / 9)


def test_tied_scores_and_single_class(spark):
    tied = E.ranking_quality(curve(spark, [(.5, 1), (.5, 0), (.5, 0)]), "score", E.attack()).first()
    assert tied["roc_auc"] == .5 and tied["pr_auc"] == pytest.approx(1 / 3)
    assert tuple(E.ranking_quality(curve(spark, [(.5, 0), (.6, 0)]), "score", E.attack()).first()) == (0.0, 0.0)


def test_threshold_fallback(spark):
    df = curve(spark, [(.9, 0), (.5, 1)])
    assert E.tuned_threshold(df, "score", 0.0).first() is None
    assert E.tuned_threshold(df, "score", 0.0, fallback=1.0).first()["threshold"] == 1.0
    assert E.tuned_threshold(df, "score", 1.0).first()["threshold"] == .5


def test_budget_takes_part_of_a_tie(spark):
    df = curve(spark, [(1.0, 1)] + [(.5, i % 2) for i in range(99)])
    row = E.budget_metrics(df, "score", .05).first()
    assert row["budget_count"] == 5 and row["threshold"] == .5 and row["false_positives"] + round(row["precision"] * 5) == 5


# ---- incidents -----------------------------------------------------------------------------------------

def test_incident_anchor_and_merge(spark):
    at = START - START % (15 * MINUTE)
    rows = [("a", at, 60.001), ("b", at + 1, 70.0), ("c", at + 2, 70.004), ("d", at + 3, 50.0), ("e", at + 15 * MINUTE, 55.0), ("f", at, 49.994)]
    df = spark.createDataFrame([(i, "u", u, r, "brute_force") for i, u, r in rows], "event_id string, entity_id string, us bigint, risk_score double, predicted_attack string")
    found = {r["bucket"]: r for r in I.correlate(I.alerting(df, 50.0)).collect()}
    first = found[at // (15 * MINUTE)]
    assert first["event_count"] == 4 and first["event_id"] == "b" and first["risk_score"] == 70.0 and len(found) == 2
    pieces = [I.correlate(I.alerting(df.where(c), 50.0)) for c in ("event_id < 'c'", "event_id >= 'c'")]
    merged = I.merge_incidents(*pieces)
    whole = I.correlate(I.alerting(df, 50.0)).select(*merged.columns)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_disposition(spark):
    found = spark.createDataFrame([("k1", 5), ("k2", 6)], "incident_key string, last_us bigint")
    notes = spark.createDataFrame([("k1", "investigating", 10, 1), ("k1", "false_positive", 11, 2)], "incident_key string, status string, created_us bigint, feedback_id int")
    out = {r["incident_key"]: r for r in I.current_status(found, notes).collect()}
    assert out["k1"]["status"] == "false_positive" and out["k1"]["trusted"] and out["k1"]["updated_us"] == 11 and out["k2"]["status"] == "open"


# ---- daily ---------------------------------------------------------------------------------------------

def test_entity_day(spark):
    df = spark.createDataFrame([("a", "u1", START, 0.0, "normal"), ("b", "u1", START + HOUR, 1.0, "brute_force"), ("c", "u2", START, 2.0, "normal"), ("d", "u1", START + DAY, 3.0, "normal")],
                               "event_id string, entity_id string, us bigint, x double, label string")
    for crowded in (10, 0):
        out = {(r["entity_id"], r["day"]): r for r in daily.daily_rollup(df, ["x"], crowded).collect()}
        row = out[("u1", date(2026, 1, 12))]
        assert len(out) == 3 and row["x"] == pytest.approx(.95) and row["label"] == "brute_force" and row["event_count"] == 2


def days(spark, rows):
    return spark.createDataFrame([(e, date.fromordinal(738_000 + d), float(s), lab, 1) for e, d, s, lab in rows], "entity_id string, day date, score double, label string, event_count bigint")


def test_ranking(spark):
    df = days(spark, [("high", 1, .2, "normal"), ("high", 2, 1.0, "normal")] + [("steady", i, .7, "normal") for i in (1, 2, 3)])
    out = {r["entity_id"]: r for r in daily.identity_ranking(df, .6).collect()}
    assert out["high"]["rank"] == 1 and out["high"]["maximum_drift_30d"] == 1 and out["steady"]["drift_days_30d"] == 3
    assert out["steady"]["consecutive_drift_days"] == 3 and out["high"]["consecutive_drift_days"] == 1


def test_ranking_horizon(spark):
    rows = [("old", 0, .99, "brute_force")] + [("old", i, .01, "normal") for i in range(1, 31)] + [("recent", 30, .98, "brute_force")]
    row = daily.daily_evaluation(days(spark, rows), .9).first()
    assert row["attacked_entity_count"] == 1 and row["top_10_precision"] == .5 and row["top_10_recall"] == 1.0


# ---- drift ---------------------------------------------------------------------------------------------

def hours(spark, values, subject="s"):
    return spark.createDataFrame([(subject, START + i, f"e{i:04d}", float(v)) for i, v in enumerate(values)], "entity_id string, us bigint, event_id string, access_hour double")


def detect(spark, values):
    rows = drift.monitored_values(hours(spark, values))
    found = drift.findings(drift.compare_blocks(drift.block_summaries(rows)))
    return rows, found


def test_shift_is_found(spark):
    rows, found = detect(spark, [9] * 20 + [19] * 20 + [9] * 20)
    hit = found.collect()
    assert len(hit) == 1 and hit[0]["ks_distance"] == 1 and hit[0]["magnitude"] >= 2.5 and hit[0]["detected_seq"] == 40
    assert hit[0]["previous_distribution"]["p90"] == 9 and hit[0]["current_distribution"]["mean"] == pytest.approx(19)
    status = drift.window_status(drift.series_state(rows, found)).first()
    assert status["status"] == "review_required" and status["flagged_features"] == ["access_hour"]


def test_stable_and_midnight_traffic(spark):
    rows, found = detect(spark, [9 + (i % 4) * .1 for i in range(80)])
    state = {r["feature"]: r for r in drift.series_state(rows, found).collect()}
    assert found.count() == 0 and state["access_hour"]["baseline_version"] >= 3 and state["access_hour"]["status"] == "collecting_current"
    assert detect(spark, [23.8, 23.9, 0, .1] * 5 + [23.9, 0, .1, .2] * 5)[1].count() == 0


def test_learning_summary(spark):
    rows, found = detect(spark, [9] * 8)
    row = drift.drift_summary(drift.window_status(drift.series_state(rows, found)), found).first()
    assert row["state"] == "learning" and row["monitored_entities"] == 1 and row["trusted_events"] == 8 and row["signals_monitored"] == 8


def run_monitor(spark, tmp_path, batches, name):
    folder = str(tmp_path / name)
    schema = "subject string, feature string, us bigint, event_id string, kind string, value double, action string, analyst string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in/b{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{folder}/in")
    query = (drift_state.monitor(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start())
    query.awaitTermination()
    return sorted((r["us"], r["kind"], r["baseline_version"]) for r in spark.read.parquet(f"{folder}/out").collect())


def value(i, v):
    return ("s", "access_hour", i, f"e{i:04d}", "value", float(v), None, None)


def review(i, action):
    return ("s", "access_hour", i, "", "review", None, action, "admin")


@pytest.mark.parametrize("action, version, outcome", [("approve_adaptation", 2, "approved_adaptation"), ("reject_change", 1, "rejected_change")])
def test_reviews_in_the_stream(spark, tmp_path, action, version, outcome):
    rows = [value(i, 9 if i < 20 else 19) for i in range(45)] + [review(100, action), review(101, "approve_adaptation")]
    rows += [value(200 + i, 19) for i in range(20)]
    out = run_monitor(spark, tmp_path, [rows], "whole")
    assert (39, "finding", 1) in out and (100, outcome, version) in out and (101, "refused", version) in out
    # After approval 19 h is the reference; after a rejection it is still a change from 9 h.
    assert ((219, "finding", 1) in out) == (action == "reject_change")
    cut = run_monitor(spark, tmp_path, [rows[:30], rows[30:46], rows[46:50], rows[50:]], "cut")
    assert cut == out


def test_keyed_and_batch_detection_agree(spark):
    rng = np.random.default_rng(2)
    old, new = list(rng.normal(9, 1, 20)), list(rng.normal(13, 1, 20))
    rows = drift.compare_blocks(drift.block_summaries(drift.monitored_values(hours(spark, old + new)))).where("feature = 'access_hour'").first()
    significant, effect, shift, ks = drift_state.compare("access_hour", old, new)
    assert (rows["significant"], rows["effect_size"], rows["absolute_shift"], rows["ks_distance"]) == (significant, pytest.approx(effect), pytest.approx(shift), pytest.approx(ks))


def test_whole_log_equals_the_stream(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows, seqs = [], {}
    for subject in ("a", "b"):
        level = rng.choice([9, 13, 19], size=40)
        for i in range(700):
            rows.append((subject, "access_hour", 10 * i + int(rng.integers(0, 2)) * 5, f"e{subject}{i:04d}", "value", float(level[i // 18] + rng.normal()), None, None))
        for us in sorted(rng.choice(700, 30, replace=False)):
            rows.append((subject, "access_hour", int(us) * 10, "", "review", None, str(rng.choice(["approve_adaptation", "reject_change", "dismiss", "investigate", "postpone"])), "x"))
    rows.append(rows[-1])
    rows = sorted(rows, key=lambda r: (r[2], r[4] == "review", r[3]))
    schema = "subject string, feature string, us bigint, event_id string, kind string, value double, action string, analyst string"
    values = []
    for r in rows:
        if r[4] == "value":
            seqs[r[0]] = seqs.get(r[0], 0) + 1
            values.append((r[0], r[1], r[2], r[3], seqs[r[0]], r[5]))
    log = spark.createDataFrame(values, "subject string, feature string, us bigint, event_id string, seq bigint, value double")
    empty = (None, "access_hour", 5, "dismiss", "x")
    reviews = spark.createDataFrame([(r[0], r[1], r[2], r[6], r[7]) for r in rows if r[4] == "review"] + [empty], "subject string, feature string, us bigint, action string, analyst string")
    whole = drift.reviewed_log(log, reviews).collect()

    def rows_of(out):
        return sorted((r["us"], r["kind"], r["subject"], r["event_id"], *(("", "") if r["kind"] == "refused" else (r["status"], r["baseline_version"])),
                       None if r["magnitude"] is None else round(r["magnitude"], 9)) for r in out)

    borders = [r[2] for r in rows][::211]
    cut = [[r for r in rows if (a <= r[2] < b)] for a, b in zip(borders, borders[1:] + [10 ** 9])]
    for name, batches in (("one", [rows]), ("cut", cut)):
        run_monitor(spark, tmp_path, batches, name)
        assert rows_of(spark.read.parquet(str(tmp_path / name / "out")).collect()) == rows_of(whole), name
    kinds = [r["kind"] for r in whole]
    assert kinds.count("finding") > 6 and {"approved_adaptation", "rejected_change", "refused"} <= set(kinds)
    nothing = drift.reviewed_log(log.limit(0), reviews).collect()
    assert {r["kind"] for r in nothing} == {"refused"} and len(nothing) == len([r for r in rows if r[4] == "review"])
    assert drift.reviewed_log(log.limit(0), reviews.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [drift.CHUNK, 61])
def test_rounds_of_a_log_follow_its_length_not_its_reviews(spark, monkeypatch, chunk):
    """A level that jumps every 20 values gives a finding per block, each approved at once."""
    values = [("a", "access_hour", 10 * i, f"e{i:04d}", i + 1, 9.0 if i // 20 % 2 else 19.0) for i in range(600)]
    log = spark.createDataFrame(values, "subject string, feature string, us bigint, event_id string, seq bigint, value double")
    reviews = spark.createDataFrame([("a", "access_hour", 10 * i + 5, "dismiss" if i // 20 % 3 == 2 else "approve_adaptation", "x") for i in range(39, 600, 20)],
                                    "subject string, feature string, us bigint, action string, analyst string")
    rounds = []
    monkeypatch.setattr(drift, "cut_lineage", lambda df: rounds.append(1) or df.localCheckpoint())
    out = sorted((r["us"], r["kind"], r["baseline_version"]) for r in drift.reviewed_log(log, reviews, chunk=chunk).collect())
    assert len(rounds) == -(-(len(values) + reviews.count()) // chunk)
    # The same one by one: blocks of 20, a finding where the level differs from the reference.
    want, reference, version = [], 19.0, 1
    for i in range(39, 600, 20):
        if values[i][5] == reference:
            want.append((10 * i + 5, "refused", None))
            version += 1
            continue
        want.append((10 * i, "finding", version))
        if i // 20 % 3 == 2:
            want.append((10 * i + 5, "dismissed", version))
        else:
            reference, version = values[i][5], version + 1
            want.append((10 * i + 5, "approved_adaptation", version))
    assert out == sorted(want)


# ---- corpus ----------------------------------------------------------------------------------------------

def test_strict_labels(spark):
    events = frame(spark, [{}, {}]).select("event_id", "us")
    labels = spark.createDataFrame([("e0000", "normal")], "event_id string, label string")
    with pytest.raises(ValueError):
        corpus.label_join(events, labels)
    assert corpus.label_join(events.where("event_id = 'e0000'"), labels).count() == 1


def test_cold_identities_share_device_numbers(spark):
    rows = [{"label": "brute_force", "scenario_id": "x", "device_id": "a", "claimed_device_id": "b"}, {"label": "brute_force", "scenario_id": "x", "device_id": "b", "claimed_device_id": "a", "entity_id": "u2"}]
    out = by_id(corpus.cold_identities(frame(spark, rows)), "entity_id", "device_id", "claimed_device_id")
    assert out == {"e0000": ("cold-x-0", "cold-x-device-0", "cold-x-device-1"), "e0001": ("cold-x-1", "cold-x-device-1", "cold-x-device-0")}


def test_replay_sees_late_replaced_and_lost_events(spark, monkeypatch):
    from types import SimpleNamespace

    from wardline.plans import training
    rolled = []
    monkeypatch.setattr(training, "with_anomaly", lambda rows, *_: rows)
    monkeypatch.setattr(training, "daily_vectors", lambda rows: rolled.append(sorted(r[0] for r in rows.select("event_id").collect())) or daily.daily_rollup(rows, ["score"]))
    monkeypatch.setattr(training, "score_days", lambda days, *_: days)
    bundle = SimpleNamespace(classifier=SimpleNamespace(raw=lambda rows, _: rows), scaler=None, forests=None, forest_ranges=None, daily_scaler=None, daily=None, daily_threshold=.5)
    rows = [("a", "u1", START, .2), ("b", "u1", START + DAY, .3), ("c", "u2", START, .4), ("f", "u3", START, .1), ("f", "u3", START, .1), ("g", "u4", START, .1)]
    kind = "event_id string, entity_id string, us bigint, score double"
    known = training.day_vectors(spark.createDataFrame(rows, kind), bundle)
    # d and e are late, c is replaced by as many rows, two equal rows by two others, and the day of g is gone.
    now = [*rows[:2], ("c", "u2", START, .9), ("f", "u3", START, .8), ("f", "u3", START, .8), ("d", "u1", START + HOUR, 1.0), ("e", "u2", START + 2 * DAY, .6)]
    changed = spark.createDataFrame(now, kind)
    rolled.clear()
    got = training.replay_ranking(changed, bundle, known)
    assert rolled == [["a", "c", "d", "e", "f", "f"]]
    for mine, want in zip(got, training.replay_ranking(changed, bundle)):
        assert sorted(map(str, mine.collect())) == sorted(map(str, want.select(*mine.columns).collect()))


def test_curve_with_most_scores_equal(spark):
    """Nine rows in ten share their score to two decimals: ranges of the curve stay even and its numbers exact."""
    rng = random.Random(5)
    data = [(f"e{i}", .5 + rng.randrange(400) / 1e5 if i % 10 else rng.random(), "brute_force" if rng.random() < .2 else "normal") for i in range(4000)]
    df = spark.createDataFrame(data, "event_id string, score double, label string")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")  # the data are small enough to be merged into one partition
    try:
        curve = E.score_curve(df, "score", E.attack())
        sizes = [r["count"] for r in curve.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set(merging, before)
    rows = curve.collect()
    assert len(rows) == len({s for _, s, _ in data})
    for r in rows[::37]:
        assert (r["tp"], r["fp"]) == tuple(sum(s >= r["score"] and (label != "normal") == hit for _, s, label in data) for hit in (True, False))
        assert r["positives"] + r["negatives"] == 4000
    assert len(sizes) > 4 and max(sizes) <= 2 * len(rows) / 8 + 50
    plan = E.budget_metrics(df, "score")._jdf.queryExecution().executedPlan().toString() + E.tuned_threshold(df, "score", .1, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

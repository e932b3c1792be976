import math
import random
from collections import Counter
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from helpers import DAY, HOUR, MINUTE, SECOND, START, by_id, frame
from wardline.operators import profiles as P
from wardline.operators import windows as W
from wardline.operators.features import behaviour_features, check_features
from wardline.schema import DOMAINS, FEATURES, TEMPORAL_INDICES


def test_contract():
    assert len(FEATURES) == 32 == len(set(FEATURES)) and len(TEMPORAL_INDICES) == 16
    assert [b - a for a, b in DOMAINS.values()] == [9, 8, 8, 7]
    with pytest.raises(ValueError):
        check_features(FEATURES[::-1])


def test_failures_then_success(spark):
    rows = [{"us": START - (10 + i) * SECOND, "authentication_result": "failure"} for i in range(4)] + [{"us": START, "event_id": "now"}]
    out = by_id(W.minute_features(frame(spark, rows)), "failed_auth_count_1m", "auth_attempt_count_5m", "successful_auth_after_failures_score")
    assert out["now"] == (4, 5, .8)


def test_equal_timestamps_do_not_see_each_other(spark):
    rows = [{"us": START, "event_id": "a", "authentication_result": "failure"}, {"us": START, "event_id": "b", "authentication_result": "failure"}]
    assert set(by_id(W.minute_features(frame(spark, rows)), "failed_auth_count_1m").values()) == {1}


def test_window_edges_are_inclusive(spark):
    rows = [{"us": START - MINUTE, "event_id": "edge", "authentication_result": "failure"}, {"us": START - MINUTE - 1, "event_id": "out", "authentication_result": "failure"},
            {"us": START, "event_id": "now", "authentication_result": "failure"}]
    assert by_id(W.minute_features(frame(spark, rows)), "failed_auth_count_1m")["now"] == 2


def test_minute_windows_against_brute_force(spark):
    rng = random.Random(3)
    rows = [{"us": START + rng.randrange(0, 40 * 60) * SECOND, "entity_id": f"u{rng.randrange(4)}", "source_ip": f"ip{rng.randrange(3)}",
             "destination_host": f"h{rng.randrange(4)}", "authentication_result": rng.choice(["success", "failure", "not_applicable"])} for _ in range(300)]
    df = frame(spark, rows)
    out = by_id(W.minute_features(df), "auth_attempt_count_5m", "source_ip_unique_entities_5m", "unique_destination_hosts_5m")
    data = [r.asDict() for r in df.collect()]
    for e in data:
        near = [x for x in data if e["us"] - 5 * MINUTE <= x["us"] < e["us"]] + [e]
        auth = sum(x["authentication_result"] != "not_applicable" and (x["entity_id"] == e["entity_id"] or x["source_ip"] == e["source_ip"]) for x in near)
        people = len({x["entity_id"] for x in near if x["source_ip"] == e["source_ip"]})
        hosts = len({x["destination_host"] for x in near if x["entity_id"] == e["entity_id"]})
        assert out[e["event_id"]] == (auth, people, hosts)


def test_travel(spark):
    rows = [{"us": START, "latitude": 51.5074, "longitude": -.1278}, {"us": START + 30 * MINUTE, "latitude": 40.7128, "longitude": -74.006, "event_id": "ny"}]
    assert by_id(W.travel_features(frame(spark, rows)), "vpn_aware_travel_anomaly_score")["ny"] > .9
    rows[1]["is_vpn"] = True
    assert by_id(W.travel_features(frame(spark, rows)), "vpn_aware_travel_anomaly_score")["ny"] == pytest.approx(.35)


def test_sessions_touching_intervals(spark):
    rows = [{"us": START, "session_id": "a", "session_duration_seconds": 60}, {"us": START + MINUTE, "session_id": "a", "session_duration_seconds": 60},
            {"us": START + MINUTE, "session_id": "b", "event_id": "touch"}, {"us": START + 90 * SECOND, "session_id": "b", "event_id": "inside"},
            {"us": START + 2 * DAY, "session_id": "c", "session_duration_seconds": 604_800}, {"us": START + 8 * DAY, "session_id": "b", "event_id": "week"}]
    out = by_id(W.session_features(frame(spark, rows)), "active_concurrent_session_count")
    assert out["touch"] == 1 and out["inside"] == 2 and out["week"] == 2


def test_unknown_device_and_mismatch(spark):
    rows = [{"device_id": "trusted", "device_fingerprint": "zzzzzz123456"} for _ in range(12)] + [
        {"event_id": "new", "device_id": "other", "claimed_device_id": "trusted", "device_fingerprint": "zzzzzzabcdef", "us": START + HOUR}]
    out = behaviour_features(frame(spark, rows)).where("event_id = 'new'").first()
    assert out["baseline_kind"] == "entity" and out["new_device_score"] == 1 and out["device_fingerprint_distance"] == .5
    assert out["claimed_observed_device_mismatch_score"] == 1


def test_maturity_and_device_fallback(spark):
    rows = [{"us": START + i * MINUTE} for i in range(13)] + [{"entity_id": "new", "event_id": "shared", "us": START + HOUR}]
    out = by_id(P.choose_baseline(P.positions(frame(spark, rows)), runtime=True), "baseline_kind", "baseline_count")
    assert out["e0011"] == ("global_default", 0) and out["e0012"] == ("entity", 12) and out["shared"] == ("device", 13)


def test_priors_serve_cold_entities(spark):
    train = frame(spark, [{"us": START - DAY + i * MINUTE, "entity_id": f"t{i}", "device_id": f"t{i}", "event_id": f"t{i}", "resource_id": f"r{i % 3}"} for i in range(30)])
    live = frame(spark, [{"resource_id": "r1"}, {"resource_id": "zz"}]).withColumn("trusted", F.lit(False))
    out = by_id(behaviour_features(live, runtime=True, priors=train), "baseline_kind", "baseline_count", "baseline_confidence", "resource_novelty_score")
    assert out["e0000"] == ("peer_prior", 30, .55, 0.0) and out["e0001"][3] == 1.0


def test_priors_carry_transfers(spark):
    train = frame(spark, [{"us": START - 3 * DAY + i * MINUTE, "entity_id": f"t{i}", "device_id": f"t{i}", "event_id": f"t{i}", "is_external_destination": True,
                           "bytes_uploaded": 900 + 4 * i, "bytes_downloaded": 0} for i in range(50)])
    live = frame(spark, [{"is_external_destination": True, "bytes_uploaded": size, "bytes_downloaded": 0, "us": START + i * 2 * DAY} for i, size in enumerate((50_000, 2_000))])
    out = by_id(behaviour_features(live.withColumn("trusted", F.lit(False)), runtime=True, priors=train), "cumulative_external_transfer_24h_zscore")
    center = mean(900 + 4 * i for i in range(50))
    assert out["e0000"] == 20 and out["e0001"] == pytest.approx((2_000 - center) / 1000)


def brute_profile(events, policy, day, month):
    """Literal replay of bounded profiles of one entity."""
    logs, result = [], {}
    gaps, last = [], None
    for e in events:
        n = len(logs)
        recent = logs[-policy.numeric_limit:]
        out = {}

        def z(value, values):
            return 0.0 if len(values) < 2 else max(-20.0, min(20.0, (value - mean(values)) / max(pstdev(values), 1.0)))

        out["down"] = z(e["bytes_downloaded"], [x["bytes_downloaded"] for x in recent])
        log = logs[-policy.log_limit:]
        seen = Counter([x["resource_id"] for x in log if x["us"] >= e["us"] - day] + [e["resource_id"]])
        total = sum(seen.values())
        out["entropy"] = 0.0 if len(seen) <= 1 else -sum(c / total * math.log(c / total) for c in seen.values()) / math.log(len(seen)) * min(1, (len(seen) - 1) / 5)
        moved = [x for x in logs if x["is_external_destination"]]
        size = lambda x: x["bytes_uploaded"] + x["bytes_downloaded"]
        values = [size(x) for x in moved[-policy.log_limit:] if x["us"] >= e["us"] - day] + ([size(e)] if e["is_external_destination"] else [])
        base = [size(x) for x in moved[-policy.numeric_limit:]]
        if not values:
            out["transfer"] = 0.0
        elif len(base) < 2:
            out["transfer"] = max(0, min(1, math.log(1 + sum(values)) / math.log(10_000_001)))
        else:
            out["transfer"] = max(-20, min(20, (sum(values) - mean(base) * len(values)) / max(pstdev(base) * math.sqrt(len(values)), 1000.0)))
        flag = lambda x: float(x["resource_sensitivity"] >= .7 or x["is_privileged_action"])
        month_flags = [flag(x) for x in log if x["us"] >= e["us"] - month] + [flag(e)]
        flags = [flag(x) for x in recent]
        out["sensitive"] = (.25 if flag(e) else 0.0) if len(flags) < 2 else max(-20, min(20, (mean(month_flags) - mean(flags)) / max(pstdev(flags), .1)))
        since = None if last is None else (e["us"] - last) / 1e6
        out["gap"] = 0.0 if since is None or n < policy.entity_minimum else z(since, gaps[-policy.numeric_limit:])
        last = e["us"] if last is None or e["us"] > last else last
        result[e["event_id"]] = out
        if e["trusted"]:
            if logs:
                gaps.append(max(0.0, (e["us"] - logs[-1]["us"]) / 1e6))
            logs.append(e)
    return result


def test_bounded_histories_against_replay(spark):
    """Small limits and chunks make every list overflow and every chunk border count."""
    rng = random.Random(11)
    rows, at = [], START
    for _ in range(400):
        at += rng.choice([20, 300, 4000, 30_000]) * SECOND
        rows.append({"us": at, "resource_id": f"r{rng.randrange(5)}", "bytes_downloaded": rng.choice([10**10, rng.randrange(10**6)]), "bytes_uploaded": rng.randrange(5000),
                     "is_external_destination": rng.random() < .4, "resource_sensitivity": rng.choice([.1, .9]), "trusted": rng.random() < .8})
    df = frame(spark, rows)
    policy = P.ProfilePolicy(entity_minimum=1, numeric_limit=17, log_limit=23, chunk=32)
    out = {r["event_id"]: r for r in behaviour_features(df, W.Spans(day=DAY, month=2 * DAY), policy).collect()}
    expected = brute_profile(sorted((r.asDict() for r in df.collect()), key=lambda r: r["us"]), policy, DAY, 2 * DAY)
    names = {"down": "download_volume_zscore", "entropy": "resource_access_entropy_24h", "transfer": "cumulative_external_transfer_24h_zscore",
             "sensitive": "sensitive_access_rate_30d_zscore", "gap": "inter_event_time_zscore"}
    checked = 0
    for event_id, values in expected.items():
        if out[event_id]["baseline_kind"] != "entity":
            continue
        checked += 1
        for short, name in names.items():
            assert out[event_id][name] == pytest.approx(values[short], abs=1e-7), (event_id, name)
    assert checked > 350


def test_values_leave_full_lists(spark):
    rows = [{"us": START + i * MINUTE, "resource_id": f"r{i}"} for i in range(6)] + [
        {"us": START + HOUR, "resource_id": "r0", "event_id": "old"}, {"us": START + HOUR + 1, "resource_id": "r5", "event_id": "recent"}]
    df = frame(spark, rows).withColumn("trusted", F.expr("event_id LIKE 'e%'"))
    policy = P.ProfilePolicy(entity_minimum=1, value_limits={**P.VALUE_LIMITS, "resource": 3})
    out = by_id(behaviour_features(df, policy=policy), "resource_novelty_score")
    assert out["old"] == 1 and out["recent"] == 0


def test_command_transitions(spark):
    rows = [{"command_sequence": ["ls", "cat"]}, {"command_sequence": ["ls", "rm"], "event_id": "half"}]
    assert by_id(behaviour_features(frame(spark, rows), policy=P.ProfilePolicy(entity_minimum=1)), "command_transition_novelty_score")["half"] == .5

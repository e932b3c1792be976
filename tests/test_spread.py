"""No task holds a whole broad key, list or source."""

import pytest
from pyspark.sql import functions as F

from helpers import HOUR, MINUTE, START, frame
from wardline.operators import features, profiles as P, timeline
from wardline.operators.bounded_lists import CHUNK
from wardline.operators.timeline import dealt_join, sliced
from wardline.operators.windows import Spans
from wardline.schema import FEATURES
from wardline.sources import telemetry as T


@pytest.fixture
def plain_joins(spark):
    """As on large tables: nothing is broadcast, and small partitions are not merged."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def largest_share(rows):
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("sent", [0, 1000])
def test_facts_of_one_broad_key_are_dealt_over_tasks(spark, plain_joins, monkeypatch, sent):
    monkeypatch.setattr(timeline, "SENT_KEYS", sent)
    events = frame(spark, [{} for _ in range(400)])
    placed = P.positions(events).localCheckpoint()
    everything = P.ProfilePolicy(entity_minimum=10 ** 6, peer_minimum=10 ** 6)
    facts = P.facts_of(placed, P.choose_baseline(placed, everything).localCheckpoint())
    assert facts.count() == 400 and {r["key"] for r in facts.select("key").distinct().collect()} == {"global:organization"}
    assert largest_share(facts) < .5


def test_a_dealt_join_is_a_join(spark, plain_joins):
    rows = spark.createDataFrame([(k, i) for i in range(60) for k in ("a", "b", None)], "key string, id int")
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("c", 4)], "key string, v int")
    for how in ("inner", "left_semi", "left"):
        want = rows.join(table, ["key"], how)
        assert sorted(dealt_join(rows, table, ["key"], "id", how, 7).collect(), key=str) == sorted(want.collect(), key=str), how


@pytest.mark.parametrize("sent", [0, 1000])
def test_wanted_lists_are_those_of_a_semi_join_before(spark, monkeypatch, sent):
    monkeypatch.setattr(timeline, "SENT_KEYS", sent)
    events = frame(spark, [{"resource_id": f"r{i % 7}", "entity_id": f"clerk-{i % 3}"} for i in range(40)])
    policy = P.ProfilePolicy(value_limits={**P.ProfilePolicy().value_limits, "resource": 4}, list_chunk=11)
    wanted = spark.createDataFrame([("", "global:organization"), ("", "entity:clerk-1")], "scope string, key string")
    every = P.first_sightings(events, None, policy)
    want = sorted(every.join(wanted, P.KEYS, "left_semi").select("key", "dim", "value", "first_at", "gone_at").collect(), key=str)
    assert sorted(P.first_sightings(events, wanted, policy).select("key", "dim", "value", "first_at", "gone_at").collect(), key=str) == want
    few = P.first_sightings(events, None, policy, dims=("resource",), kinds=("global", "entity"))
    assert {(r["dim"], r["key"].split(":")[0]) for r in few.collect()} == {("resource", "global"), ("resource", "entity")}
    assert few.count() == every.where("dim = 'resource' AND split(key, ':')[0] IN ('global', 'entity')").count()


def test_slices_hold_a_chunk_of_each_key(spark):
    rows = spark.range(1, 24).select(F.col("id").alias("position"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("key"))
    parts = [sorted((r["key"], r["position"]) for r in part.collect()) for part in sliced(rows, "position", 10, ["key"])]
    assert parts == [[(k, p) for k in "ab" for p in range(a, min(a + 10, 24))] for a in (1, 11, 21)]
    assert list(sliced(rows.limit(0), "position", 10, ["key"]))[0].isEmpty()
    assert CHUNK <= 200_000


def test_a_source_is_dealt_by_its_rows(spark, small, monkeypatch):
    monkeypatch.setattr(T, "ROWS_A_TASK", 25)
    rows = spark.read.parquet(f"{small}/events.parquet").count()
    dealt = T.telemetry(spark, small)
    assert dealt.rdd.getNumPartitions() >= rows // 25 and dealt.count() == rows


def test_cold_replays_need_the_last_facts_only(spark, monkeypatch):
    """Finished profiles far longer than their limits give the same features from what they still hold."""
    training = frame(spark, [{"event_id": f"t{i:03d}", "us": START + i * 7 * MINUTE, "resource_id": f"r{i % 5}", "bytes_downloaded": 100 + i * i % 37 * 50,
                              "is_external_destination": i % 3 == 0, "session_duration_seconds": i * 11 % 300} for i in range(90)])
    attacks = frame(spark, [{"event_id": f"a{i}", "us": START + 95 * 7 * MINUTE + i * HOUR, "label": "brute_force", "scenario_id": f"s{i}", "entity_id": f"cold-{i}",
                             "device_id": f"cold-device-{i}", "is_external_destination": i % 2 == 0, "resource_id": f"r{i}"} for i in range(4)])
    policy = P.ProfilePolicy(numeric_limit=6, log_limit=8, chunk=16)
    kept = []
    last_facts = P.last_facts

    def counted(facts, policy):
        kept.append((facts.count(), last_facts(facts, policy).groupBy("key").count().agg(F.max("count")).first()[0]))
        return last_facts(facts, policy)

    spans, cut = Spans(), lambda df: df.localCheckpoint()
    monkeypatch.setattr(P, "last_facts", counted)
    few = features.cold_start_features(attacks, training, spans, policy, cut=cut)
    got = sorted(tuple(r) for r in few.select("event_id", *[F.round(f, 9) for f in FEATURES]).collect())
    monkeypatch.setattr(P, "last_facts", lambda facts, policy: facts)
    whole = features.cold_start_features(attacks, training, spans, policy, cut=cut)
    assert got == sorted(tuple(r) for r in whole.select("event_id", *[F.round(f, 9) for f in FEATURES]).collect()) and len(got) == 4
    assert kept[0][0] == 90 and kept[0][1] <= 2 * 9

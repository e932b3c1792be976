import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import MINUTE, START
from wardline.operators import incidents as I
from wardline.streaming.incident_store import IncidentStore
from wardline.streaming.seen_ids import SeenIds, holds, places, with_ids


def test_filters_hold_what_they_took():
    rng = np.random.default_rng(1)
    first, second = rng.integers(-(1 << 62), 1 << 62, 2000), rng.integers(-(1 << 62), 1 << 62, 2000)
    bits = with_ids(bytes(1000 * 4), places(first[:1000], second[:1000], 32_000))
    found = holds(bits, places(first, second, 32_000))
    assert found[:1000].all() and found[1000:].sum() <= 2


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "event_id string")


def test_first_batch_wins_and_reads_do_not_grow(spark, tmp_path):
    store, seen, reads = SeenIds(spark, str(tmp_path), buckets=4, capacity=60), set(), []
    rng = random.Random(2)
    for batch in range(10):
        values = [f"b{batch}-{i}" for i in range(100)] + (rng.sample(sorted(seen), 3) if seen and batch % 3 == 0 else [])
        rows = ids(spark, values)
        suspects = store.suspects(rows, batch)
        stored = store.stored(suspects, batch)
        reads.append(0 if stored is None else stored.count())
        fresh = store.unseen(rows, batch)
        assert {r[0] for r in fresh.collect()} == set(values) - seen
        store.store(fresh, batch)
        seen |= set(values)
    # Batches without repeats read no stored id; others at most three generations of a bucket, early or late.
    assert [reads[b] for b in range(10) if b % 3] == [0] * 6 and max(reads) <= 3 * 100
    assert spark.read.parquet(store.closed).count() > 0
    # A replayed batch sees what was before it and writes its rows once.
    again = ids(spark, [f"b9-{i}" for i in range(100)])
    assert store.unseen(again, 9).count() == 100
    store.store(again, 9)
    assert store.unseen(again, 10).count() == 0 and spark.read.parquet(store.ids).where("batch_id = 9").count() == 100


def test_empty_batches_and_nulls(spark, tmp_path):
    store = SeenIds(spark, str(tmp_path), buckets=2)
    assert store.unseen(ids(spark, []), 0).count() == 0
    store.store(ids(spark, []), 0)
    assert store.unseen(ids(spark, ["a"]), 1).count() == 1


@pytest.fixture(scope="module")
def alerts(spark):
    rng = random.Random(3)
    rows = [(f"e{i:03d}", f"u{i % 3}", START + i * 37 * MINUTE // (1 + i % 2), rng.choice([50.0, 60.004, 60.001, 80.0]), rng.choice(["brute_force", "device_spoofing"]), "high") for i in range(90)]
    return spark.createDataFrame(rows, "event_id string, entity_id string, us bigint, risk_score double, predicted_attack string, severity string").cache()


def as_set(df):
    return sorted(map(tuple, df.select("incident_key", "event_count", "risk_score", "event_id", "us", "last_us", "created_us", "severity").collect()))


def test_incidents_in_any_cut(spark, alerts, tmp_path):
    want = as_set(I.correlate(alerts))
    for cuts in (1, 3):
        store = IncidentStore(spark, str(tmp_path / f"cut{cuts}"))
        for batch in range(cuts):
            store.upsert(I.correlate(alerts.where(F.crc32("event_id") % cuts == batch)), batch)
        assert as_set(store.incidents()) == want


def test_replayed_and_late_batches(spark, alerts, tmp_path):
    store = IncidentStore(spark, str(tmp_path / "late"))
    early, late = alerts.where(F.col("us") < START + 600 * MINUTE), alerts.where(F.col("us") >= START + 600 * MINUTE)
    store.upsert(I.correlate(late), 0)
    store.upsert(I.correlate(late.limit(0)), 1)
    for _ in range(3):
        store.upsert(I.correlate(early), 2)
    assert as_set(store.incidents()) == as_set(I.correlate(alerts))
    # A replay with other rows leaves nothing of its first run.
    store.upsert(I.correlate(late.where("us % 2 = 0")), 0)
    assert as_set(store.incidents()) == as_set(I.correlate(early.unionByName(late.where("us % 2 = 0"))))


def test_a_batch_reads_its_own_cells(spark, alerts, tmp_path):
    store = IncidentStore(spark, str(tmp_path / "cells"), buckets=2)
    for batch in range(3):
        store.upsert(I.correlate(alerts.where(F.crc32("event_id") % 3 == batch)), batch)
    days = {r[0] for r in spark.read.parquet(store.fragments).select(F.col("day").cast("string")).distinct().collect()}
    one = store.touched([(min(days), 0)])
    assert len(days) > 1 and {(str(r["day"]), r["bucket"]) for r in one.collect()} == {(min(days), 0)} and len({f.split("day=")[1][:10] for f in one.inputFiles()}) == 1

"""What large tables leave on disk: shuffle files, facts nobody asks for, values no quantile needs; and the rounds of boosted trees."""

import time

import pytest
from pyspark.sql import functions as F

from helpers import HOUR, START, frame
from wardline.operators import classifier, profiles as P, scaling, timeline
from wardline.operators import windows as W
from wardline.plans import queries_models
from wardline.session import cut_lineage, made_tables, release


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    cut = cut_lineage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count())
    deadline = time.time() + 20
    while shuffle_files(spark) > before and time.time() < deadline:
        time.sleep(.2)
    assert shuffle_files(spark) <= before and cut.count() == 700


def test_made_tables_can_be_released(spark):
    with made_tables() as made:
        table = cut_lineage(spark.range(10))
    path = table._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    assert made == [table] and system.exists(file)
    release(table)
    release(table)
    release(spark.range(3))
    assert not system.exists(file)


def history(spark):
    rows = [{"event_id": f"e{i:03d}", "us": START + i * HOUR // 4, "entity_id": f"clerk-{i % 2}", "device_id": f"pc-{i % 3}", "resource_id": f"r{i % 5}",
             "bytes_downloaded": 100 + i * i % 37 * 50, "is_external_destination": i % 3 == 0} for i in range(120)]
    return frame(spark, rows)


@pytest.mark.parametrize("sent", [0, 1000])
def test_facts_end_with_the_last_event_that_asks(spark, monkeypatch, sent):
    """Broad keys are asked for early on only; the features are those of all facts."""
    monkeypatch.setattr(timeline, "SENT_KEYS", sent)
    events, policy = history(spark), P.ProfilePolicy(entity_minimum=3, peer_minimum=5, numeric_limit=6, log_limit=8, chunk=16)
    placed = P.positions(events).localCheckpoint()
    chosen = P.choose_baseline(placed, policy).localCheckpoint()
    facts = P.facts_of(placed, chosen).localCheckpoint()
    whole = (placed.where("trusted").join(chosen.select(*P.KEYS).distinct(), P.KEYS, "left_semi")
             .withColumn("n", F.col("facts_before") + 1).withColumn("m", F.col("transfers_before") + 1).localCheckpoint())
    broad = F.col("key") == "global:organization"
    assert whole.where(broad).count() == 120 and 0 < facts.where(broad).count() < 20
    since = W.travel_features(events).select("event_id", "seconds_since_last").localCheckpoint()

    def values(of):
        numeric = P.numeric_features(events, chosen, of, since, policy).localCheckpoint()
        ranges = P.range_features(events, chosen, of, numeric, W.Spans(day=HOUR * 3, month=HOUR * 9), policy)
        return sorted(map(str, numeric.join(ranges, "event_id").collect()))

    assert values(facts) == values(whole) and len(values(facts)) == 120


@pytest.mark.parametrize("sent", [0, 1000])
def test_sightings_end_with_the_last_event_that_asks(spark, monkeypatch, sent):
    monkeypatch.setattr(P, "few_keys", lambda wanted: sent > 0)
    events = history(spark)
    policy = P.ProfilePolicy(entity_minimum=3, peer_minimum=5, value_limits={**P.ProfilePolicy().value_limits, "resource": 3}, list_chunk=11)
    chosen = P.choose_baseline(P.positions(events), policy).localCheckpoint()
    timed = P.first_sightings(events, P.asked_keys(chosen).drop("asked_n"), policy).localCheckpoint()
    whole = P.first_sightings(events, chosen.select(*P.KEYS).distinct(), policy).localCheckpoint()
    broad = (F.col("key") == "global:organization") & (F.col("dim") == "resource")
    assert timed.where(broad).count() < whole.where(broad).count()
    assert (sorted(map(str, P.novelty_features(events, chosen, timed, policy).collect()))
            == sorted(map(str, P.novelty_features(events, chosen, whole, policy).collect())))


def test_quantiles_of_columns_count_few_values(spark):
    rows = spark.range(4000).select(
        (F.col("id") * 7 % 4000 / 13.0 - 90).alias("wide"), F.when(F.col("id") % 9 > 0, F.col("id") % 4 * 1.0).alias("ties"), F.lit(0.25).alias("one"),
        (F.col("id") % 100 * 1e-7).alias("narrow"), F.when(F.col("id") % 50 == 0, float("nan")).otherwise(-(F.col("id") * 1.0)).alias("odd"),
        F.lit(None).cast("double").alias("none"))
    fractions = (.02, .1, .5, .9, .995)
    with made_tables() as made:
        got = sorted(map(str, scaling.column_quantiles(rows, rows.columns, fractions).collect()))
    assert got == sorted(map(str, scaling.long_quantiles(scaling.unpivot(rows, rows.columns), fractions).collect())) and len(got) == 5
    assert made[-1].where("name = 'wide'").count() < 1000


def test_boosted_trees_take_all_rounds(spark, small, monkeypatch):
    sizes = []

    class Stop(Exception):
        pass

    def fit(self, rows, vector, label="label"):
        sizes.append((self.kind, self.rounds))
        raise Stop

    monkeypatch.setattr(classifier.AttackClassifier, "fit", fit)
    with pytest.raises(Stop):
        queries_models.boosted(spark, small)
    assert sizes == [("boosted_trees", 360)]

import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import risk as R
from wardline.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distance_and_speed(spark):
    km = one(spark, S.great_circle_km(F.lit(51.5074), F.lit(-.1278), F.lit(40.7128), F.lit(-74.006)))
    assert 5500 < km < 5700
    assert one(spark, S.required_speed(F.lit(100.0), F.lit(0.0))) == 20_000
    assert one(spark, S.required_speed(F.lit(100.0), F.lit(2.0))) == 50


def test_circular_hours(spark):
    assert one(spark, S.circular_hours(F.lit(23.5), F.lit(.5))) == 1.0


def test_print_distance(spark):
    assert one(spark, S.padded_distance(F.lit("abc"), F.lit("abc"))) == 0
    assert one(spark, S.padded_distance(F.lit("abcd"), F.lit("ab"))) == .5
    assert one(spark, S.nearest_print(F.lit("ab"), F.array().cast("array<string>"))) == .35


def test_guarded_z(spark):
    assert one(spark, S.guarded_z(F.lit(9.0), F.lit(1), F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, S.guarded_z(F.lit(9.0), F.lit(2), F.lit(4.0), F.lit(.1))) == 5
    assert one(spark, S.guarded_z(F.lit(900.0), F.lit(2), F.lit(4.0), F.lit(.1))) == 20


def test_finite(spark):
    assert one(spark, S.finite(F.lit(float("nan")))) == 0
    assert one(spark, S.finite(F.lit(float("-inf")))) == 0
    assert one(spark, S.finite(F.lit(None).cast("double"))) == 0
    assert one(spark, S.finite(F.lit(-2.5))) == -2.5


def test_rounding_is_pythons(spark):
    rng = random.Random(7)
    values = [2.675, 1.005, .125, .375, 28.995, 29.005, 0.0, 100.0, 43.125, 1e-9] + [round(rng.uniform(0, 100), 3) for _ in range(3000)]
    values += [rng.uniform(0, 100) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", S.python_round("v", 2).alias("r")).collect():
        assert row["r"] == round(row["v"], 2), row


def test_display(spark):
    assert one(spark, S.display_class(F.lit("brute_force"), F.lit(.5))) == "Possible Brute Force"
    assert one(spark, S.display_class(F.lit("normal"), F.lit(.5))) == "Normal"
    assert one(spark, S.display_name(F.lit("user-alpha"))) == "User Alpha"


def test_partition_number(spark):
    df = spark.range(200).select(S.partition_number(F.concat(F.lit("entity-"), F.col("id").cast("string")), 32).alias("p"))
    assert df.distinct().count() >= 28
    with pytest.raises(ValueError):
        S.partition_number("x", 0)


def test_risk_bounds_and_weights(spark):
    assert one(spark, R.bounded_risk(*[F.lit(5.0)] * 5)) == 100
    assert abs(one(spark, R.combined_risk(*[F.lit(1.0)] * 5)) - 100) < 1e-9
    with pytest.raises(ValueError):
        R.checked_weights({"anomaly": .5, "sequence": .2})
    assert one(spark, R.severity(F.lit(49.999))) == "medium"
    assert one(spark, R.severity(F.lit(70.0))) == "critical"
    assert one(spark, R.recommended_actions(F.lit("normal"), F.lit("critical")))[1].startswith("Escalate")

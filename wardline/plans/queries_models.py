"""Queries that fit models. Forests have their full size, with invariants in SQL, and boosted trees all rounds; the other models are small. Inputs are whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.scalar import criticality, hour_of_day
from wardline.operators import classifier as C
from wardline.operators import forest, reservoir, scaling, windows
from wardline.plans import scoring, training
from wardline.plans.queries_base import SPANS, feature_table
from wardline.plans.queries_risk import with_history
from wardline.plans.registry import ALERT, BEHAVIOUR, PRIORITY, events, over_t, query, r6
from wardline.schema import FEATURES, TEMPORAL_FEATURES
from wardline.session import cut_lineage, made_tables, release

PLAN = training.TrainingPlan(trees=12, domain_trees=8, sample=256, classifier_trees=6, classifier_depth=5, rounds=2, folds=2, spans=SPANS)
COLUMNS = ("resource_sensitivity", "anomaly_score", "sequence_anomaly_score", "deviation", "hour", "log_bytes")
def vectors(spark, d):
    rows = events(spark, d).withColumns({"hour": hour_of_day("us") / 24.0, "log_bytes": F.log1p(F.col("bytes_downloaded").cast("double")) / 20.0})
    return rows.select("event_id", "us", "entity_id", "scenario_id", "label", "split", F.array(*[F.col(c).cast("double") for c in COLUMNS]).alias("vector"))


FULL = training.TrainingPlan(spans=SPANS)


def scaled_features(spark, d):
    """The 32 features of every event and their vector under the scaler of the normal rows."""
    with made_tables() as parts:
        features = feature_table(spark, d)
    rows = cut_lineage(features.select("event_id", *FEATURES).join(events(spark, d).select("event_id", "label"), "event_id"))
    for table in parts:
        release(table)
    scaler = scaling.scaler_parameters(scaling.fit_scaler(rows.where("label = 'normal'"), FEATURES, stored=True))
    scaled = cut_lineage(scoring.scale(rows, scaler).select("event_id", "label", "scaled"))
    release(rows)
    return scaled


TREES_SQL = """plans AS (SELECT 'global' AS forest, 280 AS trees UNION ALL SELECT unnest(['authentication_api', 'identity_device_geo', 'resource_network', 'volume_timing']), 180)"""


@query("m03_m04_forest_nodes", over_t(f""", {TREES_SQL} SELECT forest, CAST(unnest(range(trees)) AS BIGINT) AS tree, true AS binary_tree, true AS parents_add_up,
 (SELECT least(2048, count(*)) FROM t WHERE label = 'normal') AS sample, (SELECT least(2048, count(*)) FROM t WHERE label = 'normal') AS leaf_rows FROM plans"""))
def nodes(spark, d):
    """All 1,000 trees at full size: each is a whole binary tree, holds its sample in the leaves and each parent's rows in its children."""
    normal = scaled_features(spark, d).where("label = 'normal'")
    grown = cut_lineage(forest.fit_forests(normal, "scaled", forest.default_plans(FULL.trees, FULL.domain_trees, FULL.seed), FULL.sample))
    leaf, parts = F.col("feature") < 0, grown.select("forest", "tree", F.floor((F.col("node") + 1) / 2).alias("pair"), "node", "mass")
    # Numbered level by level, the children of the k-th split of a tree are the nodes 2k - 1 and 2k.
    split = grown.where(~leaf).select("forest", "tree", F.floor((F.col("left") + 1) / 2).alias("pair"), F.col("mass").alias("parent"))
    sums = parts.where("node > 0").groupBy("forest", "tree", "pair").agg(F.sum("mass").alias("children"))
    fits = sums.join(split, ["forest", "tree", "pair"], "full").groupBy("forest", "tree").agg(F.every(F.coalesce(F.col("children") == F.col("parent"), F.lit(False))).alias("parents_add_up"))
    trees = grown.groupBy("forest", "tree").agg((F.count("*") == 2 * F.count_if(leaf) - 1).alias("binary_tree"),
                                                F.max(F.when(F.col("node") == 0, F.col("mass"))).alias("sample"), F.sum(F.when(leaf, F.col("mass"))).alias("leaf_rows"))
    return trees.join(fits, ["forest", "tree"], "left").select("forest", F.col("tree").cast("long").alias("tree"), "binary_tree", F.coalesce("parents_add_up", F.lit(True)).alias("parents_add_up"), "sample", "leaf_rows")


@query("m05_forest_scores")
def forest_scores(spark, d):
    rows = scaled_features(spark, d)
    model = training.grow_forests(rows.where("label = 'normal'"), FULL)
    raw = cut_lineage(forest.raw_scores(rows, "scaled", model).drop("scaled"))  # every row walks the trees once
    release(rows)
    scored = forest.anomaly_scores(raw, forest.fit_ranges(raw.where("label = 'normal'"), model, stored=True))
    return scored.select("event_id", "label", r6("anomaly_score").alias("anomaly_score"), *[r6(c).alias(c) for c in scored.columns if c.startswith("if_")])


@query("m05_score_ranges", over_t(f""", {TREES_SQL} SELECT forest, (SELECT count(*) FROM t) AS rows, 0.0 AS least, 1.0 AS most, CAST(0 AS BIGINT) AS blend_errors,
 true AS top_reached, true AS bottom_reached FROM plans"""))
def score_ranges(spark, d):
    """Full-size scores: scores reach 0 and 1, at least the normal rows from the 99.5% quantile on lie at 1, those up to the 2% quantile at 0, the blend is the documented one."""
    scored = cut_lineage(forest_scores(spark, d))
    names = [p.name for p in forest.default_plans()]
    domains = [f"if_{n}_score" for n in names if n != "global"]
    blend = .35 * F.col("if_global_score") + .45 * F.greatest(*domains) + .2 * sum((F.col(c) for c in domains), F.lit(0.0)) / len(domains)
    wrong = F.abs(F.col("anomaly_score") - F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend))) > 1e-5
    each = scored.select("label", wrong.alias("wrong"), F.explode(F.array(*[F.struct(F.lit(n).alias("forest"), F.col(f"if_{n}_score").alias("score")) for n in names])).alias("s"))
    normal = F.col("label") == "normal"
    last = F.count_if(normal) - 1
    return each.groupBy("s.forest").agg(
        F.count("*").alias("rows"), F.min("s.score").alias("least"), F.max("s.score").alias("most"), F.count_if("wrong").alias("blend_errors"),
        (F.count_if(normal & (F.col("s.score") >= 1)) >= last + 1 - F.ceil(last * .995)).alias("top_reached"),
        (F.count_if(normal & (F.col("s.score") <= 0)) >= F.floor(last * .02) + 1).alias("bottom_reached"))


def per_class(scored, name):
    """One row per event and class. The map has every class, so the outer form gives the same rows.

    Spark puts a filter on the exploded map's size before the inner form and computes all models for it once more.
    """
    return scored.select("event_id", F.explode_outer(name).alias("label", "p")).select("event_id", "label", r6("p").alias("probability"))


def _probability_rows(kind, spark, d, **size):
    rows = vectors(spark, d)
    model = C.AttackClassifier(kind, 42, **size).fit(rows.where("split = 'train'"), "vector")
    scored = model.raw(rows, "vector")
    return per_class(scored, "raw_probabilities")


@query("m07_random_forest")
def random_forest(spark, d):
    return _probability_rows("random_forest", spark, d, trees=6, depth=5)


@query("m08_boosted_trees")
def boosted(spark, d):
    """All 360 rounds of every class."""
    return _probability_rows("boosted_trees", spark, d)


@query("m10_calibration")
def calibration(spark, d):
    rows = vectors(spark, d)
    model = C.AttackClassifier("random_forest", 42, trees=6, depth=5).fit(rows.where("split = 'train'"), "vector")
    model.calibrate(rows.where("split = 'validation'"), "vector")
    scored = model.probabilities(rows.where("split = 'test'"), "vector")
    return per_class(scored, "class_probabilities")


@query("m13_cold_augmentation")
def cold_augmentation(spark, d):
    return training.cold_augmentation(events(spark, d).drop("trusted"), PLAN).select("event_id", "entity_id", "label", "baseline_kind", *[r6(f).alias(f) for f in FEATURES])


@query("m14_out_of_fold")
def out_of_fold(spark, d):
    rows = vectors(spark, d).where("split = 'train'")
    scored = C.out_of_fold(rows, "vector", lambda fold: C.AttackClassifier("random_forest", 143 + fold, trees=4, depth=4), folds=2)
    return scored.select("event_id", "fold", r6(F.col("raw_probabilities")["normal"]).alias("normal"))


@query("m18_m19_m22_sequence_scores")
def sequence_scores(spark, d):
    rows = vectors(spark, d)
    model = reservoir.fit(rows.where("split = 'train'"), "vector", reservoir.Reservoir(len(COLUMNS), hidden=16))
    return reservoir.score(rows, "vector", model).select("event_id", r6("sequence_anomaly_score").alias("sequence_anomaly_score"))


@query("m23_validation_parts", over_t(""", v AS (SELECT * FROM t WHERE split = 'validation'), f AS (SELECT label, count(*) AS total FROM v GROUP BY 1),
 s AS (SELECT scenario_id, count(*) AS n, min_by(v.label, struct_pack(a := f.total, b := v.label)) AS kind FROM v JOIN f USING (label) GROUP BY 1),
 p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, scenario_id) - 1 AS place FROM s)
 SELECT v.event_id, CASE place % 3 WHEN 0 THEN 'calibration' WHEN 1 THEN 'selection' ELSE 'threshold' END AS part FROM v JOIN p USING (scenario_id)"""))
def parts(spark, d):
    return C.validation_parts(events(spark, d).where("split = 'validation'")).select("event_id", "part")


def feature_rows(spark, d):
    """Feature rows with the windowed features computed and the others standing in from telemetry."""
    rows = events(spark, d)
    narrow = rows.select(
        "event_id", "us", "entity_id", "label", "scenario_id", "split", criticality("resource_sensitivity", "is_privileged_action").alias("criticality"),
        F.lit("entity").alias("baseline_kind"), F.lit(.8).alias("baseline_confidence"), F.col("anomaly_score").cast("double").alias("_a"), "deviation",
        (F.col("device_id") != F.col("claimed_device_id")).cast("double").alias("claimed_observed_device_mismatch_score"))
    joined = narrow.join(windows.minute_features(rows, SPANS), "event_id")
    spare = [f for f in FEATURES if f not in joined.columns]
    stand_in = {f: (F.col("_a") if i % 2 else F.col("deviation")) * (i % 5) for i, f in enumerate(spare)}
    return joined.withColumns(stand_in).drop("_a", "deviation")


def small_bundle(rows):
    """A bundle fitted on the training split of `feature_rows`."""
    train = rows.where("split = 'train'")
    scaler = scaling.scaler_parameters(scaling.fit_scaler(train.where("label = 'normal'"), FEATURES))
    scaled = cut_lineage(scoring.scale(train, scaler))
    forests, ranges = training.fit_anomaly(scaled.where("label = 'normal'").select("event_id", "scaled"), PLAN)
    model = C.AttackClassifier("random_forest", 42, trees=6, depth=5).fit(scaled, "scaled")
    sequence = reservoir.fit(scaled.withColumn("temporal", scoring.temporal_vector()), "temporal", reservoir.Reservoir(len(TEMPORAL_FEATURES)))
    return scoring.Bundle("query", scaler, forests, ranges, sequence, model, behaviour_threshold=.6, alert_threshold=ALERT, priority_threshold=PRIORITY)


@query("m26_inference")
def inference(spark, d):
    rows = cut_lineage(feature_rows(spark, d))
    scored = scoring.infer(rows, small_bundle(rows))
    return scored.select("event_id", "predicted_attack", "severity", r6("risk_score").alias("risk_score"), r6("anomaly_score").alias("anomaly_score"),
                         r6("sequence_anomaly_score").alias("sequence_anomaly_score"), "explanation")


@query("e09_cold_challenge")
def challenge(spark, d):
    bundle = small_bundle(cut_lineage(feature_rows(spark, d)))
    rows = events(spark, d)
    return training.cold_challenge(rows.where("split <> 'train'").drop("trusted"), rows.where("split = 'train'"), bundle, PLAN)


@query("e14_evaluation_report")
def report(spark, d):
    bundle = scoring.Bundle("stand-in", {}, None, {}, None, None, alert_threshold=ALERT, behaviour_threshold=BEHAVIOUR, priority_threshold=PRIORITY)
    wide = training.evaluation_report(with_history(spark, d), bundle)
    return wide.select(*[c for c, kind in wide.dtypes if kind in ("bigint", "double", "int")])

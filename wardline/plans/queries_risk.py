"""Scaling, score arithmetic, risk, thresholds and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import risk as R
from wardline.functions.scalar import python_round
from wardline.operators import corpus, evaluate as E, explain, profiles, scaling, scores, windows
from wardline.plans import oracle as O
from wardline.plans.registry import (ALERT, BEHAVIOUR, PARTS, PRIORITY, SEVERITY_SQL, d6, events, over_scored, over_t, query, r6,
                                     rounded, scored)
from wardline.schema import ATTACKS, CLASS_ACTIONS, CLASSES, COMMON_ACTIONS, ESCALATION



def alerted():
    return F.col("risk_score") >= ALERT


def flagged():
    return F.col("behaviour") >= BEHAVIOUR


# ---- scaler and score arithmetic -----------------------------------------------------------------------

MEASURES = ("resource_sensitivity", "bytes_uploaded", "session_duration_seconds", "anomaly_score", "flat")


def measured(spark, d):
    return events(spark, d).withColumn("flat", F.lit(3.0)).withColumn("anomaly_score", F.col("anomaly_score").cast("double"))


SCALER_SQL = """m AS (UNPIVOT (SELECT event_id, label, CAST(resource_sensitivity AS DOUBLE) AS resource_sensitivity, CAST(bytes_uploaded AS DOUBLE) AS bytes_uploaded,
  CAST(session_duration_seconds AS DOUBLE) AS session_duration_seconds, CAST(anomaly_score AS DOUBLE) AS anomaly_score, CAST(3.0 AS DOUBLE) AS flat FROM t)
  ON resource_sensitivity, bytes_uploaded, session_duration_seconds, anomaly_score, flat INTO NAME name VALUE value),
fitted AS (SELECT name, quantile_cont(value, 0.5) AS center, CASE WHEN quantile_cont(value, 0.9) = quantile_cont(value, 0.1) THEN 1.0
  ELSE quantile_cont(value, 0.9) - quantile_cont(value, 0.1) END / 2.5631031310892007 AS scale FROM m WHERE label = 'normal' GROUP BY 1)"""


@query("m01_scaler_fit", over_t(f", {SCALER_SQL} SELECT name, {d6('center')} AS center, {d6('scale')} AS scale FROM fitted"))
def scaler_fit(spark, d):
    return rounded(scaling.fit_scaler(measured(spark, d).where("trusted"), MEASURES))


@query("m02_scaler_transform", over_t(f", {SCALER_SQL} SELECT event_id, name, {d6('(value - center) / scale')} AS value FROM m JOIN fitted USING (name)"))
def scaler_transform(spark, d):
    rows = measured(spark, d)
    fitted = scaling.fit_scaler(rows.where("trusted"), MEASURES)
    return rounded(scaling.scaled_long(scaling.unpivot(rows, MEASURES, ["event_id"]), fitted)).select("event_id", "name", "value")


DOMAIN_COLUMNS = ("anomaly_score", "sequence_anomaly_score", "p_malicious", "deviation")


@query("m05_range_normalise", over_t(f""", r AS (SELECT quantile_cont(CAST(anomaly_score AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(anomaly_score AS DOUBLE), 0.995) AS hi FROM t WHERE trusted)
 SELECT event_id, {d6('least(1.0, greatest(0.0, (anomaly_score - lo) / greatest(hi - lo, 1e-9)))')} AS value FROM t, r"""))
def normalise(spark, d):
    rows = measured(spark, d)
    bounds = scores.score_range(rows.where("trusted"), "anomaly_score")
    return scores.normalised(rows, "anomaly_score", bounds).select("event_id", r6("value").alias("value"))


@query("m06_ensemble_blend", over_t(f"""SELECT event_id, {d6('least(1.0, greatest(0.0, 0.35 * anomaly_score + 0.45 * greatest(anomaly_score, sequence_anomaly_score, p_malicious, deviation) + 0.20 * (anomaly_score + sequence_anomaly_score + p_malicious + deviation) / 4))')} AS score FROM t"""))
def blend(spark, d):
    return measured(spark, d).select("event_id", r6(scores.ensemble("anomaly_score", DOMAIN_COLUMNS)).alias("score"))


@query("m09_class_weights", over_t(f""", c AS (SELECT label, count(*) AS n FROM t GROUP BY 1), k AS (SELECT sum(n) AS total, count(*) AS classes FROM c),
 w AS (SELECT label, n, total / CAST(classes * n AS DOUBLE) AS balanced, sqrt((total / CAST(classes AS DOUBLE)) / n) AS raw FROM c, k),
 a AS (SELECT sum(raw * n) / sum(n) AS mean_raw FROM w)
 SELECT label, {d6('balanced')} AS balanced, {d6('least(12.0, greatest(0.2, raw / mean_raw))')} AS tempered FROM w, a"""))
def weights(spark, d):
    return rounded(scores.class_weights(events(spark, d)).select("label", "balanced", "tempered"))


PROBABILITY_SQL = """raw AS (SELECT event_id, p_malicious * 0.5 AS brute_force, sequence_anomaly_score * 0.3 AS device_spoofing, (1 - p_malicious) * 0.6 AS normal FROM t),
cal AS (SELECT event_id, 1 / (1 + exp(-(2.0 * brute_force - 0.5))) AS brute_force, 1 / (1 + exp(-(1.5 * device_spoofing - 0.2))) AS device_spoofing, normal FROM raw),
probs AS (SELECT event_id, brute_force / s AS brute_force, device_spoofing / s AS device_spoofing, normal / s AS normal FROM
  (SELECT *, greatest(brute_force + device_spoofing + normal, 1e-12) AS s FROM cal))"""
CALIBRATORS = {"brute_force": (2.0, -0.5), "device_spoofing": (1.5, -0.2), "normal": None}


def probabilities(spark, d):
    rows = events(spark, d).select("event_id", F.expr("p_malicious * 0.5D").alias("brute_force"),
                                   F.expr("sequence_anomaly_score * 0.3D").alias("device_spoofing"), F.expr("(1 - p_malicious) * 0.6D").alias("normal"))
    return rows.select("event_id", scores.calibrated_map({c: F.col(c) for c in CALIBRATORS}, CALIBRATORS).alias("probabilities"))


@query("m11_calibrated_probabilities", over_t(f", {PROBABILITY_SQL} SELECT event_id, {d6('brute_force')} AS brute_force, {d6('device_spoofing')} AS device_spoofing, {d6('normal')} AS normal FROM probs"))
def calibrated(spark, d):
    p = F.col("probabilities")
    return probabilities(spark, d).select("event_id", *[r6(p[c]).alias(c) for c in CALIBRATORS])


@query("m12_m15_r04_prediction", over_t(f""", {PROBABILITY_SQL} SELECT event_id,
 CASE WHEN brute_force >= device_spoofing AND brute_force >= normal THEN 'brute_force' WHEN device_spoofing >= normal THEN 'device_spoofing' ELSE 'normal' END AS predicted,
 {d6('greatest(brute_force, device_spoofing, normal)')} AS confidence, {d6('greatest(brute_force, device_spoofing)')} AS malicious,
 {d6('brute_force + device_spoofing')} AS attack_sum, CAST(6 AS BIGINT) AS attack_width FROM probs"""))
def prediction(spark, d):
    rows = probabilities(spark, d)
    attacks = scores.attack_probabilities("probabilities")
    return rows.select("event_id", R.best_class("probabilities", sorted(CALIBRATORS)).alias("predicted"),
                       r6(F.array_max(F.map_values("probabilities"))).alias("confidence"), r6(R.strongest_malicious("probabilities")).alias("malicious"),
                       r6(F.aggregate(attacks, F.lit(0.0), lambda a, x: a + x)).alias("attack_sum"), F.size(attacks).cast("long").alias("attack_width"))


@query("m16_enriched_vector", over_t(f"""SELECT event_id, CAST(42 AS BIGINT) AS width, {d6('anomaly_score * 32 + deviation * 4 + p_malicious * 6')} AS total FROM t"""))
def enriched(spark, d):
    rows = measured(spark, d)
    base = F.array_repeat(F.col("anomaly_score"), 32)
    vector = scores.enriched(base, F.array_repeat(F.col("deviation"), 4), F.array_repeat(F.col("p_malicious"), 6))
    return rows.select("event_id", vector.alias("v")).select("event_id", F.size("v").cast("long").alias("width"),
                                                             r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("m17_sequence_window", over_t(f"""SELECT event_id, count(*) OVER w AS held, {d6('coalesce(sum(anomaly_score) OVER w, 0)')} AS total,
 {d6('coalesce(first_value(anomaly_score) OVER w, -1)')} AS oldest FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY us, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""))
def sequence_window(spark, d):
    rows = measured(spark, d).select("event_id", "entity_id", "us", "anomaly_score")
    held = scores.entity_sequences(rows, F.array("anomaly_score"), 12, chunk=16)
    values = F.flatten("sequence")
    return held.select("event_id", F.size("sequence").cast("long").alias("held"),
                       r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)).alias("total"),
                       r6(F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(-1.0))).alias("oldest"))


@query("m20_m21_residual", over_t(f""", e AS (SELECT event_id, trusted, list_sum(list_sort([abs(anomaly_score - deviation), abs(p_malicious - deviation), abs(sequence_anomaly_score - deviation)], 'DESC')[1:2]) / 2 AS residual FROM t),
 r AS (SELECT quantile_cont(residual, 0.5) AS lo, quantile_cont(residual, 0.9975) AS hi FROM e WHERE trusted), n AS (SELECT *, greatest(0, (residual - lo) / greatest(hi - lo, 1e-9)) AS rel FROM e, r)
 SELECT event_id, {d6('residual')} AS residual, {d6('least(1.0, rel)')} AS clipped, {d6('1 - exp(-rel)')} AS bounded FROM n"""))
def residual(spark, d):
    rows = measured(spark, d).select("event_id", "trusted", scores.top_residual(
        F.array(*[F.col(c) for c in ("anomaly_score", "p_malicious", "sequence_anomaly_score")]),
        F.array(*[F.col("deviation")] * 3), 2).alias("residual"))
    bounds = scores.score_range(rows.where("trusted"), "residual", .5, .9975)
    clipped = scores.normalised(rows, "residual", bounds, "linear_clip", "clipped")
    return rounded(scores.normalised(clipped, "residual", bounds, "bounded_exp", "bounded").select("event_id", "residual", "clipped", "bounded"))


# ---- risk ------------------------------------------------------------------------------------------------

@query("r01_profile_deviation", over_t(f"""SELECT event_id, {d6("least(1.0, greatest(0.0, (least(abs(anomaly_score * 9 - 3), 5) + least(abs(deviation * -8), 5) + least(p_malicious, 5)) / 3 / 3))")} AS deviation_score FROM t"""))
def deviation(spark, d):
    v = F.array(F.expr("anomaly_score * 9.0D - 3.0D"), F.expr("deviation * -8.0D"), F.col("p_malicious"))
    return measured(spark, d).select("event_id", r6(R.profile_deviation(v)).alias("deviation_score"))


@query("r02_r03_r06_r07_risk", over_scored(f"""SELECT event_id, {d6('behaviour')} AS behaviour, {d6('risk_score')} AS risk_score,
 {SEVERITY_SQL} AS severity, {d6('(classifier_confidence + 0.55) / 2')} AS model_confidence FROM scored"""))
def risk(spark, d):
    return scored(spark, d).select("event_id", r6("behaviour").alias("behaviour"), r6("risk_score").alias("risk_score"), "severity",
                                   r6(R.model_confidence("classifier_confidence", F.lit(.55))).alias("model_confidence"))


@query("r05_routing", over_scored("""SELECT event_id, CASE WHEN behaviour >= 0.6 AND predicted_attack = 'normal' THEN
 CASE WHEN p_malicious * 0.5 >= deviation * 0.4 THEN 'brute_force' ELSE 'lateral_movement' END ELSE predicted_attack END AS routed FROM scored"""))
def routing(spark, d):
    table = F.create_map(F.lit("brute_force"), F.expr("p_malicious * 0.5D"), F.lit("lateral_movement"), F.expr("deviation * 0.4D"), F.lit("normal"), F.lit(.9))
    return scored(spark, d).select("event_id", R.routed_class("predicted_attack", "behaviour", table, BEHAVIOUR).alias("routed"))


@query("r08_composition", over_scored("""SELECT event_id, CAST(printf('%.1f', 100 * 0.30 * anomaly_score) AS DOUBLE) AS anomaly_part, CAST(printf('%.1f', 100 * 0.35 * deviation) AS DOUBLE) AS deviation_part,
 CAST(printf('%.1f', 100 * 0.05 * criticality) AS DOUBLE) AS criticality_part FROM scored"""))
def composition(spark, d):
    parts = R.risk_parts(*PARTS)
    return scored(spark, d).select("event_id", python_round(parts["behavioral_anomaly"], 1).alias("anomaly_part"),
                                   python_round(parts["profile_deviation"], 1).alias("deviation_part"), python_round(parts["resource_criticality"], 1).alias("criticality_part"))


IMPORTANCE = {"anomaly_score": .5, "sequence_anomaly_score": .3, "p_malicious": .9, "deviation": .1}


@query("r09_r11_top_features", over_t(f""", m AS (UNPIVOT (SELECT event_id, CAST(anomaly_score AS DOUBLE) AS anomaly_score, CAST(sequence_anomaly_score AS DOUBLE) AS sequence_anomaly_score,
  CAST(p_malicious AS DOUBLE) AS p_malicious, CAST(deviation AS DOUBLE) AS deviation FROM t) ON anomaly_score, sequence_anomaly_score, p_malicious, deviation INTO NAME feature VALUE value),
 s AS (SELECT *, abs(value) * (0.5 + CASE feature WHEN 'anomaly_score' THEN 0.5 WHEN 'sequence_anomaly_score' THEN 0.3 WHEN 'p_malicious' THEN 0.9 ELSE 0.1 END / 0.9) AS strength,
  CASE feature WHEN 'anomaly_score' THEN 0 WHEN 'sequence_anomaly_score' THEN 1 WHEN 'p_malicious' THEN 2 ELSE 3 END AS place FROM m)
 SELECT event_id, feature, {d6('value')} AS value, row_number() OVER (PARTITION BY event_id ORDER BY strength DESC, place DESC) AS rank FROM s QUALIFY rank <= 3"""))
def top_features(spark, d):
    rows = measured(spark, d)
    evidence = explain.contributions(rows, list(IMPORTANCE), {n: n for n in IMPORTANCE}, IMPORTANCE, 3)
    return evidence.select("event_id", F.posexplode("top_features").alias("p", "c")).select(
        "event_id", "c.feature", r6("c.value").alias("value"), (F.col("p") + 1).cast("long").alias("rank"))


EVIDENCE = ("failed_auth_count_1m", "source_ip_unique_entities_5m", "unique_destination_hosts_5m")


@query("r11_feature_evidence", f"""WITH {O.T}, {O.MINUTE_CTE}, m AS (UNPIVOT (SELECT event_id, {", ".join(EVIDENCE)} FROM minute) ON {", ".join(EVIDENCE)} INTO NAME feature VALUE value)
 SELECT event_id, feature, {d6('value')} AS value, CASE WHEN feature = 'failed_auth_count_1m' THEN 0.0 ELSE 1.0 END AS baseline, {d6('abs((value - 3) / 2.0)')} AS deviation FROM m""")
def evidence(spark, d):
    rows = windows.minute_features(events(spark, d), windows.Spans(O.SHORT, O.MEDIUM, O.WEEK, O.MONTH))
    rows = rows.withColumns({"scaled_" + n: (F.col(n) - 3) / 2.0 for n in EVIDENCE})
    items = explain.feature_evidence({n: n for n in EVIDENCE}, {n: "scaled_" + n for n in EVIDENCE})
    return rounded(rows.select("event_id", F.explode(items).alias("e")).select("event_id", "e.*"))


ACTIONS_SQL = f"CASE predicted_attack {' '.join(f"WHEN '{c}' THEN '{a}'" for c, a in CLASS_ACTIONS.items())} END"


@query("r10_r12_explanation", over_scored(f"""SELECT event_id, concat('Cold-start scoring used a peer/global baseline. ', 'Risk increased because anomaly score was ', printf('%.2f', anomaly_score),
  ', deviation was ', printf('%.2f', deviation), ' relative to the peer behavioral baseline.') AS text, concat({ACTIONS_SQL}, CASE WHEN {SEVERITY_SQL} = 'critical' THEN '; {ESCALATION}' ELSE '' END, '; {"; ".join(COMMON_ACTIONS)}') AS actions FROM scored"""))
def explanation(spark, d):
    rows = scored(spark, d)
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in ("anomaly_score", "deviation")])
    return rows.select("event_id", explain.sentence(items, F.lit("peer"), F.lit(True)).alias("text"),
                       F.array_join(R.recommended_actions("predicted_attack", "severity"), "; ").alias("actions"))


CURVE_SQL = """cand AS (SELECT DISTINCT {score} AS threshold FROM {table}), base_counts AS (SELECT count(*) FILTER (WHERE label <> 'normal') AS p, count(*) FILTER (WHERE label = 'normal') AS n FROM {table}),
agg AS (SELECT {score} AS s, count(*) FILTER (WHERE label <> 'normal') AS pos, count(*) FILTER (WHERE label = 'normal') AS neg FROM {table} GROUP BY 1),
cum AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM agg),
rated AS (SELECT s AS threshold, tp / greatest(p, 1) AS recall, tp / greatest(tp + fp, 1) AS prec, fp / greatest(n, 1) AS fpr FROM cum, base_counts)"""


def tuned_sql(table: str, score: str, limit: float) -> str:
    return f"""{CURVE_SQL.format(table=table, score=score)} SELECT {d6('threshold')} AS threshold, {d6('recall')} AS recall, {d6('prec')} AS "precision", {d6('fpr')} AS false_positive_rate
 FROM rated WHERE fpr <= {limit} ORDER BY recall DESC, prec DESC, fpr, threshold DESC LIMIT 1"""


@query("r13_alert_threshold", over_scored(", " + tuned_sql("scored", "risk_score", .1)))
def alert_threshold(spark, d):
    return rounded(E.tuned_threshold(scored(spark, d), "risk_score", .1).drop("alerts"))


@query("r14_behaviour_threshold", over_scored(", " + tuned_sql("scored", "behaviour", .05)))
def behaviour_threshold(spark, d):
    return rounded(E.tuned_threshold(scored(spark, d), "behaviour", .05).drop("alerts"))


@query("r15_budget", over_scored(f""", k AS (SELECT greatest(1, CAST(ceil(count(*) * 0.05) AS BIGINT)) AS k, count(*) AS n, count(*) FILTER (WHERE label <> 'normal') AS p FROM scored),
 r AS (SELECT deviation, label, row_number() OVER (ORDER BY deviation DESC, md5(event_id)) AS rn FROM scored), s AS (SELECT * FROM r, k WHERE rn <= k)
 SELECT max(k) AS budget_count, {d6("count(*) FILTER (WHERE label <> 'normal') / max(k)")} AS "precision", {d6("count(*) FILTER (WHERE label <> 'normal') / greatest(max(p), 1)")} AS recall,
  count(*) FILTER (WHERE label = 'normal') AS false_positives, {d6('min(deviation)')} AS threshold, {d6('max(k) / max(n)')} AS alert_rate FROM s"""))
def budget(spark, d):
    return rounded(E.budget_metrics(scored(spark, d), "deviation", .05).drop("budget_fraction"))


@query("r16_promotion_gate", over_scored(f""", m AS (SELECT split, count(*) FILTER (WHERE risk_score >= {ALERT} AND label <> 'normal') / greatest(count(*) FILTER (WHERE risk_score >= {ALERT}), 1) AS prec,
  count(*) FILTER (WHERE risk_score >= {ALERT} AND label = 'normal') / greatest(count(*) FILTER (WHERE label = 'normal'), 1) AS fpr,
  count(*) FILTER (WHERE risk_score >= {ALERT} AND label <> 'normal') / greatest(count(*) FILTER (WHERE label <> 'normal'), 1) AS rec FROM scored GROUP BY 1),
 g AS (SELECT n.rec >= o.rec * 0.98 AS a, n.fpr <= o.fpr + 0.001 AS b, n.prec >= o.prec * 0.95 AS c FROM m n, m o WHERE n.split = 'test' AND o.split = 'validation')
 SELECT a AS improves_f1, b AS controls_fpr, c AS preserves_precision, a AND b AND c AS activated FROM g"""))
def gate(spark, d):
    rows = E.alert_metrics(scored(spark, d), alerted(), ("split",)).withColumnRenamed("recall", "macro_f1")
    return E.promotion_gate(rows.where("split = 'validation'"), rows.where("split = 'test'"))


# ---- evaluation --------------------------------------------------------------------------------------------

ALERT_SQL = f"""count(*) FILTER (WHERE risk_score >= {ALERT}) AS alert_count, {d6(f'count(*) FILTER (WHERE risk_score >= {ALERT}) / count(*)')} AS alert_rate,
 {d6(f"count(*) FILTER (WHERE risk_score >= {ALERT} AND label <> 'normal') / greatest(count(*) FILTER (WHERE risk_score >= {ALERT}), 1)")} AS "precision",
 {d6(f"count(*) FILTER (WHERE risk_score >= {ALERT} AND label <> 'normal') / greatest(count(*) FILTER (WHERE label <> 'normal'), 1)")} AS recall,
 {d6(f"count(*) FILTER (WHERE risk_score >= {ALERT} AND label = 'normal') / greatest(count(*) FILTER (WHERE label = 'normal'), 1)")} AS false_positive_rate,
 count(*) FILTER (WHERE risk_score >= {ALERT} AND label = 'normal') AS false_positives"""


@query("e01_alert_metrics", over_scored(f"SELECT split, {ALERT_SQL} FROM scored GROUP BY 1"))
def alert_metrics(spark, d):
    return rounded(E.alert_metrics(scored(spark, d), alerted(), ("split",)))


@query("e02_scenario_recall", over_scored(f""", s AS (SELECT label, scenario_id, max((risk_score >= {ALERT})::INT) AS f FROM scored WHERE label <> 'normal' GROUP BY 1, 2)
 SELECT label, CAST(sum(f) AS BIGINT) AS detected, count(*) AS total, {d6('sum(f) / greatest(count(*), 1)')} AS recall FROM s GROUP BY 1
 UNION ALL SELECT 'all', CAST(sum(f) AS BIGINT), count(*), {d6('sum(f) / greatest(count(*), 1)')} FROM (SELECT scenario_id, max(f) AS f FROM s GROUP BY 1)"""))
def scenario_recall(spark, d):
    return rounded(E.scenario_recall(scored(spark, d), alerted()))


@query("e03_confusion", over_scored(""", c AS (SELECT label AS c FROM scored UNION SELECT predicted_attack FROM scored)
 SELECT a.c AS actual, p.c AS predicted, (SELECT count(*) FROM scored s WHERE s.label = a.c AND s.predicted_attack = p.c) AS n FROM c a, c p"""))
def confusion(spark, d):
    return E.confusion(scored(spark, d))


REPORT_SQL = """c AS (SELECT label AS c FROM scored UNION SELECT predicted_attack FROM scored),
k AS (SELECT c AS name, (SELECT count(*) FROM scored WHERE label = c) AS support, (SELECT count(*) FROM scored WHERE predicted_attack = c) AS given,
  (SELECT count(*) FROM scored WHERE predicted_attack = c AND label = c) AS hit FROM c),
pr AS (SELECT name, support, hit, CASE WHEN given > 0 THEN hit / given ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS r FROM k),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"""


@query("e04_e05_class_report", over_scored(f""", {REPORT_SQL}, rows AS (SELECT name, p, r, f1, support FROM f UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
 UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f
 UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f)
 SELECT name, {d6('p')} AS "precision", {d6('r')} AS recall, {d6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM rows"""))
def report(spark, d):
    return rounded(E.class_report(scored(spark, d)))


AUC_SQL = """g AS (SELECT candidate, score, count(*) FILTER (WHERE label <> 'normal') AS pos, count(*) FILTER (WHERE label = 'normal') AS neg FROM long GROUP BY 1, 2),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY candidate ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY candidate ORDER BY score DESC) AS fp,
  sum(pos) OVER (PARTITION BY candidate) AS p, sum(neg) OVER (PARTITION BY candidate) AS n FROM g)"""
LONG_SQL = """long AS (SELECT 'risk' AS candidate, risk_score AS score, label FROM scored UNION ALL SELECT 'deviation', deviation, label FROM scored
 UNION ALL SELECT 'one_class', deviation, 'normal' FROM scored)"""


def long_scores(spark, d):
    rows = scored(spark, d)
    pairs = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(c).alias("score"), lab.alias("label")) for n, c, lab in (
        ("risk", "risk_score", F.col("label")), ("deviation", "deviation", F.col("label")), ("one_class", "deviation", F.lit("normal")))])
    return rows.select(F.explode(pairs).alias("s")).select("s.*")


@query("e06_e07_m25_ranking_quality", over_scored(f""", {LONG_SQL}, {AUC_SQL} SELECT candidate, {d6('CASE WHEN max(p) = 0 OR max(n) = 0 THEN 0.0 ELSE sum(pos * (n - fp + neg / 2.0)) / greatest(max(p) * max(n), 1) END')} AS roc_auc,
 {d6('CASE WHEN max(p) = 0 OR max(n) = 0 THEN 0.0 ELSE sum(pos * tp / (tp + fp)) / greatest(max(p), 1) END')} AS pr_auc FROM cu GROUP BY 1"""))
def quality(spark, d):
    return rounded(E.ranking_quality(long_scores(spark, d), "score", E.attack(), ("candidate",)))


@query("m24_candidate_selection", over_scored(f""", {LONG_SQL}, {AUC_SQL}, q AS (SELECT candidate, CASE WHEN max(p) = 0 THEN 0.0 ELSE sum(pos * tp / (tp + fp)) / greatest(max(p), 1) END AS pr FROM cu GROUP BY 1)
 SELECT candidate, {d6('pr')} AS malicious_pr_auc FROM q ORDER BY pr DESC, candidate LIMIT 1"""))
def selection(spark, d):
    q = E.ranking_quality(long_scores(spark, d), "score", E.attack(), ("candidate",)).withColumnRenamed("pr_auc", "malicious_pr_auc")
    return rounded(scores.best_candidate(q.withColumn("macro_f1", F.lit(0.5))).select("candidate", "malicious_pr_auc"))


@query("m28_training_population", over_t("SELECT count(*) AS total_rows, count(*) FILTER (WHERE label = 'normal') AS normal_rows, count(*) FILTER (WHERE label <> 'normal') AS attack_rows FROM t WHERE split = 'train'"))
def population(spark, d):
    return scores.training_population(events(spark, d).where("split = 'train'"))


COLD = """b AS (SELECT s.*, ne_nd.subject_history_count, ne_nd.baseline_kind FROM scored s JOIN base ne_nd USING (event_id)),
p AS (SELECT *, unnest(CASE WHEN subject_history_count < 12 THEN ['cold', h] ELSE [h] END) AS bucket FROM (SELECT *, CASE WHEN subject_history_count < 1 THEN '0' WHEN subject_history_count < 3 THEN '1-2'
  WHEN subject_history_count < 12 THEN '3-11' ELSE '12+' END AS h FROM b))"""


def with_history(spark, d):
    rows = scored(spark, d)
    chosen = profiles.choose_baseline(profiles.positions(rows)).select("event_id", "subject_history_count", "baseline_kind")
    return rows.join(chosen, "event_id")


@query("e08_cold_start", over_scored(f""", {O.baseline_cte()}, {COLD} SELECT bucket, count(*) AS sample_count, count(*) FILTER (WHERE label = 'normal') AS normal_count, count(*) FILTER (WHERE label <> 'normal') AS attack_count,
 {d6(f"count(*) FILTER (WHERE label = 'normal' AND risk_score >= {ALERT}) / greatest(count(*) FILTER (WHERE label = 'normal'), 1)")} AS benign_false_positive_rate,
 {d6(f"count(*) FILTER (WHERE label <> 'normal' AND risk_score >= {ALERT}) / greatest(count(*) FILTER (WHERE label <> 'normal'), 1)")} AS attack_recall,
 {d6(f"count(*) FILTER (WHERE label <> 'normal' AND risk_score >= {ALERT}) / greatest(count(*) FILTER (WHERE risk_score >= {ALERT}), 1)")} AS finding_precision,
 {d6("avg((label = predicted_attack)::INT)")} AS classifier_accuracy,
 {d6(f"count(*) FILTER (WHERE label <> 'normal' AND behaviour >= {BEHAVIOUR}) / greatest(count(*) FILTER (WHERE label <> 'normal'), 1)")} AS behavioral_attack_recall FROM p GROUP BY 1"""))
def cold_start(spark, d):
    return rounded(E.cold_start_metrics(with_history(spark, d), alerted(), flagged()))


@query("e08_baseline_usage", over_t(f", {O.baseline_cte()} SELECT baseline_kind, count(*) AS n FROM base WHERE subject_history_count < 12 GROUP BY 1"))
def usage(spark, d):
    return E.baseline_usage(profiles.choose_baseline(profiles.positions(events(spark, d))))


@query("e10_behavioural_layer", over_scored(f"SELECT label, count(*) AS n, {d6(f'avg((behaviour >= {BEHAVIOUR})::INT)')} AS flagged_share FROM scored GROUP BY 1"))
def layer(spark, d):
    return rounded(E.behavioural_layer(scored(spark, d), flagged()))


@query("e11_e12_e13_population_rates", over_scored(f""", e AS (SELECT entity_id, max((risk_score >= {ALERT})::INT) AS f FROM scored WHERE label <> 'normal' GROUP BY 1)
 SELECT {d6(f"coalesce(avg((risk_score >= {ALERT})::INT) FILTER (WHERE scenario_id LIKE 'insider_drift-%'), 0)")} AS insider_drift_false_positive_rate,
 {d6(f"coalesce(avg((behaviour >= {BEHAVIOUR})::INT) FILTER (WHERE scenario_id LIKE 'insider_drift-%'), 0)")} AS behavioral_insider_drift_false_positive_rate,
 {d6("avg((label <> 'normal')::INT)")} AS attack_prevalence, {d6(f'avg((risk_score >= {ALERT})::INT)')} AS alert_rate, {d6(f'avg((risk_score >= {ALERT})::INT) * 10000')} AS alerts_per_10000,
 count(*) AS sample_count, {d6('(SELECT sum(f) / greatest(count(*), 1) FROM e)')} AS attacked_entity_recall FROM scored"""))
def rates(spark, d):
    return rounded(E.population_rates(scored(spark, d), alerted(), flagged()))


# ---- corpus --------------------------------------------------------------------------------------------------

@query("e15_split_assignment", over_t(""", e AS (SELECT entity_id, row_number() OVER (ORDER BY md5(entity_id), entity_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT entity_id FROM t))
 SELECT entity_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM e"""))
def splits(spark, d):
    return corpus.assign_splits(events(spark, d))


@query("e16_split_integrity", over_t(""", s AS (SELECT split, min(us) AS a, max(us) AS b, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS p FROM t GROUP BY 1),
 l AS (SELECT count(*) FILTER (WHERE a <= prev) AS late FROM (SELECT a, lag(b) OVER (ORDER BY p) AS prev FROM s)),
 h AS (SELECT count(*) AS shared FROM (SELECT entity_id FROM t GROUP BY 1 HAVING count(DISTINCT split) > 1))
 SELECT shared AS shared_entities, late AS overlapping_splits, CAST(0 AS BIGINT) AS repeated_event_ids, (SELECT count(*) FROM t WHERE eid % 10 = 0) AS held_back_overlap,
  shared = 0 AS entity_disjoint, late = 0 AS strictly_chronological, true AS unique_event_ids FROM l, h"""))
def integrity(spark, d):
    rows = events(spark, d)
    return corpus.split_integrity(rows, held_back=rows.where("eid % 10 = 0"))


@query("e17_manifest", over_t("""SELECT split, count(*) AS events, count(*) FILTER (WHERE label <> 'normal') AS attacks, CAST(printf('%.4f', count(*) FILTER (WHERE label <> 'normal') / count(*)) AS DOUBLE) AS attack_event_rate,
 count(DISTINCT session_id) FILTER (WHERE label = 'normal') AS normal_sessions, count(DISTINCT scenario_id) FILTER (WHERE label <> 'normal') AS attack_scenarios,
 CAST(printf('%.4f', count(DISTINCT scenario_id) FILTER (WHERE label <> 'normal') / greatest(count(DISTINCT session_id) FILTER (WHERE label = 'normal'), 1)) AS DOUBLE) AS attack_scenario_rate,
 count(DISTINCT entity_id) AS entities FROM t GROUP BY 1"""))
def manifest(spark, d):
    return corpus.manifest(events(spark, d))


@query("e17_label_histogram", over_t("SELECT split, label, count(*) AS n FROM t GROUP BY 1, 2"))
def histogram(spark, d):
    return corpus.label_histogram(events(spark, d)).select("split", F.explode("labels").alias("label", "n"))


@query("e18_latency_summary", over_t(f"""SELECT {d6('quantile_cont(CAST(bytes_uploaded AS DOUBLE), 0.5)')} AS p50, {d6('quantile_cont(CAST(bytes_uploaded AS DOUBLE), 0.95)')} AS p95, {d6('quantile_cont(CAST(bytes_uploaded AS DOUBLE), 0.99)')} AS p99,
 {d6('avg(CAST(bytes_uploaded AS DOUBLE))')} AS mean, {d6('min(CAST(bytes_uploaded AS DOUBLE))')} AS minimum, {d6('max(CAST(bytes_uploaded AS DOUBLE))')} AS maximum FROM t"""))
def latency(spark, d):
    return rounded(E.latency_summary(events(spark, d), "bytes_uploaded"))


@query("e19_ordering_violations", over_t(""", a AS (SELECT entity_id, us, us + CASE WHEN eid % 211 = 0 THEN 3600000000000 ELSE 0 END AS seq FROM t),
 m AS (SELECT entity_id, seq, max(seq) OVER (PARTITION BY entity_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM a)
 SELECT count(DISTINCT entity_id) AS violating_entities FROM m WHERE hi > seq"""))
def ordering(spark, d):
    rows = events(spark, d).withColumn("seq", F.expr("us + CASE WHEN eid % 211 = 0 THEN 3600000000000L ELSE 0L END"))
    return E.ordering_violations(rows, "entity_id", "us", "seq", width=86_400_000_000)


@query("e19_status_counts", over_t("SELECT access_outcome AS status, count(*) AS n FROM t GROUP BY 1"))
def statuses(spark, d):
    return events(spark, d).groupBy(F.col("access_outcome").alias("status")).agg(F.count("*").alias("n"))

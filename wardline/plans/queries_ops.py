"""Incidents, triage, daily behaviour and concept drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import scalar as S
from wardline.operators import daily, drift, evaluate as E, incidents as I, profiles
from wardline.plans import oracle as O
from wardline.plans.registry import ALERT, SEVERITY_SQL, d6, events, over_scored, over_t, query, r6, rounded, scored
from wardline.session import cut_lineage

# ---- incidents ---------------------------------------------------------------------------------------

RISK2 = "CAST(printf('%.2f', risk_score) AS DOUBLE)"
INCIDENT_SQL = f"""a AS (SELECT *, {RISK2} AS risk2, CAST(floor(us / 900000000.0) AS BIGINT) AS bucket, {SEVERITY_SQL} AS severity FROM scored),
al AS (SELECT *, row_number() OVER (PARTITION BY entity_id, predicted_attack, bucket ORDER BY risk2 DESC, us, event_id) AS rn,
  count(*) OVER k AS event_count, max(us) OVER k AS last_us, min(us) OVER k AS created_us FROM a WHERE risk2 >= {ALERT} WINDOW k AS (PARTITION BY entity_id, predicted_attack, bucket)),
incidents AS MATERIALIZED (SELECT concat(entity_id, ':', predicted_attack, ':', bucket) AS incident_key, * FROM al WHERE rn = 1),
feedback AS (SELECT incident_key, CASE substr(md5(incident_key), 1, 1) WHEN '0' THEN 'investigating' WHEN '1' THEN 'investigating' WHEN '2' THEN 'confirmed_threat' WHEN '3' THEN 'confirmed_threat'
  WHEN '4' THEN 'false_positive' WHEN '5' THEN 'false_positive' ELSE 'closed' END AS status, last_us + 60000000 AS created_us, 2 AS feedback_id FROM incidents WHERE substr(md5(incident_key), 1, 1) IN ('0','1','2','3','4','5','6')
  UNION ALL SELECT incident_key, 'investigating', last_us + 30000000, 1 FROM incidents WHERE substr(md5(incident_key), 1, 1) IN ('2','3','4')),
alerts AS MATERIALIZED (SELECT i.*, coalesce(f.status, 'open') AS status, coalesce(f.updated_us, i.last_us) AS updated_us, coalesce(f.fp, false) AS was_trusted, coalesce(f.n, 0) AS feedback_count FROM incidents i LEFT JOIN
 (SELECT incident_key, max_by(status, created_us) AS status, max(created_us) AS updated_us, bool_or(status = 'false_positive') AS fp, count(*) AS n FROM feedback GROUP BY 1) f USING (incident_key))"""


def over_alerts(sql: str) -> str:
    return over_scored(f", {INCIDENT_SQL} {sql}")


def incidents(spark, d):
    return I.correlate(I.alerting(scored(spark, d), ALERT))


def feedback_rows(found):
    mark = F.substring(F.md5(F.col("incident_key").cast("binary")), 1, 1)
    final = (F.when(mark.isin("0", "1"), "investigating").when(mark.isin("2", "3"), "confirmed_threat")
             .when(mark.isin("4", "5"), "false_positive").otherwise("closed"))
    entries = F.filter(F.array(
        F.when(mark.isin("0", "1", "2", "3", "4", "5", "6"), F.struct(final.alias("status"), (F.col("last_us") + 60_000_000).alias("created_us"), F.lit(2).alias("feedback_id"))),
        F.when(mark.isin("2", "3", "4"), F.struct(F.lit("investigating").alias("status"), (F.col("last_us") + 30_000_000).alias("created_us"), F.lit(1).alias("feedback_id")))),
        lambda x: x.isNotNull())
    return found.select("incident_key", F.explode(entries).alias("e")).select("incident_key", "e.*")


def alerts(spark, d):
    found = incidents(spark, d)
    return I.current_status(found, feedback_rows(found))


@query("i01_alert_filter", over_scored(f"SELECT event_id, {RISK2} AS risk_score FROM scored WHERE {RISK2} >= {ALERT}"))
def alert_filter(spark, d):
    return I.alerting(scored(spark, d), ALERT).select("event_id", S.python_round("risk_score", 2).alias("risk_score"))


@query("i02_incidents", over_alerts("SELECT incident_key, entity_id, predicted_attack, bucket, event_count, risk2 AS risk_score, event_id, us, last_us FROM incidents"))
def incident_rows(spark, d):
    return incidents(spark, d).select("incident_key", "entity_id", "predicted_attack", "bucket", "event_count", "risk_score", "event_id", "us", "last_us")


@query("i02_wide_incidents", over_scored(f""", a AS (SELECT *, {RISK2} AS risk2, CAST(floor(us / 86400000000.0) AS BIGINT) AS bucket FROM scored WHERE {RISK2} >= 40)
 SELECT entity_id, bucket, count(*) AS event_count, max(risk2) AS risk_score, min_by(event_id, struct_pack(a := -risk2, b := us)) AS event_id FROM a GROUP BY 1, 2"""))
def wide_incidents(spark, d):
    rows = I.alerting(scored(spark, d), 40.0)
    # A day is 96 quarter hours: correlating on a coarser clock exercises incidents of several events.
    coarse = rows.withColumns({"at": F.col("us"), "predicted_attack": F.lit("any")})
    best = F.min(F.struct((-S.python_round("risk_score", 2)).alias("minus_risk"), "us", "event_id"))
    return coarse.groupBy("entity_id", S.floor_div("us", S.DAY).alias("bucket")).agg(F.count("*").alias("event_count"), best.alias("b")).select(
        "entity_id", "bucket", "event_count", (-F.col("b.minus_risk")).alias("risk_score"), F.col("b.event_id").alias("event_id"))


QUEUE = ("incident_key", "entity_id", "predicted_attack", "severity", "status", "risk_score", "event_count")


@query("i04_alert_queue", over_alerts("SELECT incident_key, entity_id, predicted_attack, severity, status, risk2 AS risk_score, event_count FROM alerts WHERE severity = 'critical' AND status = 'open' ORDER BY risk2 DESC, incident_key LIMIT 100"))
def queue(spark, d):
    return I.alert_queue(alerts(spark, d), severity="critical", status="open").select(*QUEUE)


@query("i05_alert_timelines", over_alerts("""SELECT i.incident_key, i.entity_id, r.event_id AS timeline_event_id, r.us AS timeline_us, r.rn AS recency FROM incidents i JOIN
 (SELECT entity_id, event_id, us, row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, event_id DESC) AS rn FROM t) r ON i.entity_id = r.entity_id WHERE r.rn <= 20"""))
def timelines(spark, d):
    return I.alert_timelines(incidents(spark, d), events(spark, d)).withColumn("recency", F.col("recency").cast("long"))


@query("i06_dispositions", over_alerts("SELECT incident_key, status, updated_us, was_trusted AS trusted, feedback_count FROM alerts"))
def dispositions(spark, d):
    return alerts(spark, d).select("incident_key", "status", "updated_us", "trusted", "feedback_count")


@query("i07_entities", over_t("SELECT entity_id, min(us) AS first_seen, max(us) AS last_seen, max_by(entity_type, us) AS entity_type, max_by(user_role, us) AS user_role, max_by(department, us) AS department FROM t GROUP BY 1"))
def entities(spark, d):
    return I.entity_dimension(events(spark, d))


@query("i08_devices", over_t("SELECT device_id, max(us) AS last_seen, max_by(device_fingerprint, us) AS device_fingerprint, count(*) FILTER (WHERE trusted) AS trusted_event_count, min_by(entity_id, us) AS first_owner FROM t GROUP BY 1"))
def devices(spark, d):
    return I.device_dimension(events(spark, d))


def predictions(spark, d):
    return scored(spark, d).where("eid % 10 <> 3").select("event_id", r6("risk_score").alias("risk_score"), "predicted_attack",
                                                          S.display_class("predicted_attack", "classifier_confidence").alias("display_attack"))


@query("i09_event_feed", over_scored(f""", n AS (SELECT * FROM scored WHERE event_type = 'login' ORDER BY us DESC LIMIT 100)
 SELECT event_id, us, entity_id, CASE WHEN eid % 10 <> 3 THEN {d6('risk_score')} END AS risk_score, CASE WHEN eid % 10 <> 3 THEN predicted_attack END AS predicted_attack FROM n"""))
def feed(spark, d):
    rows = events(spark, d).select("event_id", "us", "entity_id", "event_type")
    return I.event_feed(rows, predictions(spark, d), event_type="login").select("event_id", "us", "entity_id", "risk_score", "predicted_attack")


@query("i10_latest_event", over_t("SELECT event_id, us FROM t ORDER BY us DESC LIMIT 1"))
def latest(spark, d):
    return I.top(events(spark, d).select("event_id", "us"), 1, F.desc("us"))


@query("i11_identity_search", over_t("""SELECT entity_id, max(us) AS last_seen, max_by(user_role, us) AS user_role FROM t GROUP BY 1
 HAVING entity_id ILIKE '%ENG%' OR max_by(user_role, us) ILIKE '%ENG%' OR max_by(department, us) ILIKE '%ENG%' ORDER BY last_seen DESC LIMIT 20"""))
def search(spark, d):
    return I.search_identities(I.entity_dimension(events(spark, d)), "ENG").select("entity_id", "last_seen", "user_role")


@query("i12_entity_timeline", over_scored(f"SELECT event_id, us, CASE WHEN eid % 10 <> 3 THEN {d6('risk_score')} END AS risk_score FROM scored WHERE entity_id = 'usr-7' ORDER BY us DESC LIMIT 100"))
def timeline(spark, d):
    return I.entity_timeline(events(spark, d).select("event_id", "us", "entity_id"), predictions(spark, d), "usr-7").select("event_id", "us", "risk_score")


@query("i13_profile_cards", f"""WITH {O.T}, {O.KEYED_CTE}, c AS (SELECT key, count(*) AS n FROM (SELECT unnest([ek, dk, pk, gk]) AS key FROM keyed WHERE trusted) GROUP BY 1),
 last AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC) = 1),
 j AS (SELECT l.entity_id, l.user_role, coalesce(e.n, 0) AS ne, coalesce(dv.n, 0) AS nd, coalesce(p.n, 0) AS np, coalesce(g.n, 0) AS ng FROM last l LEFT JOIN c e ON e.key = l.ek LEFT JOIN c dv ON dv.key = l.dk
   LEFT JOIN c p ON p.key = l.pk LEFT JOIN c g ON g.key = l.gk)
 SELECT entity_id, user_role, CASE WHEN ne >= 40 THEN 'entity' WHEN nd >= 40 THEN 'device' WHEN np >= 25 THEN 'peer' WHEN ng >= 25 THEN 'global' ELSE 'global_default' END AS baseline_kind,
  CASE WHEN ne >= 40 THEN ne WHEN nd >= 40 THEN nd WHEN np >= 25 THEN np WHEN ng >= 25 THEN ng ELSE 0 END AS event_count FROM j""")
def cards(spark, d):
    rows = events(spark, d)
    return profiles.profile_cards(rows, profiles.ProfilePolicy(entity_minimum=40)).select("entity_id", "user_role", "baseline_kind", "event_count")


AS_OF = "(SELECT max(us) FROM t)"


@query("i14_i15_overview", over_alerts(f"""SELECT count(*) AS total_alerts, count(*) FILTER (WHERE status = 'open') AS open_alerts, count(*) FILTER (WHERE status = 'investigating') AS investigating_alerts,
 count(*) FILTER (WHERE status IN ('open', 'investigating', 'confirmed_threat')) AS unresolved_alerts, count(*) FILTER (WHERE status IN ('confirmed_threat', 'false_positive', 'closed')) AS reviewed_alerts,
 count(*) FILTER (WHERE severity = 'critical') AS critical_alerts,
 {d6("count(*) FILTER (WHERE updated_us >= 1704499200000000 - 86400000000 AND status = 'false_positive') / greatest(count(*) FILTER (WHERE updated_us >= 1704499200000000 - 86400000000 AND status IN ('confirmed_threat', 'false_positive', 'closed')), 1)")} AS analyst_false_positive_rate_24h,
 (SELECT count(*) FROM t) AS events_analyzed FROM alerts"""))
def overview(spark, d):
    return rounded(I.overview(alerts(spark, d), events(spark, d), 1_704_499_200_000_000))


@query("i16_average_latency", over_t(f"SELECT {d6('avg(session_duration_seconds)')} AS average_ms FROM t"))
def average(spark, d):
    return rounded(I.average_latency(events(spark, d).withColumnRenamed("session_duration_seconds", "latency_ms")))


@query("i17_detections_by_class", over_alerts("""SELECT c AS predicted_attack, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS detections FROM
 (SELECT unnest(['brute_force','credential_stuffing','lateral_movement','impossible_travel','device_spoofing','low_slow_exfiltration']) AS c) LEFT JOIN incidents ON c = predicted_attack GROUP BY 1"""))
def detections(spark, d):
    return I.detections_by_class(incidents(spark, d))


@query("i18_risk_trend", over_scored(f"SELECT event_id, us, {d6('risk_score')} AS risk_score FROM scored ORDER BY us DESC LIMIT 50"))
def trend(spark, d):
    return rounded(I.risk_trend(scored(spark, d)))


@query("i19_notifications", over_alerts("""SELECT 'critical_alert' AS type, concat(replace(predicted_attack, '_', ' '), ' · ', entity_id) AS message, created_us FROM
 (SELECT * FROM incidents WHERE severity = 'critical' ORDER BY created_us DESC, incident_key LIMIT 5) UNION ALL
 SELECT 'drift_warning', concat(entity_id, ' · ', 'access hour'), us FROM (SELECT * FROM (SELECT * FROM t WHERE eid % 29 = 0 ORDER BY us DESC LIMIT 20) WHERE eid % 3 <> 0 ORDER BY us DESC LIMIT 3)"""))
def notices(spark, d):
    found = events(spark, d).where("eid % 29 = 0").select(F.col("entity_id").alias("subject"), F.lit("access_hour").alias("feature"), F.col("us").alias("detected_us"),
                                                          F.expr("CASE WHEN eid % 3 = 0 THEN 'dismissed' ELSE 'pending' END").alias("review_status"))
    return I.notifications(incidents(spark, d), found)


@query("i20_triage_views", over_alerts("""SELECT 'unresolved' AS view, incident_key FROM alerts WHERE severity = 'critical' AND status IN ('open', 'investigating', 'confirmed_threat')
 UNION ALL SELECT 'false_positive', incident_key FROM alerts WHERE status = 'false_positive' UNION ALL SELECT 'low_confidence', incident_key FROM alerts WHERE classifier_confidence < 0.6
 UNION ALL SELECT 'impossible_travel', incident_key FROM alerts WHERE predicted_attack = 'impossible_travel' UNION ALL SELECT 'investigating', incident_key FROM alerts WHERE status = 'investigating'"""))
def views(spark, d):
    rows = alerts(spark, d)
    tagged = F.filter(F.array(*[F.when(I.view_predicate(v) & ((F.col("severity") == "critical") if v == "unresolved" else F.lit(True)), F.lit(v)) for v in I.VIEWS]), lambda v: v.isNotNull())
    return rows.select(F.explode(tagged).alias("view"), "incident_key")


@query("i20_i21_text_search", over_alerts("SELECT incident_key, risk2 AS risk_score, event_count FROM alerts WHERE contains(lower(replace(concat_ws(' ', predicted_attack, entity_id, status), '_', ' ')), 'impossible travel') ORDER BY risk2 DESC, event_count DESC"))
def text_search(spark, d):
    rows = alerts(spark, d).select("incident_key", "predicted_attack", "entity_id", "status", "severity", "risk_score", "event_count", "us")
    return I.triage(rows, text="impossible travel").select("incident_key", "risk_score", "event_count")


@query("i22_severity_facets", over_alerts("SELECT severity, count(*) AS n FROM incidents GROUP BY 1"))
def facets(spark, d):
    return I.severity_facets(incidents(spark, d))


@query("i23_risk_load", over_scored("SELECT CAST(floor(avg(risk_score) + 0.5) AS BIGINT) AS risk_load FROM (SELECT risk_score FROM scored ORDER BY us DESC LIMIT 20)"))
def load(spark, d):
    return I.risk_load(scored(spark, d))


@query("i24_live_rate", over_t(f"SELECT {d6('count(*) / 7200.0')} AS events_per_second FROM t WHERE us >= 1704499200000000 - 7200000000 AND us <= 1704499200000000"))
def rate(spark, d):
    return rounded(I.live_rate(events(spark, d), 1_704_499_200_000_000, 7200))


@query("i25_outcomes", over_scored(f""", a AS (SELECT *, risk_score >= {ALERT} AS al FROM scored) SELECT count(*) AS processed_events, count(*) FILTER (WHERE label <> 'normal' AND al) AS detected_attack_events,
 count(*) FILTER (WHERE label <> 'normal' AND NOT al) AS missed_attack_events, count(*) FILTER (WHERE label <> 'normal' AND predicted_attack = label) AS correct_attack_classifications,
 count(*) FILTER (WHERE label <> 'normal' AND predicted_attack <> label) AS misclassified_attack_events, count(*) FILTER (WHERE label = 'normal' AND al) AS false_positive_events,
 count(*) FILTER (WHERE al AND eid % 4 = 0) AS new_incident_count FROM a"""))
def outcomes(spark, d):
    al = F.col("risk_score") >= ALERT
    return E.outcome_counters(scored(spark, d), al, al & F.expr("eid % 4 = 0"))


# ---- daily -----------------------------------------------------------------------------------------------

DAILY_SQL = """days AS MATERIALIZED (SELECT entity_id, CAST(make_timestamp(us) AS DATE) AS day, count(*) AS event_count, quantile_cont(CAST(anomaly_score AS DOUBLE), 0.95) AS score, quantile_cont(CAST(deviation AS DOUBLE), 0.95) AS second,
  coalesce(min_by(label, us) FILTER (WHERE label <> 'normal'), 'normal') AS label FROM scored GROUP BY 1, 2)"""


def daily_rows(spark, d, crowded=daily.CROWDED_DAY):
    rolled = cut_lineage(daily.daily_rollup(scored(spark, d), ["anomaly_score", "deviation"], crowded))  # read several times
    return rolled.select("entity_id", "day", "event_count", F.col("anomaly_score").alias("score"), F.col("deviation").alias("second"), "label")


@query("b01_daily_rollup", over_scored(f", {DAILY_SQL} SELECT entity_id, CAST(day AS VARCHAR) AS day, event_count, {d6('score')} AS score, {d6('second')} AS second, label FROM days"))
def rollup(spark, d):
    # Days of four events or more take the distributed quantile, the others the in-task one.
    return rounded(daily_rows(spark, d, crowded=3).withColumn("day", F.col("day").cast("string")))


@query("b02_daily_scaler", over_scored(f""", {DAILY_SQL}, q AS (SELECT quantile_cont(score, 0.1) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.9) AS c FROM days WHERE label = 'normal')
 SELECT 'score' AS name, {d6('b')} AS center, {d6('(c - a) / 2.5631031310892007')} AS scale FROM q"""))
def daily_scaler(spark, d):
    from wardline.operators.scaling import fit_scaler
    return rounded(fit_scaler(daily_rows(spark, d).where("label = 'normal'"), ["score"]))


DAILY_CURVE = f"""g AS (SELECT score AS s, count(*) FILTER (WHERE label <> 'normal') AS pos, count(*) FILTER (WHERE label = 'normal') AS neg FROM days GROUP BY 1),
cu AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


def daily_tuned_sql(limit):
    return f"""{DAILY_CURVE}, r AS (SELECT s AS threshold, tp / greatest(p, 1) AS recall, tp / greatest(tp + fp, 1) AS prec, fp / greatest(n, 1) AS fpr, 0 AS spare FROM cu WHERE fp / greatest(n, 1) <= {limit}
  UNION ALL SELECT 1.0, (SELECT count(*) FROM days WHERE label <> 'normal' AND score >= 1) / greatest((SELECT count(*) FROM days WHERE label <> 'normal'), 1),
   (SELECT count(*) FROM days WHERE label <> 'normal' AND score >= 1) / greatest((SELECT count(*) FROM days WHERE score >= 1), 1),
   (SELECT count(*) FROM days WHERE label = 'normal' AND score >= 1) / greatest((SELECT count(*) FROM days WHERE label = 'normal'), 1), 1)
 SELECT {d6('threshold')} AS threshold, {d6('recall')} AS recall, {d6('prec')} AS "precision", {d6('fpr')} AS false_positive_rate FROM r ORDER BY spare, recall DESC, prec DESC, fpr, threshold DESC LIMIT 1"""


@query("b04_daily_threshold", over_scored(f", {DAILY_SQL}, {daily_tuned_sql(0.9)}"))
def daily_threshold(spark, d):
    return rounded(daily.daily_threshold(daily_rows(spark, d), .9).drop("alerts"))


@query("b04_daily_threshold_fallback", over_scored(f", {DAILY_SQL}, {daily_tuned_sql(0.0)}"))
def daily_fallback(spark, d):
    return rounded(daily.daily_threshold(daily_rows(spark, d), .0).drop("alerts"))


RANK_SQL = f"""{DAILY_SQL}, l AS (SELECT max(day) AS latest FROM days), rec AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) AS back FROM days QUALIFY back <= 10),
e AS (SELECT entity_id, max(score) AS mx, count(*) FILTER (WHERE score >= 0.9) AS dd, coalesce(min(back) FILTER (WHERE score < 0.9), count(*) + 1) - 1 AS run, max(day) FILTER (WHERE score >= 0.9) AS last_day,
  list_sum(list_sort(list(score), 'DESC')[1:3]) / least(count(*), 3) AS top3, arg_max(score, day) AS latest_score, bool_or(label <> 'normal') AS hit FROM rec GROUP BY 1),
rk AS (SELECT *, 100 * (0.60 * mx + 0.25 * least(dd / 7.0, 1.0) + 0.10 * top3 + 0.05 * CASE WHEN last_day IS NULL THEN 0 ELSE exp(-(latest - last_day) / 7.0) END) AS rank_score FROM e, l),
ranked AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, mx DESC, dd DESC, entity_id) AS rank FROM rk)"""


@query("b05_identity_ranking", over_scored(f""", {RANK_SQL} SELECT entity_id, rank, {d6('rank_score')} AS rank_score, {d6('mx')} AS maximum_drift_30d, dd AS drift_days_30d, run AS consecutive_drift_days, {d6('top3')} AS mean_top_3_drift,
 CAST(last_day AS VARCHAR) AS last_drift_date, {d6('latest_score')} AS latest_score, hit AS has_attack FROM ranked"""))
def ranking(spark, d):
    ranked = daily.identity_ranking(daily_rows(spark, d), .9, horizon=10)
    return rounded(ranked.withColumn("last_drift_date", F.col("last_drift_date").cast("string")))


EVAL_RANK = RANK_SQL.replace("back <= 10", "back <= 30")


@query("b06_daily_evaluation", over_scored(f""", {EVAL_RANK}, {DAILY_CURVE}, au AS (SELECT sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)) AS roc, sum(pos * tp / (tp + fp)) / max(p) AS pr FROM cu),
 c AS (SELECT count(*) AS ne, count(*) FILTER (WHERE hit) AS attacked FROM ranked)
 SELECT (SELECT count(*) FROM days) AS daily_count, {d6("(SELECT avg((label <> 'normal')::INT) FROM days)")} AS attack_day_prevalence,
 {d6("(SELECT count(*) FILTER (WHERE label <> 'normal' AND score >= 0.9) / greatest(count(*) FILTER (WHERE score >= 0.9), 1) FROM days)")} AS "precision",
 {d6("(SELECT count(*) FILTER (WHERE label <> 'normal' AND score >= 0.9) / greatest(count(*) FILTER (WHERE label <> 'normal'), 1) FROM days)")} AS recall,
 {d6("(SELECT count(*) FILTER (WHERE label = 'normal' AND score >= 0.9) / greatest(count(*) FILTER (WHERE label = 'normal'), 1) FROM days)")} AS false_positive_rate,
 {d6('roc')} AS roc_auc, {d6('pr')} AS pr_auc, ne AS ranked_entity_count, attacked AS attacked_entity_count,
 {d6("(SELECT count(*) FILTER (WHERE hit) / count(*) FROM ranked WHERE rank <= greatest(1, ceil(ne * 0.01)))")} AS top_1_percent_precision,
 {d6("(SELECT count(*) FILTER (WHERE hit) / count(*) FROM ranked WHERE rank <= 10)")} AS top_10_precision, {d6("(SELECT count(*) FILTER (WHERE hit) FROM ranked WHERE rank <= 10) / greatest(attacked, 1)")} AS top_10_recall FROM au, c"""))
def evaluation(spark, d):
    return rounded(daily.daily_evaluation(daily_rows(spark, d), .9))


@query("b07_entity_history", over_scored(f""", {RANK_SQL} SELECT d.entity_id, CAST(d.day AS VARCHAR) AS day, {d6('d.score')} AS score, d.score >= 0.9 AS is_drift_day, d.event_count, r.rank, {d6('r.rank_score')} AS rank_score
 FROM days d JOIN ranked r USING (entity_id) WHERE d.entity_id = 'usr-7'"""))
def history(spark, d):
    rows = daily_rows(spark, d)
    ranked = daily.identity_ranking(rows, .9, horizon=10)
    return rounded(daily.entity_history(rows, ranked, "usr-7", .9).withColumn("day", F.col("day").cast("string")))


# ---- drift -------------------------------------------------------------------------------------------------

SIGNAL_LIST = ("access_hour", "location_novelty_score", "new_device_score", "download_volume_zscore", "resource_novelty_score", "privilege_expansion_score", "sequence_anomaly_score", "anomaly_score")
DRIFT_BASE = f"""sig AS (SELECT user_role AS subject, us, event_id, row_number() OVER (PARTITION BY user_role, entity_type ORDER BY us) AS x, {O.hour('us')} AS access_hour,
  CASE WHEN us >= 1705276800000000 AND entity_type = 'user' THEN 1.0 ELSE 0.0 END AS download_volume_zscore, sequence_anomaly_score, anomaly_score FROM t WHERE trusted),
num AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY us, event_id) AS seq FROM sig),
vals AS MATERIALIZED (SELECT subject, us, event_id, seq, unnest(['access_hour', 'location_novelty_score', 'new_device_score', 'download_volume_zscore', 'resource_novelty_score', 'privilege_expansion_score', 'sequence_anomaly_score', 'anomaly_score']) AS feature,
  unnest([access_hour, 0.0, 0.0, download_volume_zscore, 0.0, 0.0, sequence_anomaly_score, CAST(anomaly_score AS DOUBLE)]) AS value FROM num)"""
POLICY = drift.DriftPolicy(effect=.8, ks=.3)
BLOCK_SQL = """bl AS (SELECT subject, feature, CAST(floor((seq - 1) / 20.0) AS BIGINT) AS block, list_sort(list(CAST(value AS DOUBLE))) AS vs, count(*) AS n, max(us) AS last_us, max(seq) AS last_seq,
  avg(sin(value / 24 * 2 * pi())) AS sn, avg(cos(value / 24 * 2 * pi())) AS cs, avg(value) AS m, stddev_pop(value) AS sd FROM vals GROUP BY 1, 2, 3),
ctr AS (SELECT *, CASE WHEN feature = 'access_hour' THEN CASE WHEN atan2(sn, cs) < 0 THEN atan2(sn, cs) + 2 * pi() ELSE atan2(sn, cs) END / (2 * pi()) * 24 ELSE m END AS mean FROM bl),
blocks AS MATERIALIZED (SELECT *, CASE WHEN feature = 'access_hour' THEN sqrt(list_sum(list_transform(vs, lambda v: pow(least(abs(v - mean) % 24, 24 - abs(v - mean) % 24), 2))) / n) ELSE sd END AS std FROM ctr)"""
COMPARE_SQL = """cmp AS (SELECT b.*, a.vs AS old_vs, a.mean AS old_mean, a.std AS old_std, CASE b.feature WHEN 'access_hour' THEN 1.5 WHEN 'download_volume_zscore' THEN 0.75 WHEN 'sequence_anomaly_score' THEN 0.12 WHEN 'anomaly_score' THEN 0.12 ELSE 0.15 END AS flr,
  CASE WHEN b.feature = 'access_hour' THEN least(abs(b.mean - a.mean) % 24, 24 - abs(b.mean - a.mean) % 24) ELSE abs(b.mean - a.mean) END AS shift
  FROM blocks b JOIN blocks a ON a.subject = b.subject AND a.feature = b.feature AND a.block = b.block - 1 WHERE b.n = 20 AND a.n = 20),
rate AS (SELECT *, shift / greatest((std + old_std) / 2, flr / 0.8) AS effect,
  list_max(list_transform(list_concat(vs, old_vs), lambda x: abs(len(list_filter(vs, lambda v: v <= x)) / 20.0 - len(list_filter(old_vs, lambda v: v <= x)) / 20.0))) AS ks FROM cmp),
sigf AS MATERIALIZED (SELECT *, shift >= flr AND effect >= 0.8 AND ks >= 0.3 AS significant FROM rate),
found AS MATERIALIZED (SELECT * FROM sigf s WHERE significant AND block = (SELECT min(block) FROM sigf x WHERE x.significant AND x.subject = s.subject AND x.feature = s.feature))"""


def drift_values(spark, d):
    rows = events(spark, d).where("trusted").withColumns({
        "access_hour": S.hour_of_day("us"),
        "download_volume_zscore": F.expr("CASE WHEN us >= 1705276800000000 AND entity_type = 'user' THEN 1.0D ELSE 0.0D END")})
    return drift.monitored_values(rows.select("user_role", "us", "event_id", "access_hour", "download_volume_zscore", "sequence_anomaly_score", "anomaly_score"), "user_role")


def compared(spark, d):
    return drift.compare_blocks(drift.block_summaries(drift_values(spark, d)), POLICY)


def found(spark, d):
    return drift.findings(compared(spark, d))


@query("d01_monitored_values", over_t(f", {DRIFT_BASE} SELECT subject, feature, seq, {d6('value')} AS value FROM vals"))
def monitored(spark, d):
    return rounded(drift_values(spark, d).select("subject", "feature", "seq", "value"))


@query("d02_d03_d08_blocks", over_t(f", {DRIFT_BASE}, {BLOCK_SQL} SELECT subject, feature, block, n, {d6('mean')} AS mean, {d6('std')} AS std, {d6('vs[1]')} AS minimum, {d6('vs[n]')} AS maximum, {d6('vs[n // 2 + 1]')} AS p50, {d6('vs[least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) + 1]')} AS p90 FROM blocks"))
def blocks(spark, d):
    rows = drift.block_summaries(drift_values(spark, d)).withColumn("dist", drift.distribution())
    return rounded(rows.select("subject", "feature", "block", "n", *[F.col("dist." + c).alias(c) for c in ("mean", "std", "minimum", "maximum", "p50", "p90")]))


@query("d04_d05_d06_comparison", over_t(f", {DRIFT_BASE}, {BLOCK_SQL}, {COMPARE_SQL} SELECT subject, feature, block, {d6('shift')} AS absolute_shift, {d6('effect')} AS effect_size, {d6('ks')} AS ks_distance FROM sigf"))
def comparison(spark, d):
    return rounded(compared(spark, d).select("subject", "feature", "block", "absolute_shift", "effect_size", "ks_distance"))


CONF = "least(0.999, 0.5 + 0.28 * (1 - exp(-effect / 3)) + 0.2 * ks)"


@query("d06_d07_d14_findings", over_t(f""", {DRIFT_BASE}, {BLOCK_SQL}, {COMPARE_SQL} SELECT subject, feature, block, {d6('effect')} AS magnitude, {d6(CONF)} AS drift_confidence,
 CASE WHEN effect >= 6 THEN 'critical' WHEN effect >= 4 THEN 'high' ELSE 'medium' END AS severity, last_seq AS detected_seq, last_us AS detected_us,
 CASE feature WHEN 'access_hour' THEN 'Validate the entity''s new shift or working-hours assignment' WHEN 'download_volume_zscore' THEN 'Review data-transfer purpose and expected workload change'
  WHEN 'sequence_anomaly_score' THEN 'Review the changed action sequence before adapting the sequence baseline' ELSE 'Inspect the combined behavioral change before adapting the point baseline' END AS recommendation FROM found"""))
def drift_findings(spark, d):
    return rounded(found(spark, d).select("subject", "feature", "block", "magnitude", "drift_confidence", "severity", "detected_seq", "detected_us", "recommendation"))


STATE_SQL = """st AS (SELECT v.subject, v.feature, max(v.seq) AS seen, max(f.last_seq) AS det, max(f.block) AS fb, max(v.us) AS last_us FROM vals v LEFT JOIN found f ON f.subject = v.subject AND f.feature = v.feature GROUP BY 1, 2),
state AS (SELECT *, coalesce(det, seen) AS used, CASE WHEN det IS NOT NULL THEN 20 WHEN seen >= 20 THEN seen % 20 ELSE 0 END AS cur, least(coalesce(det, seen), 20) AS ref,
  CASE WHEN det IS NOT NULL THEN fb ELSE greatest(CAST(floor(seen / 20.0) AS BIGINT), 1) END AS ver FROM st),
ws AS (SELECT subject, min(ref) AS reference_count, min(cur) AS current_count, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE det IS NOT NULL), '') AS flagged, max(ver) AS baseline_version, max(used) AS trusted_events FROM state GROUP BY 1),
status AS (SELECT *, CASE WHEN flagged <> '' THEN 'review_required' WHEN reference_count < 20 THEN 'collecting_reference' WHEN current_count < 20 THEN 'collecting_current' ELSE 'monitoring' END AS status FROM ws)"""


def status(spark, d):
    values, hits = drift_values(spark, d), found(spark, d)
    return drift.window_status(drift.series_state(values, hits)), hits


@query("d11_window_status", over_t(f", {DRIFT_BASE}, {BLOCK_SQL}, {COMPARE_SQL}, {STATE_SQL} SELECT subject, reference_count, current_count, flagged, baseline_version, trusted_events, status FROM status"))
def window_status(spark, d):
    rows, _ = status(spark, d)
    return rounded(rows.select("subject", "reference_count", "current_count", F.array_join("flagged_features", ",").alias("flagged"), "baseline_version", "trusted_events", "status"))


@query("d12_drift_summary", over_t(f""", {DRIFT_BASE}, {BLOCK_SQL}, {COMPARE_SQL}, {STATE_SQL} SELECT (SELECT count(*) FROM status) AS monitored_entities, (SELECT CAST(sum(trusted_events) AS BIGINT) FROM status) AS trusted_events,
 (SELECT count(*) FROM found) AS pending_reviews, CAST(0 AS BIGINT) AS approved_adaptations, CAST(0 AS BIGINT) AS rejected_changes, CAST(8 AS BIGINT) AS signals_monitored,
 CASE WHEN (SELECT count(*) FROM found) > 0 THEN 'action_required' WHEN (SELECT count(*) FROM status WHERE status LIKE 'collecting%') > 0 THEN 'learning' ELSE 'stable' END AS state"""))
def drift_summary(spark, d):
    rows, hits = status(spark, d)
    return rounded(drift.drift_summary(rows, hits))


@query("d13_reviewed_findings", over_t(f""", {DRIFT_BASE}, {BLOCK_SQL}, {COMPARE_SQL} SELECT subject, feature, last_us AS detected_us,
 CASE WHEN feature = 'download_volume_zscore' THEN 'approved_adaptation' WHEN feature = 'access_hour' THEN 'investigating' ELSE 'pending' END AS review_status FROM found ORDER BY last_us DESC, subject, feature LIMIT 10"""))
def review_list(spark, d):
    hits = found(spark, d)
    reviews = hits.where("feature IN ('access_hour', 'download_volume_zscore')").select("subject", "feature", F.explode(F.when(
        F.col("feature") == "access_hour", F.array(F.struct(F.lit("investigate").alias("action"), F.lit(1).alias("created_us")))).otherwise(F.array(
            F.struct(F.lit("investigate").alias("action"), F.lit(1).alias("created_us")), F.struct(F.lit("approve_adaptation").alias("action"), F.lit(2).alias("created_us")),
            F.struct(F.lit("reject_change").alias("action"), F.lit(3).alias("created_us"))))).alias("r")).select(
        "subject", "feature", "r.action", "r.created_us", F.lit("analyst").alias("analyst"), F.lit("").alias("comment"))
    return drift.newest_findings(drift.reviewed(hits, reviews), 10).select("subject", "feature", "detected_us", "review_status")


@query("d15_detector_quality", over_t(f""", {DRIFT_BASE}, {BLOCK_SQL}, {COMPARE_SQL}, tr AS (SELECT DISTINCT subject, subject IN ('analyst', 'engineer', 'manager') AS drifted FROM vals),
 j AS (SELECT tr.*, f.last_seq FROM tr LEFT JOIN (SELECT * FROM found WHERE feature = 'download_volume_zscore') f USING (subject))
 SELECT count(*) FILTER (WHERE drifted AND last_seq IS NOT NULL) AS true_positive_entities, count(*) FILTER (WHERE NOT drifted AND last_seq IS NOT NULL) AS false_positive_entities,
 {d6('count(*) FILTER (WHERE drifted AND last_seq IS NOT NULL) / greatest(count(last_seq), 1)')} AS entity_precision, {d6('count(*) FILTER (WHERE drifted AND last_seq IS NOT NULL) / greatest(count(*) FILTER (WHERE drifted), 1)')} AS entity_recall,
 {d6('count(*) FILTER (WHERE NOT drifted AND last_seq IS NOT NULL) / greatest(count(*) FILTER (WHERE NOT drifted), 1)')} AS stable_entity_false_positive_rate, {d6('avg(last_seq - 20) FILTER (WHERE drifted)')} AS mean_detection_delay_events FROM j"""))
def detector(spark, d):
    truth = events(spark, d).where("trusted").select(F.col("user_role").alias("subject")).distinct().withColumn("drifted", F.col("subject").isin("analyst", "engineer", "manager"))
    return rounded(drift.detector_quality(found(spark, d), truth, feature="download_volume_zscore"))


# A review by every 499th event of a role on four of its signals, unknown actions included.
LOG_SIGNALS = ("access_hour", "download_volume_zscore", "sequence_anomaly_score", "anomaly_score")
ACTIONS = ("approve_adaptation", "investigate", "reject_change", "dismiss", "postpone")
SHIFT_SQL = "CASE WHEN b.feature = 'access_hour' THEN least(abs(b.mean - a.mean) % 24, 24 - abs(b.mean - a.mean) % 24) ELSE abs(b.mean - a.mean) END"
EFFECT_SQL = f"({SHIFT_SQL}) / greatest((b.std + a.std) / 2, b.flr / 0.8)"
KS_SQL = "list_max(list_transform(list_concat(b.vs, a.vs), lambda x: abs(len(list_filter(b.vs, lambda v: v <= x)) / 20.0 - len(list_filter(a.vs, lambda v: v <= x)) / 20.0)))"
LOG_SQL = f"""{DRIFT_BASE},
rv AS MATERIALIZED (SELECT subject, feature, us, list_extract({list(ACTIONS)}, CAST(eid // 499 % 5 AS INT) + 1) AS action, 'a' || (eid % 3) AS analyst
  FROM (SELECT user_role AS subject, us, min(eid) AS eid FROM t WHERE eid % 499 = 0 GROUP BY 1, 2), (SELECT unnest({list(LOG_SIGNALS)}) AS feature)),
fin AS MATERIALIZED (SELECT r.*, (SELECT min(v.seq) FROM vals v WHERE v.subject = r.subject AND v.feature = r.feature AND v.us > r.us) AS resume FROM rv r WHERE action IN ('approve_adaptation', 'reject_change', 'dismiss')),
w0 AS (SELECT subject, feature, seq, list(CAST(value AS DOUBLE)) OVER win AS vs, max(us) OVER win AS last_us, count(*) OVER win AS n FROM vals WINDOW win AS (PARTITION BY subject, feature ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
w1 AS (SELECT *, list_avg(vs) AS m, atan2(list_avg(list_transform(vs, lambda v: sin(v / 24 * 2 * pi()))), list_avg(list_transform(vs, lambda v: cos(v / 24 * 2 * pi())))) AS angle FROM w0 WHERE n = 20),
w2 AS (SELECT *, CASE WHEN feature = 'access_hour' THEN CASE WHEN angle < 0 THEN angle + 2 * pi() ELSE angle END / (2 * pi()) * 24 ELSE m END AS mean FROM w1),
w3 AS (SELECT *, sqrt(list_avg(list_transform(vs, lambda v: CASE WHEN feature = 'access_hour' THEN pow(least(abs(v - mean) % 24, 24 - abs(v - mean) % 24), 2) ELSE pow(v - mean, 2) END))) AS std,
  CASE feature WHEN 'access_hour' THEN 1.5 WHEN 'download_volume_zscore' THEN 0.75 WHEN 'sequence_anomaly_score' THEN 0.12 WHEN 'anomaly_score' THEN 0.12 ELSE 0.15 END AS flr FROM w2),
w AS MATERIALIZED (SELECT w3.*, concat_ws('|', w3.subject, w3.feature, w3.seq) AS place, f.us AS f_us, f.action AS f_action, f.resume FROM w3 ASOF LEFT JOIN fin f ON w3.subject = f.subject AND w3.feature = f.feature AND w3.last_us <= f.us),
walk AS (SELECT DISTINCT subject, feature, CAST(1 AS BIGINT) AS ref, CAST(21 AS BIGINT) AS cur, CAST(1 AS BIGINT) AS version FROM vals
 UNION ALL SELECT subject, feature, CASE WHEN NOT sig OR f_action = 'approve_adaptation' THEN cur ELSE ref END, CASE WHEN sig THEN resume ELSE cur + 20 END,
  version + CASE WHEN NOT sig OR f_action = 'approve_adaptation' THEN 1 ELSE 0 END
 FROM (SELECT s.*, b.f_action, b.resume, {SHIFT_SQL} >= b.flr AND {EFFECT_SQL} >= 0.8 AND {KS_SQL} >= 0.3 AS sig FROM walk s
  JOIN w a ON a.place = concat_ws('|', s.subject, s.feature, s.ref) JOIN w b ON b.place = concat_ws('|', s.subject, s.feature, s.cur)) WHERE NOT sig OR resume IS NOT NULL),
hit AS MATERIALIZED (SELECT s.subject, s.feature, s.version, b.last_us, b.f_us, {EFFECT_SQL} AS effect, {SHIFT_SQL} AS shift, {KS_SQL} AS ks FROM walk s
  JOIN w a ON a.place = concat_ws('|', s.subject, s.feature, s.ref) JOIN w b ON b.place = concat_ws('|', s.subject, s.feature, s.cur)
  WHERE {SHIFT_SQL} >= b.flr AND {EFFECT_SQL} >= 0.8 AND {KS_SQL} >= 0.3),
dec AS (SELECT r.subject, r.feature, r.us, r.action, r.analyst, h.version + CASE WHEN r.action = 'approve_adaptation' THEN 1 ELSE 0 END AS version, r.us IS NOT DISTINCT FROM h.f_us AS resumes
  FROM rv r LEFT JOIN hit h ON h.subject = r.subject AND h.feature = r.feature AND r.us >= h.last_us AND (h.f_us IS NULL OR r.us <= h.f_us) AND r.action <> 'postpone')"""


def review_log(spark, d):
    stamped = events(spark, d).where("eid % 499 = 0").groupBy(F.col("user_role").alias("subject"), "us").agg(F.min("eid").alias("eid"))
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.floor(F.col("eid") / 499) % 5 + 1).cast("int"))
    return stamped.select("subject", F.explode(F.array(*[F.lit(s) for s in LOG_SIGNALS])).alias("feature"), "us", action.alias("action"), F.concat(F.lit("a"), F.col("eid") % 3).alias("analyst"))


@query("d10_reviewed_log", f"""WITH RECURSIVE {O.T}, {LOG_SQL}
SELECT subject, feature, last_us AS us, 'finding' AS kind, 'pending_review' AS status, version AS baseline_version, {d6('effect')} AS magnitude, {d6('shift')} AS absolute_shift, {d6('ks')} AS ks_distance, NULL AS analyst FROM hit
UNION ALL SELECT subject, feature, us, CASE WHEN version IS NULL THEN 'refused' ELSE list_extract(['approved_adaptation', 'investigating', 'rejected_change', 'dismissed'], list_position({list(ACTIONS)}, action)) END,
 CASE WHEN version IS NULL THEN NULL WHEN resumes THEN 'collecting_current' ELSE 'pending_review' END, version, NULL, NULL, NULL, analyst FROM dec""")
def reviewed_log(spark, d):
    """Drift over the whole log with reviews replayed in it."""
    rows = drift.reviewed_log(drift_values(spark, d), review_log(spark, d), POLICY)
    return rounded(rows.select("subject", "feature", "us", "kind", "status", "baseline_version", "magnitude", "absolute_shift", "ks_distance", "analyst"))

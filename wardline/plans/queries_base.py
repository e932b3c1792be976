"""Sources, validation, scalars and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import scalar as S
from wardline.operators import corpus, features, profiles, validate, windows
from wardline.operators.bounded_lists import spells
from wardline.plans import oracle as O
from wardline.plans.registry import d6, events, over_t, query, r6, rounded
from wardline.schema import FEATURES
from wardline.session import release

SPANS = windows.Spans(O.SHORT, O.MEDIUM, O.WEEK, O.MONTH)
LABELS = "(SELECT event_id, label, scenario_id FROM t WHERE eid % 997 <> 0)"


# ---- sources -------------------------------------------------------------------------------------

@query("s02_label_join", over_t(f"""SELECT t.event_id, l.label, l.scenario_id FROM t JOIN {LABELS} l USING (event_id)"""))
def label_join(spark, d):
    rows = events(spark, d)
    labels = rows.where("eid % 997 <> 0").select("event_id", "label", "scenario_id")
    return corpus.label_join(rows.select("event_id"), labels, strict=False)


@query("s02_label_audit", over_t(f"""SELECT (SELECT count(*) FROM t WHERE event_id NOT IN (SELECT event_id FROM {LABELS})) AS events_without_label,
 CAST(0 AS BIGINT) AS labels_without_event"""))
def label_audit(spark, d):
    rows = events(spark, d)
    return corpus.label_audit(rows, rows.where("eid % 997 <> 0").select("event_id", "label", "scenario_id"))


@query("s04_namespaced_union", over_t("""SELECT concat(split, '-', event_id) AS event_id, concat(split, '-', session_id) AS session_id,
 concat(split, '-', scenario_id) AS scenario_id, label FROM t"""))
def namespaced_union(spark, d):
    rows = events(spark, d)
    columns = ["event_id", "session_id", "scenario_id", "label"]
    return corpus.union_splits({s: rows.where(F.col("split") == s).select(*columns) for s in ("train", "validation", "test")})


# ---- validation -----------------------------------------------------------------------------------

DIRTY = """SELECT * REPLACE (CASE WHEN eid % 101 = 0 THEN 999.0 ELSE latitude END AS latitude,
 CASE WHEN eid % 103 = 0 THEN '' ELSE entity_id END AS entity_id,
 CASE WHEN event_type = 'api_call' AND eid % 107 = 0 THEN NULL ELSE api_route END AS api_route) FROM t"""


def dirty(spark, d):
    return events(spark, d).withColumns({
        "latitude": F.expr("CASE WHEN eid % 101 = 0 THEN 999.0D ELSE latitude END"),
        "entity_id": F.expr("CASE WHEN eid % 103 = 0 THEN '' ELSE entity_id END"),
        "api_route": F.expr("CASE WHEN event_type = 'api_call' AND eid % 107 = 0 THEN NULL ELSE api_route END")})


@query("v01_v04_violations", over_t(f""", bad AS ({DIRTY}), hits AS (
 SELECT event_id, array_to_string(list_filter([CASE WHEN length(entity_id) < 1 THEN 'entity_id' END, CASE WHEN latitude > 90 THEN 'latitude' END,
  CASE WHEN event_type = 'api_call' AND api_route IS NULL THEN 'api_call_fields' END], lambda v: v IS NOT NULL), ',') AS violations FROM bad)
 SELECT * FROM hits WHERE violations <> ''"""))
def violations(spark, d):
    _, quarantine = validate.split_valid(validate.check_events(dirty(spark, d)))
    return quarantine.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("v01_valid_rows", over_t(f""", bad AS ({DIRTY}) SELECT event_id FROM bad WHERE length(entity_id) > 0 AND latitude <= 90
 AND NOT (event_type = 'api_call' AND api_route IS NULL)"""))
def valid_rows(spark, d):
    valid, _ = validate.split_valid(validate.check_events(dirty(spark, d)))
    return valid.select("event_id")


@query("v02_closed_schema", """SELECT event_id, CASE WHEN event_id % 109 = 0 THEN 'extra' ELSE '' END AS unknown_keys FROM events""")
def closed_schema(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(
        "CASE WHEN event_id % 109 = 0 THEN concat(substr(props, 1, length(props) - 1), ', \"extra\": 1}') ELSE props END").alias("raw"))
    return raw.select("event_id", F.array_join(validate.unknown_keys("raw", ("k",)), ",").alias("unknown_keys"))


RAW_TIME = "concat(replace(CAST(ts AS VARCHAR(40)), ' ', 'T'), CASE WHEN event_id % 113 = 0 THEN '' ELSE '+00:00' END)"
NOW = "1704844800000000"


@query("v03_timestamp_rules", f"""SELECT event_id, CASE WHEN event_id % 113 = 0 THEN 'timestamp_zone'
 WHEN epoch_us(ts) - {NOW} > 300000000 THEN 'timestamp_future' ELSE '' END AS violations FROM events""")
def timestamps(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(RAW_TIME).alias("raw"))
    checked = validate.with_violations(raw, validate.timestamp_rules("raw", int(NOW)))
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("v05_first_by_id", over_t(""", doubled AS (SELECT *, 0 AS arrival FROM t UNION ALL SELECT *, 1 AS arrival FROM t WHERE eid % 50 = 0)
 SELECT event_id, us, arrival FROM doubled QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY us, arrival) = 1"""))
def dedup(spark, d):
    rows = events(spark, d).select("event_id", "us", "eid")
    doubled = rows.withColumn("arrival", F.lit(0)).unionByName(rows.where("eid % 50 = 0").withColumn("arrival", F.lit(1)))
    return validate.first_by_id(doubled, ("us", "arrival")).select("event_id", "us", "arrival")


# ---- scalars ---------------------------------------------------------------------------------------

@query("v06_v07_v17_clock_and_criticality", over_t(f"""SELECT event_id,
 {d6('least(1.0, greatest(0.0, 0.75 * resource_sensitivity + 0.25 * is_privileged_action::INT))')} AS criticality,
 {d6(O.hour('us'))} AS hour, CAST(CAST(make_timestamp(us) AS DATE) AS VARCHAR) AS day, CAST(floor(us / 900000000.0) AS BIGINT) AS bucket FROM t"""))
def clocks(spark, d):
    return events(spark, d).select(
        "event_id", r6(S.criticality("resource_sensitivity", "is_privileged_action")).alias("criticality"),
        r6(S.hour_of_day("us")).alias("hour"), S.utc_day("us").cast("string").alias("day"), S.bucket_15m("us").alias("bucket"))


@query("v08_circular_hours", over_t(f"""SELECT event_id, {d6(f"least(abs({O.hour('us')} - 23.5) % 24, 24 - abs({O.hour('us')} - 23.5) % 24)")} AS distance FROM t"""))
def circular(spark, d):
    return events(spark, d).select("event_id", r6(S.circular_hours(S.hour_of_day("us"), F.lit(23.5))).alias("distance"))


HAVERSINE = """6371.0088 * 2 * asin(sqrt(greatest(0, least(1, pow(sin(radians(latitude - 12.9716) / 2), 2)
 + cos(radians(12.9716)) * cos(radians(latitude)) * pow(sin(radians(longitude - 77.5946) / 2), 2)))))"""


@query("v09_v10_distance_and_speed", over_t(f"""SELECT event_id, {d6(HAVERSINE)} AS km,
 {d6(f"CASE WHEN eid % 24 = 0 THEN 20000.0 ELSE least(20000.0, {HAVERSINE} / ((eid % 24) / 10.0)) END")} AS kmh FROM t"""))
def geography(spark, d):
    km = S.great_circle_km(F.lit(12.9716), F.lit(77.5946), "latitude", "longitude")
    return events(spark, d).select("event_id", r6(km).alias("km"), r6(S.required_speed(km, F.expr("(eid % 24) / 10.0D"))).alias("kmh"))


@query("v11_guarded_z", over_t(f""", s AS (SELECT entity_id, count(*) AS n, avg(CAST(bytes_uploaded AS DOUBLE)) AS m,
 stddev_pop(CAST(bytes_uploaded AS DOUBLE)) AS d FROM t WHERE eid % 3 = 0 GROUP BY 1)
 SELECT event_id, {d6("CASE WHEN coalesce(n, 0) < 2 THEN 0.0 ELSE greatest(-20, least(20, (bytes_uploaded - m) / greatest(d, 1.0))) END")} AS z FROM t LEFT JOIN s USING (entity_id)"""))
def guarded(spark, d):
    rows = events(spark, d)
    value = F.col("bytes_uploaded").cast("double")
    s = rows.where("eid % 3 = 0").groupBy("entity_id").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("d"))
    return rows.join(s, "entity_id", "left").select("event_id", r6(S.guarded_z("bytes_uploaded", "n", "m", "d")).alias("z"))


@query("v12_print_distance", over_t(f"""SELECT event_id, {d6("len(list_filter(generate_series(1, 24), lambda i: substr(device_fingerprint, i, 1) <> substr(rpad(substr(device_mac_hash, 1, 20), 24, ' '), i, 1))) / 24.0")} AS distance FROM t"""))
def prints(spark, d):
    return events(spark, d).select("event_id", r6(S.nearest_print("device_fingerprint", F.array(F.substring("device_mac_hash", 1, 20)))).alias("distance"))


@query("v13_v14_display", over_t("""SELECT event_id, concat(CASE WHEN p_malicious < 0.6 AND label <> 'normal' THEN 'Possible ' ELSE '' END,
 array_to_string(list_transform(string_split(label, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ')) AS display,
 array_to_string(list_transform(string_split(entity_id, '-'), lambda w: concat(upper(w[1]), w[2:])), ' ') AS name FROM t"""))
def display(spark, d):
    return events(spark, d).select("event_id", S.display_class("label", "p_malicious").alias("display"), S.display_name("entity_id").alias("name"))


@query("v15_partition_loads")
def partitions(spark, d):
    return corpus.partition_loads(events(spark, d), 32)


@query("v16_cold_identities", over_t(""", a AS (SELECT * FROM t WHERE label <> 'normal'),
 e AS (SELECT scenario_id, entity_id, row_number() OVER (PARTITION BY scenario_id ORDER BY min(us)) - 1 AS n FROM a GROUP BY 1, 2),
 dv AS (SELECT scenario_id, id, row_number() OVER (PARTITION BY scenario_id ORDER BY min(us), min(place)) - 1 AS n FROM (
   SELECT scenario_id, device_id AS id, us, 0 AS place FROM a UNION ALL SELECT scenario_id, claimed_device_id, us, 1 FROM a) GROUP BY 1, 2)
 SELECT a.event_id, concat('cold-', a.scenario_id, '-', e.n) AS entity_id, concat('cold-', a.scenario_id, '-device-', d1.n) AS device_id,
  concat('cold-', a.scenario_id, '-device-', d2.n) AS claimed_device_id, concat('cold-', a.scenario_id, '-', device_fingerprint) AS device_fingerprint
 FROM a JOIN e ON a.scenario_id = e.scenario_id AND a.entity_id = e.entity_id
 JOIN dv d1 ON a.scenario_id = d1.scenario_id AND a.device_id = d1.id JOIN dv d2 ON a.scenario_id = d2.scenario_id AND a.claimed_device_id = d2.id"""))
def cold_ids(spark, d):
    return corpus.cold_identities(events(spark, d)).select("event_id", "entity_id", "device_id", "claimed_device_id", "device_fingerprint")


# ---- features -----------------------------------------------------------------------------------------

def feature_sql(ctes: str, table: str, names) -> str:
    return f"WITH {ctes} SELECT event_id, {', '.join(f'{d6(n)} AS {n}' for n in names)} FROM {table}"


MINUTE = ("failed_auth_count_1m", "auth_attempt_count_5m", "successful_auth_after_failures_score", "source_ip_unique_entities_5m",
          "source_ip_failure_ratio_5m", "api_call_rate_1m_zscore", "api_error_ratio_5m", "unique_destination_hosts_5m")


@query("f01_f05_f07_f08_f18_minute_windows", feature_sql(f"{O.T}, {O.MINUTE_CTE}", "minute", MINUTE))
def minute(spark, d):
    return rounded(windows.minute_features(events(spark, d), SPANS))


@query("f13_device_mismatch", over_t("SELECT event_id, CAST(device_id <> claimed_device_id AS DOUBLE) AS claimed_observed_device_mismatch_score FROM t"))
def mismatch(spark, d):
    return windows.event_columns(events(spark, d))


@query("f16_travel", feature_sql(f"{O.T}, {O.TRAVEL_CTE}", "travel", ("vpn_aware_travel_anomaly_score",)))
def travel(spark, d):
    return rounded(windows.travel_features(events(spark, d)).drop("seconds_since_last"))


@query("f31_active_sessions", feature_sql(f"{O.T}, {O.SESSION_CTE}", "sessions", ("active_concurrent_session_count",)))
def sessions(spark, d):
    return rounded(windows.session_features(events(spark, d)))


STATISTIC = ("access_hour_deviation_score", "resource_sensitivity_deviation_score", "download_volume_zscore", "upload_volume_zscore",
             "session_duration_zscore", "inter_event_time_zscore")
PROFILE = f"{O.T}, {O.baseline_cte()}, {O.PAIRS_CTE}"


def _profiled(spark, d):
    rows = events(spark, d)
    placed = features.cut_lineage(profiles.positions(rows))
    chosen = features.cut_lineage(profiles.choose_baseline(placed))
    return rows, placed, chosen


def _numeric(rows, placed, chosen):
    facts = features.cut_lineage(profiles.facts_of(placed, chosen))
    since = windows.travel_features(rows).select("event_id", "seconds_since_last")
    return facts, profiles.numeric_features(rows, chosen, facts, since)


@query("f17_f22_f26_f27_f29_f30_histories", feature_sql(f"{PROFILE}, {O.STATS_CTE}", "statistic", STATISTIC))
def histories(spark, d):
    _, numeric = _numeric(*_profiled(spark, d))
    return rounded(numeric.select("event_id", *STATISTIC))


RANGE = ("resource_access_entropy_24h", "cumulative_external_transfer_24h_zscore", "sensitive_access_rate_30d_zscore")


@query("f21_f28_f32_ranges", feature_sql(f"{PROFILE}, {O.STATS_CTE}", "statistic", RANGE))
def ranges(spark, d):
    rows, placed, chosen = _profiled(spark, d)
    facts, numeric = _numeric(rows, placed, chosen)
    release(placed)
    numeric = features.cut_lineage(numeric)
    return rounded(profiles.range_features(rows, chosen, facts, numeric, SPANS))


NOVELTY = ("auth_method_novelty_score", "api_endpoint_method_novelty_score", "source_ip_novelty_score", "new_device_score",
           "device_fingerprint_distance", "device_posture_novelty_score", "location_novelty_score", "resource_novelty_score",
           "event_action_novelty_score", "privilege_expansion_score", "protocol_port_novelty_score", "command_transition_novelty_score")


@query("p06_f06_f25_novelty", feature_sql(f"{PROFILE}, {O.NOVELTY_CTE}", "novelty", NOVELTY))
def novelty(spark, d):
    rows, _, chosen = _profiled(spark, d)
    seen = features.cut_lineage(profiles.first_sightings(rows, profiles.asked_keys(chosen).drop("asked_n")))
    return rounded(profiles.novelty_features(rows, chosen, seen))


def feature_table(spark, d):
    return features.behaviour_features(events(spark, d), SPANS)


@query("f01_f32_vector", feature_sql(O.features_cte(), "features", FEATURES))
def all_features(spark, d):
    return rounded(feature_table(spark, d).select("event_id", *FEATURES))


@query("f33_slices", f"""WITH {O.T}, {O.MINUTE_CTE} SELECT event_id, {d6('failed_auth_count_1m')} AS first_of_domain,
 {d6('auth_attempt_count_5m + source_ip_unique_entities_5m + source_ip_failure_ratio_5m + api_call_rate_1m_zscore + api_error_ratio_5m')} AS domain_sum,
 {d6('unique_destination_hosts_5m')} AS temporal_ninth, CAST(16 AS BIGINT) AS temporal_width FROM minute""")
def slices(spark, d):
    rows = windows.minute_features(events(spark, d), SPANS)
    wide = rows.select("event_id", *[(F.col(f) if f in rows.columns else F.lit(0.0)).alias(f) for f in FEATURES])
    wide = wide.select("event_id", features.vector().alias("values"))
    part = features.domain_slice(F.col("values"), "authentication_api")
    temporal = features.temporal_subset(F.col("values"))
    picked = F.element_at(part, 2) + F.element_at(part, 4) + F.element_at(part, 5) + F.element_at(part, 7) + F.element_at(part, 8)
    return wide.select("event_id", r6(F.element_at(part, 1)).alias("first_of_domain"), r6(picked).alias("domain_sum"),
                       r6(F.element_at(temporal, 9)).alias("temporal_ninth"), F.size(temporal).cast("long").alias("temporal_width"))


@query("f34_finite", over_t("""SELECT event_id, CASE WHEN eid % 3 = 0 THEN 0.0 WHEN eid % 3 = 1 THEN 0.0 ELSE round(anomaly_score, 6) + 0.0 END AS value FROM t"""))
def guarded_values(spark, d):
    broken = F.expr("CASE WHEN eid % 3 = 0 THEN double('NaN') WHEN eid % 3 = 1 THEN double('-Infinity') ELSE anomaly_score END")
    return events(spark, d).select("event_id", r6(S.finite(broken)).alias("value"))


# ---- profiles -------------------------------------------------------------------------------------------

@query("p05_fan_out", over_t(f""", {O.KEYED_CTE} SELECT split_part(key, ':', 1) AS kind, key, count(*) AS facts FROM
 (SELECT unnest([ek, dk, pk, gk]) AS key FROM keyed WHERE trusted) GROUP BY 1, 2"""))
def fan_out(spark, d):
    return profiles.fan_out(events(spark, d).where("trusted")).groupBy("kind", "key").agg(F.count("*").alias("facts"))


@query("p07_p09_p10_p15_baseline", f"""WITH {O.T}, {O.baseline_cte()} SELECT event_id, baseline_kind, key, baseline_count,
 {d6(O.CONFIDENCE)} AS baseline_confidence, subject_history_count, NOT mature AS cold_start, CASE WHEN mature THEN 'mature' ELSE 'building' END AS maturity FROM base""")
def baseline(spark, d):
    chosen = profiles.choose_baseline(profiles.positions(events(spark, d)))
    return chosen.select("event_id", "baseline_kind", "key", "baseline_count", r6("baseline_confidence").alias("baseline_confidence"),
                         "subject_history_count", profiles.is_cold("baseline_kind").alias("cold_start"), profiles.maturity("baseline_kind").alias("maturity"))


RUNTIME_KIND = """CASE WHEN ne >= 12 THEN 'entity' WHEN nd >= 12 THEN 'device' WHEN np >= 25 THEN 'peer' WHEN ng >= 25 THEN 'global'
 WHEN pp IS NOT NULL THEN 'peer_prior' WHEN gp IS NOT NULL THEN 'global_prior' ELSE 'global_default' END"""


@query("p08_p12_runtime_baseline", f"""WITH {O.T}, {O.baseline_cte()},
 priors AS (SELECT key, count(*) AS n FROM (SELECT unnest([pk, gk]) AS key FROM keyed WHERE trusted AND split = 'train' AND user_role <> 'support') GROUP BY 1),
 k AS (SELECT c.*, p.n AS pp, g.n AS gp FROM counted c LEFT JOIN priors p ON p.key = c.pk LEFT JOIN priors g ON g.key = c.gk),
 r AS (SELECT *, {RUNTIME_KIND} AS kind FROM k)
 SELECT event_id, kind AS baseline_kind, CASE kind WHEN 'entity' THEN ne WHEN 'device' THEN nd WHEN 'peer' THEN np WHEN 'global' THEN ng
  WHEN 'peer_prior' THEN pp WHEN 'global_prior' THEN gp ELSE 0 END AS baseline_count,
  {d6("CASE WHEN kind LIKE '%_prior' THEN 0.55 WHEN kind = 'global_default' THEN 0.1 WHEN kind IN ('entity', 'device') THEN least(1.0, 0.25 + 0.75 * (CASE kind WHEN 'entity' THEN ne ELSE nd END) / 24.0) ELSE least(1.0, 0.25 + 0.75 * (CASE kind WHEN 'peer' THEN np ELSE ng END) / 50.0) END")} AS baseline_confidence FROM r""")
def runtime_baseline(spark, d):
    rows = events(spark, d)
    priors = profiles.bootstrap_priors(rows.where("split = 'train' AND user_role <> 'support'"))
    chosen = profiles.choose_baseline(profiles.positions(rows), runtime=True, priors=priors)
    return chosen.select("event_id", "baseline_kind", "baseline_count", r6("baseline_confidence").alias("baseline_confidence"))


@query("p01_p03_p04_numeric_history", f"""WITH {O.T}, {O.KEYED_CTE}, f AS (SELECT ek AS key, us, event_id, bytes_downloaded AS down, session_duration_seconds AS dur,
  us - lag(us) OVER (PARTITION BY ek ORDER BY us, event_id) AS gap FROM keyed WHERE trusted)
 SELECT key, row_number() OVER w AS n, {d6('avg(CAST(down AS DOUBLE)) OVER w')} AS down_mean, {d6('stddev_pop(CAST(dur AS DOUBLE)) OVER w')} AS duration_std,
  CAST(coalesce(sum(gap) OVER w, 0) AS BIGINT) AS gap_sum FROM f WINDOW w AS (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
 """.replace("row_number() OVER w AS n", "row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n"))
def numeric_history(spark, d):
    policy = profiles.ProfilePolicy(numeric_limit=20, chunk=32)
    placed = profiles.positions(events(spark, d)).where("trusted AND kind = 'entity'")
    facts = placed.withColumn("n", F.col("facts_before") + 1)
    state = profiles.numeric_history(facts, policy)
    n = F.least(F.col("n"), F.lit(20))
    return state.select("key", "n", r6(profiles.mean_of("down", n)).alias("down_mean"), r6(profiles.deviation_of("duration", n)).alias("duration_std"),
                        F.col("s_gap").cast("long").alias("gap_sum"))


@query("p02_eviction", f"""WITH RECURSIVE {O.T}, shown AS (SELECT user_role AS role, resource_id AS value, us, row_number() OVER (PARTITION BY user_role ORDER BY us, event_id) AS n FROM t WHERE trusted),
 replay AS (SELECT role, size, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS held, false AS added, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS us
   FROM (SELECT DISTINCT role FROM shown), (VALUES (2), (5)) AS s(size)
  UNION ALL SELECT r.role, size, x.n, CASE WHEN list_contains(held, x.value) THEN held ELSE list_append(held, x.value)[-size:] END, NOT list_contains(held, x.value), x.value, x.us
   FROM replay r JOIN shown x ON x.role = r.role AND x.n = r.n + 1),
 kept AS (SELECT role, size, n, us, held FROM replay)
 SELECT CAST(a.size AS BIGINT) AS size, a.role, a.value, a.us AS first_us, min(b.us) AS gone_us FROM replay a
 LEFT JOIN kept b ON b.role = a.role AND b.size = a.size AND b.n > a.n AND NOT list_contains(b.held, a.value) WHERE a.added GROUP BY a.size, a.role, a.n, a.value, a.us""")
def eviction(spark, d):
    """Lists of two and of five resources per role; values that were pushed out and are seen again come back."""
    sizes = {"two": 2, "five": 5}
    shown = events(spark, d).where("trusted").select(
        F.lit("").alias("scope"), F.col("user_role").alias("key"), F.explode(F.array(*[F.lit(x) for x in sizes])).alias("dim"),
        F.col("resource_id").alias("value"), "us", "event_id", F.lit(0).alias("place"))
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))
    return spells(shown, sizes).select(
        size.cast("long").alias("size"), F.col("key").alias("role"), "value", F.col("first_at.us").alias("first_us"), F.col("gone_at.us").alias("gone_us"))


LIVE = "least(100.0, greatest(0.0, 100.0 * (0.30 * anomaly_score + 0.05 * sequence_anomaly_score + 0.25 * p_malicious + 0.35 * deviation)))"


@query("p11_live_trust", over_t(f"SELECT event_id, CAST(printf('%.2f', {LIVE}) AS DOUBLE) <= 29 AND (p_malicious < 0.5) OR eid % 41 = 0 AS trusted FROM t"))
def live_trust(spark, d):
    risk = F.expr("100.0D * (0.30D * anomaly_score + 0.05D * sequence_anomaly_score + 0.25D * p_malicious + 0.35D * deviation)")
    rows = events(spark, d).select("event_id", risk.alias("risk_score"), F.expr("eid % 41 = 0").alias("trusted_override"),
                                   F.expr("CASE WHEN p_malicious < 0.5 THEN 'normal' ELSE 'brute_force' END").alias("predicted_attack"))
    return profiles.trusted_live(rows).select("event_id", "trusted")


SHIFT = 90 * 86_400_000_000


@query("p13_holdout_fork", f"""WITH {O.T}, m AS (SELECT event_id, entity_id, device_id, split, CASE WHEN split = 'train' THEN us - {SHIFT} ELSE us END AS us,
  CASE WHEN split = 'train' THEN label = 'normal' ELSE true END AS ok FROM t),
 s AS (SELECT split AS scope, * EXCLUDE (split), false AS seed FROM m UNION ALL
   SELECT h.scope, m.* EXCLUDE (split), true FROM m, (SELECT unnest(['validation', 'test', 'audit']) AS scope) h WHERE m.split = 'train' AND ok),
 n AS (SELECT scope, event_id, seed, count(*) FILTER (WHERE ok) OVER (PARTITION BY scope, entity_id {O.BEFORE}) AS entity_facts,
   count(*) FILTER (WHERE ok) OVER (PARTITION BY scope, device_id {O.BEFORE}) AS device_facts FROM s)
 SELECT scope, event_id, entity_facts, device_facts FROM n WHERE NOT seed""")
def fork(spark, d):
    rows = events(spark, d).drop("trusted").withColumn("us", F.expr(f"CASE WHEN split = 'train' THEN us - {SHIFT}L ELSE us END"))
    placed = profiles.positions(profiles.fork_holdouts(rows)).where("NOT seed")

    def of(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("facts_before")))

    return placed.groupBy("scope", "event_id").agg(of("entity").alias("entity_facts"), of("device").alias("device_facts"))


@query("p14_profile_summary", f"""WITH {O.T}, {O.KEYED_CTE}, f AS (SELECT unnest([ek, dk, pk, gk]) AS key, us, event_id, authentication_result, bytes_downloaded, session_duration_seconds FROM keyed WHERE trusted),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us DESC, event_id DESC) AS rn,
   sum((authentication_result = 'success')::INT) OVER (PARTITION BY key ORDER BY us DESC, event_id DESC) AS srn FROM f)
 SELECT key, split_part(key, ':', 1) AS baseline_kind, count(*) AS event_count,
  {d6(f"coalesce(avg({O.hour('us')}) FILTER (WHERE authentication_result = 'success' AND srn <= 500), 0)")} AS login_hour_mean,
  {d6(f"coalesce(stddev_pop({O.hour('us')}) FILTER (WHERE authentication_result = 'success' AND srn <= 500), 0)")} AS login_hour_std,
  {d6("avg(CAST(bytes_downloaded AS DOUBLE)) FILTER (WHERE rn <= 500)")} AS download_mean, {d6("stddev_pop(CAST(bytes_downloaded AS DOUBLE)) FILTER (WHERE rn <= 500)")} AS download_std,
  {d6("avg(CAST(session_duration_seconds AS DOUBLE)) FILTER (WHERE rn <= 500)")} AS session_mean, {d6("stddev_pop(CAST(session_duration_seconds AS DOUBLE)) FILTER (WHERE rn <= 500)")} AS session_std
 FROM r GROUP BY 1, 2""")
def summary(spark, d):
    return rounded(profiles.profile_summary(events(spark, d)))


@query("p14_known_values", f"""WITH {O.T}, f AS (SELECT concat('entity:', entity_id) AS key, resource_id, min(us) AS first_us FROM t WHERE trusted GROUP BY 1, 2)
 SELECT key, string_agg(resource_id, ',' ORDER BY first_us) AS known FROM f GROUP BY 1""")
def known(spark, d):
    rows = profiles.known_values(events(spark, d), ("resource",))
    return rows.where(F.col("key").startswith("entity:")).select("key", F.array_join("known", ",").alias("known"))

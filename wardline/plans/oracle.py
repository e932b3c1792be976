"""DuckDB texts the registered queries are checked against.

These are written as literal per-event joins over the whole tables, on purpose unlike the Spark side.
"""

from __future__ import annotations

from wardline.sources.telemetry import DUCK_TELEMETRY

HOUR = 3_600_000_000
SHORT, MEDIUM, WEEK, MONTH = 6 * HOUR, 30 * HOUR, 7 * 24 * HOUR, 30 * 24 * HOUR

T = f"t AS MATERIALIZED (SELECT *, label = 'normal' AS trusted FROM ({DUCK_TELEMETRY}))"

HOUR_OF_DAY = "(floor(({us} % 86400000000) / 3600000000.0) + floor(({us} % 3600000000) / 60000000.0) / 60.0)"


def hour(us: str) -> str:
    return HOUR_OF_DAY.replace("{us}", us)


MINUTE_CTE = f"""
minute_rows AS (
 SELECT a.event_id,
  count(*) FILTER (WHERE b.authentication_result = 'failure' AND b.us >= a.us - {SHORT}) AS fail_s,
  count(*) FILTER (WHERE b.authentication_result = 'failure') AS fail_m,
  count(*) FILTER (WHERE b.authentication_result <> 'not_applicable') AS auth_m,
  count(*) FILTER (WHERE b.authentication_result = 'failure' AND b.source_ip = a.source_ip) AS ip_fail,
  count(*) FILTER (WHERE b.authentication_result <> 'not_applicable' AND b.source_ip = a.source_ip) AS ip_auth,
  count(*) FILTER (WHERE b.event_type = 'api_call' AND b.entity_id = a.entity_id AND b.us >= a.us - {SHORT}) AS api_s,
  count(*) FILTER (WHERE b.event_type = 'api_call' AND b.entity_id = a.entity_id) AS api_m,
  count(*) FILTER (WHERE b.event_type = 'api_call' AND b.entity_id = a.entity_id
                   AND (coalesce(b.http_status_code, 0) >= 400 OR b.access_outcome IN ('denied', 'error'))) AS bad_m,
  len(list_distinct(list_append(coalesce(list(b.entity_id) FILTER (WHERE b.source_ip = a.source_ip), []), a.entity_id))) AS entities,
  len(list_distinct(list_append(coalesce(list(b.destination_host) FILTER (WHERE b.entity_id = a.entity_id), []), a.destination_host))) AS hosts
 FROM t a LEFT JOIN t b ON (a.entity_id = b.entity_id OR a.source_ip = b.source_ip) AND b.us >= a.us - {MEDIUM} AND b.us < a.us
 GROUP BY a.event_id, a.entity_id, a.destination_host),
minute AS (
 SELECT t.event_id, CAST(fail_s + (authentication_result = 'failure')::INT AS DOUBLE) AS failed_auth_count_1m,
  CAST(auth_m + (authentication_result <> 'not_applicable')::INT AS DOUBLE) AS auth_attempt_count_5m,
  CASE WHEN authentication_result = 'success' THEN least(1.0, fail_m / 5.0) ELSE 0 END AS successful_auth_after_failures_score,
  CAST(entities AS DOUBLE) AS source_ip_unique_entities_5m,
  (ip_fail + (authentication_result = 'failure')::INT) / CAST(greatest(ip_auth + (authentication_result <> 'not_applicable')::INT, 1) AS DOUBLE) AS source_ip_failure_ratio_5m,
  CASE WHEN event_type = 'api_call' THEN CAST(least(api_s, 20) AS DOUBLE) ELSE 0 END AS api_call_rate_1m_zscore,
  (bad_m + (event_type = 'api_call' AND (coalesce(http_status_code, 0) >= 400 OR access_outcome IN ('denied', 'error')))::INT)
   / CAST(greatest(api_m + (event_type = 'api_call')::INT, 1) AS DOUBLE) AS api_error_ratio_5m,
  CAST(hosts AS DOUBLE) AS unique_destination_hosts_5m
 FROM t JOIN minute_rows USING (event_id))"""

TRAVEL_CTE = """
last_success AS (
 SELECT a.event_id, max_by(struct_pack(us := b.us, lat := b.latitude, lon := b.longitude, vpn := b.is_vpn), b.us) AS p
 FROM t a JOIN t b ON a.entity_id = b.entity_id AND b.us < a.us AND b.authentication_result = 'success' GROUP BY 1),
travel_rows AS (
 SELECT t.*, p, (t.us - p.us) / 3.6e9 AS hours, 6371.0088 * 2 * asin(sqrt(greatest(0, least(1,
   pow(sin(radians(t.latitude - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.latitude)) * pow(sin(radians(t.longitude - p.lon) / 2), 2))))) AS km
 FROM t LEFT JOIN last_success USING (event_id)),
travel AS (
 SELECT event_id, CASE WHEN p IS NULL THEN 0.0 ELSE greatest(0, least(1, (least(20000.0, km / hours) - 250) / 750.0))
   * CASE WHEN is_vpn OR p.vpn THEN 0.35 ELSE 1.0 END END AS vpn_aware_travel_anomaly_score FROM travel_rows)"""

SESSION_CTE = """
sessions AS (
 SELECT a.event_id, CAST(count(DISTINCT b.session_id) + 1 AS DOUBLE) AS active_concurrent_session_count
 FROM t a LEFT JOIN t b ON a.entity_id = b.entity_id AND b.session_id <> a.session_id AND b.us < a.us
  AND a.us < b.us + CAST(b.session_duration_seconds AS BIGINT) * 1000000 GROUP BY 1)"""

BEFORE = "ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
KEYED_CTE = """
keyed AS MATERIALIZED (SELECT *, concat('entity:', entity_id) AS ek, concat('device:', device_id) AS dk,
 concat('peer:', entity_type, ':', department, ':', user_role) AS pk, 'global:organization' AS gk FROM t)"""


def baseline_cte(entity_min: int = 12, peer_min: int = 25) -> str:
    return KEYED_CTE + f""",
counted AS (SELECT *, count(*) FILTER (WHERE trusted) OVER (PARTITION BY ek {BEFORE}) AS ne,
  count(*) FILTER (WHERE trusted) OVER (PARTITION BY dk {BEFORE}) AS nd,
  count(*) FILTER (WHERE trusted) OVER (PARTITION BY pk {BEFORE}) AS np,
  count(*) FILTER (WHERE trusted) OVER (PARTITION BY gk {BEFORE}) AS ng FROM keyed),
kinds AS (SELECT *, CASE WHEN ne >= {entity_min} THEN 'entity' WHEN nd >= {entity_min} THEN 'device' WHEN np >= {peer_min} THEN 'peer'
   WHEN ng > 0 THEN 'global' ELSE 'global_default' END AS baseline_kind FROM counted),
base AS MATERIALIZED (SELECT *, CASE baseline_kind WHEN 'entity' THEN ek WHEN 'device' THEN dk WHEN 'peer' THEN pk ELSE gk END AS key,
  CASE baseline_kind WHEN 'entity' THEN ne WHEN 'device' THEN nd WHEN 'peer' THEN np ELSE ng END AS baseline_count,
  CASE WHEN baseline_kind IN ('entity', 'device') THEN {entity_min} ELSE {peer_min} END AS minimum,
  greatest(ne, nd) AS subject_history_count, baseline_kind IN ('entity', 'device') AS mature FROM kinds)"""


CONFIDENCE = "CASE WHEN baseline_count > 0 THEN least(1.0, 0.25 + 0.75 * baseline_count / (2.0 * minimum)) ELSE 0.1 END"

PAIRS_CTE = """
facts_raw AS (
 SELECT unnest([ek, dk, pk, gk]) AS key, * EXCLUDE (ek, dk, pk, gk) FROM keyed WHERE trusted),
facts AS MATERIALIZED (
 SELECT *, (us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id)) / 1e6 AS gap,
  (resource_sensitivity >= 0.7 OR is_privileged_action)::INT AS flag, bytes_uploaded + bytes_downloaded AS moved FROM facts_raw
 WHERE key IN (SELECT key FROM base)),
pairs AS MATERIALIZED (
 SELECT b.event_id AS q, b.us AS q_us, f.*,
  row_number() OVER w AS rn, sum(f.is_external_destination::INT) OVER w AS ext_rn
 FROM base b JOIN facts f ON f.key = b.key AND (f.us < b.us OR (f.us = b.us AND f.event_id < b.event_id))
 WINDOW w AS (PARTITION BY b.event_id ORDER BY f.us DESC, f.event_id DESC))"""


def z(value: str, name: str) -> str:
    return (f"CASE WHEN coalesce(n_{name}, 0) < 2 THEN 0.0 ELSE greatest(-20, least(20, ({value} - m_{name}) / greatest(d_{name}, 1.0))) END")


def _stats(name: str, value: str, cond: str = "rn <= 500") -> str:
    return (f"count({value}) FILTER (WHERE {cond}) AS n_{name}, avg(CAST({value} AS DOUBLE)) FILTER (WHERE {cond}) AS m_{name}, "
            f"stddev_pop(CAST({value} AS DOUBLE)) FILTER (WHERE {cond}) AS d_{name}")


STATS_CTE = f"""
stats AS MATERIALIZED (SELECT q AS event_id, sum(CAST(floor((us % 86400000000) / 60000000.0) AS BIGINT)) FILTER (WHERE rn <= 500) / 60.0 / count(*) FILTER (WHERE rn <= 500) AS m_hour, {_stats('sens', 'resource_sensitivity')},
 {_stats('flag', 'flag')}, {_stats('down', 'bytes_downloaded')}, {_stats('up', 'bytes_uploaded')},
 {_stats('dur', 'session_duration_seconds')}, {_stats('gap', 'gap')},
 {_stats('ext', 'moved', 'is_external_destination AND ext_rn <= 500')},
 count(*) FILTER (WHERE rn <= 1000 AND us >= q_us - {MONTH}) AS n30, coalesce(sum(flag) FILTER (WHERE rn <= 1000 AND us >= q_us - {MONTH}), 0) AS f30,
 count(*) FILTER (WHERE is_external_destination AND ext_rn <= 1000 AND us >= q_us - {WEEK}) AS n24,
 coalesce(sum(moved) FILTER (WHERE is_external_destination AND ext_rn <= 1000 AND us >= q_us - {WEEK}), 0) AS s24
 FROM pairs GROUP BY 1),
visits AS (SELECT event_id, resource_id, count(*) AS c FROM (
  SELECT q AS event_id, resource_id FROM pairs WHERE rn <= 1000 AND us >= q_us - {WEEK}
  UNION ALL SELECT event_id, resource_id FROM t) GROUP BY 1, 2),
mix AS (SELECT event_id, count(*) AS k, sum(c) AS n, sum(c * ln(c)) AS mass FROM visits GROUP BY 1),
since AS (SELECT event_id, (us - max(us) OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6 AS since FROM t),
stat_rows AS (SELECT b.*, s.* EXCLUDE (event_id), m.k, m.n AS visits_n, m.mass, since.since,
   {hour('b.us')} AS hour, (b.resource_sensitivity >= 0.7 OR b.is_privileged_action)::INT AS flag_now,
   coalesce(n24, 0) + b.is_external_destination::INT AS moves,
   coalesce(s24, 0) + CASE WHEN b.is_external_destination THEN b.bytes_uploaded + b.bytes_downloaded ELSE 0 END AS moved_total
 FROM base b LEFT JOIN stats s USING (event_id) JOIN mix m USING (event_id) JOIN since USING (event_id)),
statistic AS (SELECT event_id,
 CASE WHEN baseline_count = 0 THEN 0.25 ELSE least(1.0, least(abs(hour - m_hour) % 24, 24 - abs(hour - m_hour) % 24) / 6.0) END AS access_hour_deviation_score,
 CASE WHEN k <= 1 THEN 0.0 ELSE (ln(visits_n) - mass / visits_n) / ln(k) * least(1.0, (k - 1) / 5.0) END AS resource_access_entropy_24h,
 greatest(0, least(1, greatest(0, {z('resource_sensitivity', 'sens')}) / 5.0)) AS resource_sensitivity_deviation_score,
 {z('bytes_downloaded', 'down')} AS download_volume_zscore, {z('bytes_uploaded', 'up')} AS upload_volume_zscore,
 CASE WHEN moves = 0 THEN 0.0 WHEN coalesce(n_ext, 0) < 2 THEN greatest(0, least(1, ln(1 + moved_total) / ln(10000001.0)))
  ELSE greatest(-20, least(20, (moved_total - m_ext * moves) / greatest(d_ext * sqrt(moves), 1000.0))) END AS cumulative_external_transfer_24h_zscore,
 {z('session_duration_seconds', 'dur')} AS session_duration_zscore,
 CASE WHEN mature AND since IS NOT NULL THEN {z('since', 'gap')} ELSE 0.0 END AS inter_event_time_zscore,
 CASE WHEN coalesce(n_flag, 0) < 2 THEN CASE WHEN flag_now = 1 THEN 0.25 ELSE 0.0 END
  ELSE greatest(-20, least(20, ((coalesce(f30, 0) + flag_now) / (coalesce(n30, 0) + 1.0) - m_flag) / greatest(d_flag, 0.1))) END AS sensitive_access_rate_30d_zscore
 FROM stat_rows)"""

COMMANDS = "list_filter(string_split({x}commands, '>'), lambda c: c <> '')"


def pairs_of(alias: str) -> str:
    commands = COMMANDS.replace("{x}", alias)
    return (f"list_transform(generate_series(1, len({commands})), lambda i: concat(CASE WHEN i = 1 THEN '__start__' "
            f"ELSE {commands}[i - 1] END, '->', {commands}[i]))")


POSTURE = "concat_ws('|', {x}operating_system, {x}firmware_version, {x}browser, {x}device_mac_hash)"


def posture(alias: str) -> str:
    return POSTURE.replace("{x}", alias)


NOVELTY_CTE = f"""
steps AS (SELECT event_id, unnest({pairs_of('')}) AS step FROM t),
known AS (SELECT b.event_id,
  bool_or(p.auth_method <> 'not_applicable') AS any_method, bool_or(p.auth_method = b.auth_method) AS method,
  bool_or(p.event_type = 'api_call') AS any_endpoint,
  bool_or(p.event_type = 'api_call' AND p.http_method = b.http_method AND p.api_route = b.api_route) AS endpoint,
  bool_or(p.source_ip = b.source_ip) AS ip, bool_or(p.device_id = b.device_id) AS device,
  bool_or({posture('p.')} = {posture('b.')}) AS posture, bool_or(p.country = b.country AND p.city = b.city) AS place,
  bool_or(p.resource_id = b.resource_id) AS resource, bool_or(p.event_type = b.event_type AND p.action = b.action) AS act,
  bool_or(p.is_privileged_action AND p.resource_id = b.resource_id) AS privileged,
  bool_or(p.network_protocol = b.network_protocol AND p.destination_port = b.destination_port) AS port,
  bool_or(p.commands <> '') AS any_step
 FROM base b JOIN pairs p ON p.q = b.event_id GROUP BY 1),
prints AS (SELECT b.event_id, min(len(list_filter(generate_series(1, 24), lambda i: substr(b.device_fingerprint, i, 1) <> substr(p.f, i, 1))) / 24.0) AS distance
 FROM base b JOIN (SELECT DISTINCT q, device_fingerprint AS f FROM pairs) p ON p.q = b.event_id GROUP BY 1),
step_keys AS (SELECT f.key, s.step, min(f.us) AS first_us FROM facts f JOIN steps s USING (event_id) GROUP BY 1, 2),
new_steps AS (SELECT b.event_id, avg(CASE WHEN k.first_us < b.us THEN 0.0 ELSE 1.0 END) AS share
 FROM base b JOIN steps s USING (event_id) LEFT JOIN step_keys k ON k.key = b.key AND k.step = s.step GROUP BY 1),
novelty AS (SELECT b.event_id,
 CASE WHEN NOT coalesce(any_method, false) THEN 0.25 WHEN b.auth_method = 'not_applicable' OR method THEN 0.0 ELSE 1.0 END AS auth_method_novelty_score,
 CASE WHEN b.event_type <> 'api_call' THEN 0.0 WHEN NOT coalesce(any_endpoint, false) THEN 0.25 WHEN endpoint THEN 0.0 ELSE 1.0 END AS api_endpoint_method_novelty_score,
 CASE WHEN NOT mature THEN 0.25 WHEN ip THEN 0.0 ELSE 1.0 END AS source_ip_novelty_score,
 CASE WHEN NOT mature THEN 0.35 WHEN device THEN 0.0 ELSE 1.0 END AS new_device_score,
 CASE WHEN NOT mature THEN 0.35 ELSE distance END AS device_fingerprint_distance,
 CASE WHEN NOT mature THEN 0.3 WHEN posture THEN 0.0 ELSE 1.0 END AS device_posture_novelty_score,
 CASE WHEN baseline_count = 0 THEN 0.3 WHEN place THEN 0.0 ELSE 1.0 END AS location_novelty_score,
 CASE WHEN baseline_count = 0 THEN 0.25 WHEN resource THEN 0.0 ELSE 1.0 END AS resource_novelty_score,
 CASE WHEN baseline_count = 0 THEN 0.25 WHEN act THEN 0.0 ELSE 1.0 END AS event_action_novelty_score,
 CASE WHEN b.is_privileged_action AND NOT coalesce(privileged, false) THEN 1.0 ELSE 0.0 END AS privilege_expansion_score,
 CASE WHEN baseline_count = 0 THEN 0.25 WHEN port THEN 0.0 ELSE 1.0 END AS protocol_port_novelty_score,
 CASE WHEN b.commands = '' THEN 0.0 WHEN NOT coalesce(any_step, false) THEN 0.3 ELSE share END AS command_transition_novelty_score
 FROM base b LEFT JOIN known USING (event_id) LEFT JOIN prints USING (event_id) LEFT JOIN new_steps USING (event_id))"""


def features_cte(entity_min: int = 12, peer_min: int = 25) -> str:
    """CTEs ending in `features`, one row per event with all 32 values."""
    return ",".join([T, MINUTE_CTE, TRAVEL_CTE, SESSION_CTE, baseline_cte(entity_min, peer_min), PAIRS_CTE, STATS_CTE, NOVELTY_CTE]) + """,
features AS (SELECT minute.*, travel.* EXCLUDE (event_id), sessions.* EXCLUDE (event_id), statistic.* EXCLUDE (event_id), novelty.* EXCLUDE (event_id),
  CAST(t.device_id <> t.claimed_device_id AS DOUBLE) AS claimed_observed_device_mismatch_score
 FROM t JOIN minute USING (event_id) JOIN travel USING (event_id) JOIN sessions USING (event_id)
 JOIN statistic USING (event_id) JOIN novelty USING (event_id))"""

"""Projection of the driver's `events` table onto access telemetry.

One SQL text serves both engines; only the epoch and the JSON expressions differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_US = "unix_micros(timestamp_seconds(0) + (ts - TIMESTAMP_NTZ '1970-01-01 00:00:00'))"
SPARK_K = "CAST(get_json_object(props, '$.k') AS INT)"
DUCK_US = "epoch_us(ts)"
DUCK_K = "CAST(json_extract_string(props, '$.k') AS INT)"

PROJECTION = """
WITH b AS (
  SELECT event_id AS eid, user_id AS uid, @US AS us, event_type AS et, value AS v, @K AS k FROM @SRC
), c AS (
  SELECT *,
    CASE WHEN et IN ('error','signup') THEN 'login' WHEN et = 'click' THEN 'api_call'
         WHEN et = 'view' AND k % 15 = 0 THEN 'admin_action' WHEN et = 'view' THEN 'resource_access'
         ELSE 'file_download' END AS event_type,
    CASE WHEN et = 'error' OR (et = 'click' AND k % 10 = 1) THEN 'failure'
         WHEN et IN ('signup','click') THEN 'success' ELSE 'not_applicable' END AS authentication_result,
    CASE WHEN k = 7 THEN 'dev-shared' ELSE concat('dev-', CAST(uid AS VARCHAR(20)), '-', CAST(eid % 2 AS VARCHAR(20))) END AS device_id,
    CASE WHEN k % 17 = 4 THEN (uid + 1) % 6 ELSE uid % 6 END AS office
  FROM b
)
SELECT
  concat('evt-', CAST(eid AS VARCHAR(20))) AS event_id, eid, us,
  concat('usr-', CAST(uid AS VARCHAR(20))) AS entity_id,
  CASE WHEN uid % 10 < 7 THEN 'user' WHEN uid % 10 < 9 THEN 'service_account' ELSE 'edge_device' END AS entity_type,
  CASE uid % 5 WHEN 0 THEN 'analyst' WHEN 1 THEN 'engineer' WHEN 2 THEN 'manager' WHEN 3 THEN 'administrator' ELSE 'support' END AS user_role,
  CASE uid % 6 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Finance' WHEN 2 THEN 'Sales' WHEN 3 THEN 'HR' WHEN 4 THEN 'Operations' ELSE 'Security' END AS department,
  device_id,
  CASE WHEN k % 25 = 3 THEN concat('dev-', CAST(uid AS VARCHAR(20)), '-0') ELSE device_id END AS claimed_device_id,
  CASE uid % 3 WHEN 0 THEN 'Windows 11' WHEN 1 THEN 'macOS 15' ELSE 'Ubuntu 24.04' END AS operating_system,
  concat(CAST(uid % 4 + 1 AS VARCHAR(20)), '.0.3') AS firmware_version,
  CASE WHEN k % 10 = 0 THEN 'curl' ELSE 'Chrome' END AS browser,
  substr(md5(concat(device_id, CASE WHEN k % 20 = 5 THEN 'x' ELSE '' END)), 1, 24) AS device_fingerprint,
  substr(md5(concat('mac', device_id)), 1, 24) AS device_mac_hash,
  concat('10.0.0.', CAST(k % 8 AS VARCHAR(20))) AS source_ip,
  CASE office WHEN 0 THEN 'India' WHEN 1 THEN 'United States' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN 'Singapore' WHEN 4 THEN 'Germany' ELSE 'Australia' END AS country,
  CASE office WHEN 0 THEN 'Bengaluru' WHEN 1 THEN 'New York' WHEN 2 THEN 'London' WHEN 3 THEN 'Singapore' WHEN 4 THEN 'Berlin' ELSE 'Sydney' END AS city,
  CAST(CASE office WHEN 0 THEN 12.9716 WHEN 1 THEN 40.7128 WHEN 2 THEN 51.5074 WHEN 3 THEN 1.3521 WHEN 4 THEN 52.52 ELSE -33.8688 END AS DOUBLE) AS latitude,
  CAST(CASE office WHEN 0 THEN 77.5946 WHEN 1 THEN -74.006 WHEN 2 THEN -0.1278 WHEN 3 THEN 103.8198 WHEN 4 THEN 13.405 ELSE 151.2093 END AS DOUBLE) AS longitude,
  event_type, authentication_result,
  CASE event_type WHEN 'login' THEN 'authenticate' WHEN 'api_call' THEN 'invoke' WHEN 'admin_action' THEN 'execute' ELSE 'read' END AS action,
  CASE WHEN authentication_result = 'failure' THEN 'denied' ELSE 'allowed' END AS access_outcome,
  CASE WHEN authentication_result = 'not_applicable' THEN 'not_applicable' WHEN event_type = 'api_call' THEN 'token'
       WHEN k % 13 = 0 THEN 'biometric' ELSE 'password' END AS auth_method,
  CASE WHEN event_type = 'api_call' THEN concat('/api/v1/r', CAST(k % 6 AS VARCHAR(20))) END AS api_route,
  CASE WHEN event_type = 'api_call' THEN CASE WHEN k % 5 = 0 THEN 'POST' ELSE 'GET' END END AS http_method,
  CASE WHEN event_type = 'api_call' THEN CASE WHEN k % 10 = 1 THEN 401 WHEN k % 11 = 0 THEN 500 ELSE 200 END END AS http_status_code,
  concat('res-', CAST(k % 12 AS VARCHAR(20))) AS resource_id,
  CAST(k % 12 AS DOUBLE) / 12 AS resource_sensitivity,
  concat('host-', CAST(k % 9 AS VARCHAR(20))) AS destination_host,
  (event_type = 'file_download' AND k % 4 = 0) AS is_external_destination,
  CASE k % 3 WHEN 0 THEN 'https' WHEN 1 THEN 'ssh' ELSE 'smb' END AS network_protocol,
  CASE k % 3 WHEN 0 THEN 443 WHEN 1 THEN 22 ELSE 445 END AS destination_port,
  CASE event_type WHEN 'admin_action' THEN concat('whoami>cmd', CAST(k % 4 AS VARCHAR(20)))
       WHEN 'api_call' THEN concat('GET_', CAST(k % 3 AS VARCHAR(20))) ELSE '' END AS commands,
  CAST(floor(v * 1000) AS BIGINT) AS bytes_uploaded,
  CAST(floor(v * v * 100) AS BIGINT) AS bytes_downloaded,
  concat('ses-', CAST(uid AS VARCHAR(20)), '-', CAST(CAST(floor(us / 86400000000.0) AS BIGINT) AS VARCHAR(20))) AS session_id,
  CAST((k * 997) % 86400 AS INT) AS session_duration_seconds,
  (k % 9 = 2) AS is_vpn,
  (event_type = 'admin_action' AND k % 2 = 0) AS is_privileged_action,
  CASE WHEN eid % 97 >= 3 THEN 'normal' ELSE CASE CAST(floor(eid / 97.0) AS BIGINT) % 6 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'credential_stuffing'
       WHEN 2 THEN 'lateral_movement' WHEN 3 THEN 'impossible_travel' WHEN 4 THEN 'device_spoofing' ELSE 'low_slow_exfiltration' END END AS label,
  CASE WHEN eid % 97 < 3 THEN concat('scn-', CAST(CAST(floor(eid / 97.0) AS BIGINT) AS VARCHAR(20)))
       WHEN uid % 12 = 0 THEN concat('insider_drift-', CAST(uid AS VARCHAR(20))) ELSE concat('normal-', CAST(uid AS VARCHAR(20))) END AS scenario_id,
  CASE WHEN uid % 20 < 14 THEN 'train' WHEN uid % 20 < 17 THEN 'validation' ELSE 'test' END AS split,
  least(1.0, v / 150.0) AS anomaly_score, CAST(k AS DOUBLE) / 99 AS sequence_anomaly_score,
  CAST((k * 37 + eid) % 101 AS DOUBLE) / 100 AS p_malicious, CAST((k * 53) % 100 AS DOUBLE) / 100 AS deviation
FROM c
"""

DUCK_TELEMETRY = PROJECTION.replace("@US", DUCK_US).replace("@K", DUCK_K).replace("@SRC", "events")
# The generator names the parsed value: pushed-down filters would otherwise repeat the JSON parse per use.
SPARK_SOURCE = f"{{source}} LATERAL VIEW explode(array({SPARK_K})) AS k"
SPARK_TELEMETRY = PROJECTION.replace("@US", SPARK_US).replace("@K", "k").replace("@SRC", SPARK_SOURCE)


ROWS_A_TASK = 100_000  # an event may become dozens of profile rows, which one task sorts


def spread(source: DataFrame, key: str) -> DataFrame:
    """Deal an input of too few splits over all cores, and over so many tasks that none holds much more than `ROWS_A_TASK` rows."""
    tasks = max(source.sparkSession.sparkContext.defaultParallelism, -(-source.count() // ROWS_A_TASK))
    return source.repartition(tasks, key) if source.rdd.getNumPartitions() < tasks else source


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access telemetry over the driver's events; columns the caller never uses are not read."""
    source = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    df = spark.sql(SPARK_TELEMETRY, source=source)
    return df.selectExpr("*", "filter(split(commands, '>'), x -> x <> '') AS command_sequence")

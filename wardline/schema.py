"""Event contract, feature registry and the lookup values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", S), T.StructField("timestamp", T.TimestampType()),
    T.StructField("entity_id", S), T.StructField("entity_type", S), T.StructField("user_id", S),
    T.StructField("user_role", S), T.StructField("department", S), T.StructField("device_id", S),
    T.StructField("claimed_device_id", S), T.StructField("operating_system", S),
    T.StructField("firmware_version", S), T.StructField("browser", S), T.StructField("user_agent", S),
    T.StructField("device_fingerprint", S), T.StructField("device_mac_hash", S),
    T.StructField("source_ip", S), T.StructField("country", S), T.StructField("city", S),
    T.StructField("latitude", D), T.StructField("longitude", D), T.StructField("event_type", S),
    T.StructField("action", S), T.StructField("access_outcome", S),
    T.StructField("authentication_result", S), T.StructField("auth_method", S),
    T.StructField("mfa_result", S), T.StructField("api_route", S), T.StructField("http_method", S),
    T.StructField("http_status_code", I), T.StructField("api_latency_ms", D),
    T.StructField("credential_id_hash", S), T.StructField("token_scopes", T.ArrayType(S)),
    T.StructField("resource_id", S), T.StructField("resource_type", S),
    T.StructField("resource_sensitivity", D), T.StructField("destination_host", S),
    T.StructField("source_network_zone", S), T.StructField("destination_network_zone", S),
    T.StructField("is_external_destination", B), T.StructField("network_protocol", S),
    T.StructField("destination_port", I), T.StructField("command_sequence", T.ArrayType(S)),
    T.StructField("bytes_uploaded", L), T.StructField("bytes_downloaded", L),
    T.StructField("session_id", S), T.StructField("session_duration_seconds", I),
    T.StructField("parent_auth_event_id", S), T.StructField("device_connection_action", S),
    T.StructField("device_class", S), T.StructField("is_vpn", B), T.StructField("is_privileged_action", B),
])
EVENT_FIELDS = EVENT_SCHEMA.names

LABEL_SCHEMA = T.StructType([
    T.StructField("event_id", S), T.StructField("label", S),
    T.StructField("scenario_id", S), T.StructField("sequence_id", S),
])

# ---- Fixed values: field bounds of the event contract (min, max length; * = may be null) ----
LENGTHS = {
    "event_id": (1, 100), "entity_id": (1, 100), "user_id": (1, 100), "user_role": (1, 80),
    "department": (1, 80), "device_id": (1, 100), "claimed_device_id": (1, 100),
    "operating_system": (1, 100), "firmware_version": (1, 100), "browser": (1, 100),
    "user_agent": (1, 500), "device_fingerprint": (4, 256), "device_mac_hash": (4, 128),
    "source_ip": (3, 64), "country": (2, 80), "city": (1, 100), "resource_id": (1, 120),
    "resource_type": (1, 80), "destination_host": (1, 180), "session_id": (1, 100),
}
OPTIONAL_LENGTHS = {"api_route": (1, 200), "credential_id_hash": (4, 128), "parent_auth_event_id": (1, 100)}
RANGES = {
    "latitude": (-90, 90), "longitude": (-180, 180), "resource_sensitivity": (0, 1),
    "destination_port": (1, 65535), "bytes_uploaded": (0, 10_000_000_000),
    "bytes_downloaded": (0, 10_000_000_000), "session_duration_seconds": (0, 604_800),
}
OPTIONAL_RANGES = {"http_status_code": (100, 599), "api_latency_ms": (0, 600_000)}
ARRAY_LIMITS = {"token_scopes": 20, "command_sequence": 50}
ENUMS = {
    "entity_type": ("user", "service_account", "edge_device"),
    "event_type": ("login", "resource_access", "file_download", "admin_action", "api_call", "device_connection"),
    "action": ("authenticate", "read", "write", "delete", "execute", "list", "connect", "disconnect",
               "invoke", "not_applicable"),
    "access_outcome": ("allowed", "denied", "error", "not_applicable"),
    "authentication_result": ("success", "failure", "not_applicable"),
    "auth_method": ("password", "token", "certificate", "biometric", "not_applicable"),
    "mfa_result": ("success", "failure", "not_used", "not_applicable"),
    "source_network_zone": ("corporate", "vpn", "internet", "partner", "ot", "unknown"),
    "destination_network_zone": ("internal", "restricted", "external", "ot", "cloud", "unknown"),
    "network_protocol": ("https", "ssh", "rdp", "smb", "mqtt", "opcua", "database", "internal"),
    "device_connection_action": ("connect", "disconnect", "heartbeat", "not_applicable"),
    "device_class": ("workstation", "server", "mobile", "edge_gateway", "iot", "pos", "unknown"),
}
OPTIONAL_ENUMS = {"http_method": ("GET", "POST", "PUT", "PATCH", "DELETE")}
REQUIRED_BOOLEANS = ("is_vpn", "is_privileged_action")
# Values a producer may leave out.
DEFAULTS = {
    "action": "not_applicable", "access_outcome": "not_applicable", "mfa_result": "not_applicable",
    "source_network_zone": "unknown", "destination_network_zone": "unknown",
    "device_connection_action": "not_applicable", "device_class": "unknown",
    "is_external_destination": False,
}
FUTURE_TOLERANCE_US = 300_000_000

# ---- Fixed values: labels, feature names and their order (schema 3.0.0) ----
FEATURE_SCHEMA_VERSION = "3.0.0"
ATTACKS = ("brute_force", "credential_stuffing", "lateral_movement",
           "impossible_travel", "device_spoofing", "low_slow_exfiltration")
CLASSES = tuple(sorted(("normal", *ATTACKS)))
FEATURES = (
    "failed_auth_count_1m", "auth_attempt_count_5m", "successful_auth_after_failures_score",
    "source_ip_unique_entities_5m", "source_ip_failure_ratio_5m", "auth_method_novelty_score",
    "api_call_rate_1m_zscore", "api_error_ratio_5m", "api_endpoint_method_novelty_score",
    "source_ip_novelty_score", "new_device_score", "device_fingerprint_distance",
    "claimed_observed_device_mismatch_score", "device_posture_novelty_score", "location_novelty_score",
    "vpn_aware_travel_anomaly_score", "access_hour_deviation_score", "unique_destination_hosts_5m",
    "resource_novelty_score", "event_action_novelty_score", "resource_access_entropy_24h",
    "resource_sensitivity_deviation_score", "privilege_expansion_score", "protocol_port_novelty_score",
    "command_transition_novelty_score", "download_volume_zscore", "upload_volume_zscore",
    "cumulative_external_transfer_24h_zscore", "session_duration_zscore", "inter_event_time_zscore",
    "active_concurrent_session_count", "sensitive_access_rate_30d_zscore",
)
DOMAINS = {"authentication_api": (0, 9), "identity_device_geo": (9, 17),
           "resource_network": (17, 25), "volume_timing": (25, 32)}
TEMPORAL_FEATURES = (
    "failed_auth_count_1m", "auth_attempt_count_5m", "successful_auth_after_failures_score",
    "source_ip_unique_entities_5m", "source_ip_failure_ratio_5m", "api_call_rate_1m_zscore",
    "api_error_ratio_5m", "vpn_aware_travel_anomaly_score", "unique_destination_hosts_5m",
    "event_action_novelty_score", "resource_access_entropy_24h", "command_transition_novelty_score",
    "cumulative_external_transfer_24h_zscore", "inter_event_time_zscore",
    "active_concurrent_session_count", "sensitive_access_rate_30d_zscore",
)
TEMPORAL_INDICES = tuple(FEATURES.index(name) for name in TEMPORAL_FEATURES)
ENRICHED = (*FEATURES, *(f"if_{name}_score" for name in DOMAINS), *(f"rf_{name}_probability" for name in ATTACKS))
# Features whose resting value is one rather than zero.
UNIT_BASELINE_FEATURES = ("unique_destination_hosts_5m", "source_ip_unique_entities_5m",
                          "active_concurrent_session_count")

# ---- Fixed values: profile list limits ----
VALUE_LIMITS = {
    "source_ip": 100, "device": 50, "fingerprint": 50, "location": 50, "posture": 80, "event_action": 100,
    "resource": 150, "protocol_port": 50, "privileged": 100, "auth_method": 10, "command": 200,
    "transition": 300, "endpoint": 150, "credential": 50, "scope": 100,
}
NUMERIC_LIMIT = 500
LOG_LIMIT = 1000
ENTITY_MINIMUM, PEER_MINIMUM = 12, 25
MATURE_KINDS = ("entity", "device")

# ---- Fixed values: monitored drift signals (domain, smallest meaningful shift) and advice ----
SIGNALS = {
    "access_hour": ("identity", 1.5), "location_novelty_score": ("identity", .15),
    "new_device_score": ("device", .15), "download_volume_zscore": ("access", .75),
    "resource_novelty_score": ("access", .15), "privilege_expansion_score": ("access", .15),
    "sequence_anomaly_score": ("sequence", .12), "anomaly_score": ("model", .12),
}
RECOMMENDATIONS = {
    "access_hour": "Validate the entity's new shift or working-hours assignment",
    "location_novelty_score": "Confirm travel, office reassignment, or approved remote-work location",
    "new_device_score": "Verify device enrollment and fingerprint ownership",
    "download_volume_zscore": "Review data-transfer purpose and expected workload change",
    "resource_novelty_score": "Validate role changes and newly authorized resources",
    "privilege_expansion_score": "Check approved privilege and responsibility changes",
    "sequence_anomaly_score": "Review the changed action sequence before adapting the sequence baseline",
    "anomaly_score": "Inspect the combined behavioral change before adapting the point baseline",
}
# ---- Fixed values: recommended actions ----
CLASS_ACTIONS = {
    "brute_force": "Rate-limit authentication and inspect the source session",
    "credential_stuffing": "Block the source campaign and identify all targeted entities",
    "lateral_movement": "Isolate the device and inspect destination hosts and commands",
    "impossible_travel": "Verify travel/VPN context and compare overlapping sessions",
    "device_spoofing": "Challenge device trust and re-enrol the endpoint",
    "low_slow_exfiltration": "Review cumulative sensitive transfers and destination ownership",
    "normal": "Monitor for corroborating activity",
}
COMMON_ACTIONS = ("Review the complete entity sequence",
                  "Validate the activity with the system or account owner")
ESCALATION = "Escalate immediately to incident response"
# ---- Fixed values: risk weights ----
RISK_WEIGHTS = {"anomaly": .30, "sequence": .05, "classifier": .25, "deviation": .35, "criticality": .05}

"""Hand-built events."""

from pyspark.sql import functions as F

from wardline.schema import DEFAULTS, EVENT_SCHEMA

START = 1_768_212_000_000_000  # 2026-01-12 10:00 UTC
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000

BASE = dict(
    # who: a clerk at a customs office
    entity_id="clerk-07", entity_type="user", user_id="clerk-07", user_role="declarant", department="Customs",
    # with what: a desk terminal with its own prints of twelve signs
    device_id="desk-31", claimed_device_id="desk-31", device_fingerprint="97c3e0d18b42", device_mac_hash="5f20ab7719cc",
    operating_system="Fedora", firmware_version="8.4.2", browser="Konqueror", user_agent="Konqueror/24.2", is_vpn=False,
    # from where: the port of Gdynia
    source_ip="172.20.4.9", country="Poland", city="Gdynia", latitude=54.5189, longitude=18.5305,
    # what for: a session at the tariff register
    session_id="visit-1", session_duration_seconds=930, event_type="login", auth_method="password", authentication_result="success",
    resource_id="tariffs", resource_type="app", resource_sensitivity=.3, destination_host="tariffs.example", destination_port=443, network_protocol="https",
    bytes_downloaded=4200, bytes_uploaded=310, command_sequence=[], token_scopes=[], is_privileged_action=False, **DEFAULTS)


def frame(spark, rows):
    """Rows of overrides to a DataFrame with `us`, `trusted`, `label` and the contract columns."""
    names = [f.name for f in EVENT_SCHEMA if f.name != "timestamp"]
    types = {f.name: f.dataType.simpleString() for f in EVENT_SCHEMA}
    full = []
    for i, row in enumerate(rows):
        merged = {**dict.fromkeys(names), **BASE, "event_id": f"e{i:04d}", "us": START + i * MINUTE, "trusted": True, "label": "normal",
                  "scenario_id": "s", "split": "train", **row}
        full.append(tuple(merged[n] for n in (*names, "us", "trusted", "label", "scenario_id", "split")))
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", us bigint, trusted boolean, label string, scenario_id string, split string"
    return spark.createDataFrame(full, schema).withColumn("timestamp", F.timestamp_micros("us"))


def by_id(df, *columns):
    return {r["event_id"]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}

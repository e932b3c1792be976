"""Features that depend on recent telemetry only, not on profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalar import (DAY, MINUTE, clip, great_circle_km, required_speed)
from wardline.operators.timeline import covering_totals, previous_within, running_before


@dataclass(frozen=True)
class Spans:
    """Look-back widths in microseconds; the defaults are the contract's."""

    short: int = MINUTE
    medium: int = 5 * MINUTE
    day: int = DAY
    month: int = 30 * DAY


AUTH_MEASURES = ("fail_s", "fail_m", "auth_m")
ENTITY_MEASURES = ("api_s", "api_m", "bad_m")


def _flags(events: DataFrame) -> DataFrame:
    api = F.col("event_type") == "api_call"
    bad = (F.coalesce(F.col("http_status_code"), F.lit(0)) >= 400) | F.col("access_outcome").isin("denied", "error")
    return events.select(
        "event_id", "us", "entity_id", "source_ip", "destination_host",
        (F.col("authentication_result") == "failure").cast("long").alias("fail"),
        (F.col("authentication_result") == "success").alias("success"),
        (F.col("authentication_result") != "not_applicable").cast("long").alias("auth"),
        api.cast("long").alias("api"), (api & F.coalesce(bad, F.lit(False))).cast("long").alias("bad"))


def _span(kind, key: Column, start, stop, **measures) -> Column:
    names = (*AUTH_MEASURES, *ENTITY_MEASURES, "entities_m", "hosts_m")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), key.alias("key"), start.alias("start"), stop.alias("stop"),
                    *[measures.get(n, F.lit(0)).cast("long").alias(n) for n in names])


def minute_features(events: DataFrame, spans: Spans = Spans()) -> DataFrame:
    """F01-F05, F07, F08 and F18 in three narrow shuffles.

    The entity-or-address rule is solved by inclusion and exclusion over three equality keys.
    Distinct counts over a moving window are plain counts minus the stretch in which a value and its
    previous sighting are both still inside the window.
    """
    base = _flags(events)
    us = F.col("us")
    short, medium = us + spans.short, us + spans.medium
    entity, address = F.struct(F.col("entity_id").alias("a"), F.lit(None).cast("string").alias("b")), \
        F.struct(F.col("source_ip").alias("a"), F.lit(None).cast("string").alias("b"))
    both = F.struct(F.col("entity_id").alias("a"), F.col("source_ip").alias("b"))

    fail, auth, api, bad, one = F.col("fail"), F.col("auth"), F.col("api"), F.col("bad"), F.lit(1)
    counted = base.select(F.explode(F.filter(F.array(
        _span("entity", entity, us, short, fail_s=fail, api_s=api),
        _span("entity", entity, us, medium, fail_m=fail, auth_m=auth, api_m=api, bad_m=bad, hosts_m=one),
        _span("address", address, us, short, fail_s=fail),
        _span("address", address, us, medium, fail_m=fail, auth_m=auth, entities_m=one),
        _span("both", both, us, short, fail_s=fail),
        _span("both", both, us, medium, fail_m=fail, auth_m=auth)),
        lambda s: (s["fail_s"] + s["fail_m"] + s["auth_m"] + s["api_s"] + s["api_m"] + s["bad_m"]
                   + s["entities_m"] + s["hosts_m"]) > 0)).alias("s")).select("s.*")

    # Previous sighting of the entity on this address, and of the host by this entity.
    seen = previous_within(
        base.select("event_id", "us", F.explode(F.array(
            F.struct(F.lit("address").alias("kind"), F.col("source_ip").alias("owner"), F.col("entity_id").alias("value")),
            F.struct(F.lit("entity").alias("kind"), F.col("entity_id").alias("owner"),
                     F.col("destination_host").alias("value")))).alias("s")).select("event_id", "us", "s.*"),
        ["kind", "owner", "value"], spans.medium)
    owner = F.struct(F.col("owner").alias("a"), F.lit(None).cast("string").alias("b"))
    on_address = (F.col("kind") == "address").cast("long")
    overlap = seen.where(F.col("prev_us") + spans.medium > us).select(_span(
        F.col("kind"), owner, us, F.col("prev_us") + spans.medium,
        entities_m=-on_address, hosts_m=on_address - 1).alias("s")).select("s.*")

    probes = base.select("event_id", "us", F.explode(F.array(
        F.struct(F.lit("entity").alias("kind"), entity.alias("key")),
        F.struct(F.lit("address").alias("kind"), address.alias("key")),
        F.struct(F.lit("both").alias("kind"), both.alias("key")))).alias("p")).select("event_id", "us", "p.*")
    measures = [*AUTH_MEASURES, *ENTITY_MEASURES, "entities_m", "hosts_m"]
    totals = covering_totals(probes, counted.unionByName(overlap), ["kind", "key"], measures,
                             width=4 * spans.medium)

    sign = F.when(F.col("kind") == "both", F.lit(-1)).otherwise(F.lit(1))
    by_address = F.when(F.col("kind") == "address", F.lit(1)).otherwise(F.lit(0))
    repeat = seen.where(F.col("earlier_us") >= us - spans.medium)
    flat = (totals.select(
        "event_id", *[(F.col("in_" + m) * sign).alias(m) for m in AUTH_MEASURES],
        *[(F.col("in_" + m) * by_address).alias("ip_" + m) for m in ("fail_m", "auth_m")],
        *[F.col("in_" + m).alias(m) for m in (*ENTITY_MEASURES, "entities_m", "hosts_m")])
        .unionByName(repeat.select("event_id", (-on_address).alias("entities_m"),
                                   (on_address - 1).alias("hosts_m")), allowMissingColumns=True))
    names = [*AUTH_MEASURES, "ip_fail_m", "ip_auth_m", *ENTITY_MEASURES, "entities_m", "hosts_m"]
    sums = flat.groupBy("event_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    joined = base.select("event_id", "fail", "auth", "success", "api", "bad").join(sums, "event_id")
    c = F.col
    auth_on_ip, api_calls = c("ip_auth_m") + c("auth"), c("api_m") + c("api")
    return joined.select(
        "event_id",
        (c("fail_s") + c("fail")).cast("double").alias("failed_auth_count_1m"),
        (c("auth_m") + c("auth")).cast("double").alias("auth_attempt_count_5m"),
        F.when(c("success"), F.least(F.lit(1.0), c("fail_m") / 5.0)).otherwise(0.0)
        .alias("successful_auth_after_failures_score"),
        (c("entities_m") + 1).cast("double").alias("source_ip_unique_entities_5m"),
        ((c("ip_fail_m") + c("fail")) / F.greatest(auth_on_ip, F.lit(1))).alias("source_ip_failure_ratio_5m"),
        F.when(c("api") == 1, clip(c("api_s"), 0, 20)).otherwise(0.0).alias("api_call_rate_1m_zscore"),
        ((c("bad_m") + c("bad")) / F.greatest(api_calls, F.lit(1))).alias("api_error_ratio_5m"),
        (c("hosts_m") + 1).cast("double").alias("unique_destination_hosts_5m"))


def preceding_evidence(events: DataFrame) -> DataFrame:
    """The last strictly earlier success and the last strictly earlier event of each entity."""
    success = F.when(F.col("authentication_result") == "success", F.struct(
        (-F.col("us")).alias("back"), "event_id", "latitude", "longitude", "is_vpn"))
    rows = events.select("event_id", "us", "entity_id", "latitude", "longitude", "is_vpn",
                         success.alias("success"), F.col("us").alias("last_us"))
    return running_before(rows, ["entity_id"], ["us"], {"success": "min", "last_us": "max"}, strict=True)


def travel_features(events: DataFrame) -> DataFrame:
    """F16 and the input of F30 (`seconds_since_last`)."""
    seen = preceding_evidence(events)
    before = F.col("prior_success")
    hours = (F.col("us") + before["back"]) / F.lit(3.6e9)
    distance = great_circle_km(before["latitude"], before["longitude"], F.col("latitude"), F.col("longitude"))
    trust = F.when(F.col("is_vpn") | before["is_vpn"], F.lit(.35)).otherwise(F.lit(1.0))
    travel = clip((required_speed(distance, hours) - 250) / F.lit(750.0), 0, 1) * trust
    return seen.select(
        "event_id",
        F.when(before.isNull(), F.lit(0.0)).otherwise(travel).alias("vpn_aware_travel_anomaly_score"),
        ((F.col("us") - F.col("prior_last_us")) / F.lit(1e6)).alias("seconds_since_last"))


def session_features(events: DataFrame, slot_width: int = DAY) -> DataFrame:
    """sessions of the entity still open at the event, plus its own.

    Each event adds only the stretch its session did not cover yet, so the stretches of a session
    never overlap and counting sessions is counting stretches.
    """
    rows = events.select("event_id", "us", "entity_id", "session_id",
                         (F.col("us") + F.col("session_duration_seconds").cast("long") * 1_000_000).alias("ends"))
    known = running_before(rows, ["entity_id", "session_id"], ["us", "event_id"], {"ends": "max"})
    start = F.greatest(F.col("us"), F.coalesce(F.col("prior_ends") - 1, F.col("us")))
    whole, own = F.struct(F.col("entity_id").alias("a"), F.lit(None).cast("string").alias("b")), \
        F.struct(F.col("entity_id").alias("a"), F.col("session_id").alias("b"))
    keyed = F.explode(F.array(whole, own)).alias("key")
    spans = known.select(keyed, start.alias("start"), (F.col("ends") - 1).alias("stop"),
                         F.lit(1).cast("long").alias("open"))
    totals = covering_totals(rows.select("event_id", "us", keyed), spans, ["key"], ["open"], slot_width)
    sign = F.when(F.col("key.b").isNull(), F.col("in_open")).otherwise(-F.col("in_open"))
    return totals.groupBy("event_id").agg(
        (F.sum(sign) + 1).cast("double").alias("active_concurrent_session_count"))


def event_columns(events: DataFrame) -> DataFrame:
    """F13, the only feature of the event alone."""
    return events.select("event_id", (F.col("device_id") != F.col("claimed_device_id")).cast("double")
                         .alias("claimed_observed_device_mismatch_score"))

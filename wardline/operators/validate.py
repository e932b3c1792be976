"""Admission rules: each rule is a column, a record carries the list of rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import schema as C

ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def _broken(name: str, condition: Column) -> Column:
    return F.when(condition, F.lit(name))


def domain_rules(columns) -> list[Column]:
    """Length, range and membership rules for the contract fields present in `columns`."""
    columns, rules = set(columns), []
    for name, (low, high) in {**C.LENGTHS, **C.OPTIONAL_LENGTHS}.items():
        if name in columns:
            size = F.length(name)
            wrong = (size < low) | (size > high)
            rules.append(_broken(name, wrong if name in C.OPTIONAL_LENGTHS else wrong | F.col(name).isNull()))
    for name, (low, high) in {**C.RANGES, **C.OPTIONAL_RANGES}.items():
        if name in columns:
            wrong = (F.col(name) < low) | (F.col(name) > high) | F.isnan(F.col(name).cast("double"))
            rules.append(_broken(name, wrong if name in C.OPTIONAL_RANGES else wrong | F.col(name).isNull()))
    for name, members in {**C.ENUMS, **C.OPTIONAL_ENUMS}.items():
        if name in columns:
            wrong = ~F.col(name).isin(*members)
            rules.append(_broken(name, wrong if name in C.OPTIONAL_ENUMS else wrong | F.col(name).isNull()))
    for name, limit in C.ARRAY_LIMITS.items():
        if name in columns:
            rules.append(_broken(name, F.size(name) > limit))
    for name in C.REQUIRED_BOOLEANS:
        if name in columns:
            rules.append(_broken(name, F.col(name).isNull()))
    return rules


def conditional_rules(columns) -> list[Column]:
    """Fields an event type requires."""
    rules = []
    missing = [n for n in ("api_route", "http_method", "http_status_code") if n in columns]
    if missing:
        absent = F.lit(False)
        for name in missing:
            absent = absent | F.col(name).isNull()
        rules.append(_broken("api_call_fields", (F.col("event_type") == "api_call") & absent))
    if "device_connection_action" in columns:
        rules.append(_broken("device_connection_action_required", (F.col("event_type") == "device_connection")
                             & (F.col("device_connection_action") == "not_applicable")))
    return rules


def timestamp_rules(raw: str, now_us: int) -> list[Column]:
    """A zone is mandatory and at most five minutes of future are accepted. `now_us` is passed in."""
    zoned = F.col(raw).rlike(ZONE)
    parsed = F.try_to_timestamp(F.col(raw))
    late = F.unix_micros(parsed) - F.lit(now_us) > C.FUTURE_TOLERANCE_US
    return [_broken("timestamp_zone", F.col(raw).isNotNull() & ~zoned),
            _broken("timestamp_unreadable", F.col(raw).isNull() | (zoned & parsed.isNull())),
            _broken("timestamp_future", zoned & late)]


def unknown_keys(raw: str, known=tuple(C.EVENT_FIELDS)) -> Column:
    """JSON keys outside the closed schema."""
    return F.array_except(F.json_object_keys(F.col(raw)), F.array(*[F.lit(k) for k in known]).cast("array<string>"))


def with_violations(df: DataFrame, rules: list[Column], name: str = "violations") -> DataFrame:
    return df.withColumn(name, F.filter(F.array(*rules), lambda v: v.isNotNull()))


def check_events(df: DataFrame) -> DataFrame:
    return with_violations(df, domain_rules(df.columns) + conditional_rules(df.columns))


def split_valid(checked: DataFrame, name: str = "violations") -> tuple[DataFrame, DataFrame]:
    ok = F.size(name) == 0
    return checked.where(ok).drop(name), checked.where(~ok)


def fill_defaults(df: DataFrame) -> DataFrame:
    filled = df
    for name, value in C.DEFAULTS.items():
        if name in df.columns:
            filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    for name in C.ARRAY_LIMITS:
        if name in df.columns:
            filled = filled.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
    return filled


def first_by_id(df: DataFrame, order=("us",), key: str = "event_id") -> DataFrame:
    """Keep the first record of each id. The rank filter is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unseen(df: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """Drop records whose id is already stored."""
    return df.join(stored.select(key).distinct(), key, "left_anti")

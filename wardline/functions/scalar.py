"""Column functions of the scalar operators. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
EARTH_KM = 6371.0088
SPEED_LIMIT = 20_000.0


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value) -> Column:
    return col(value).cast("double")


def clip(value, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(value)))


def finite(value) -> Column:
    """Non-finite or missing measurements fall back to the registry default of zero."""
    value = number(value)
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))


def floor_div(us, width: int) -> Column:
    us = col(us).cast("long")
    return F.floor((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def utc_day(us) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(us, DAY).cast("int"))


def bucket_15m(us) -> Column:
    return floor_div(us, 15 * MINUTE)


def minute_of_day(us) -> Column:
    return floor_div(F.pmod(col(us), F.lit(DAY)), MINUTE)


def hour_of_day(us) -> Column:
    """Hour with minutes as a fraction; seconds do not count."""
    minutes = minute_of_day(us)
    return F.floor(minutes / 60).cast("double") + (minutes % 60).cast("double") / F.lit(60.0)


def circular_hours(left, right) -> Column:
    gap = F.abs(number(left) - number(right)) % F.lit(24.0)
    return F.least(gap, F.lit(24.0) - gap)


def criticality(sensitivity, privileged) -> Column:
    return clip(F.lit(.75) * number(sensitivity) + F.lit(.25) * col(privileged).cast("double"), 0, 1)


def sensitive_flag(sensitivity, privileged) -> Column:
    return ((number(sensitivity) >= .7) | col(privileged)).cast("int")


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(number(x)) for x in (lat1, lon1, lat2, lon2))
    half = (F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0))
            + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0)))
    return F.lit(EARTH_KM * 2) * F.asin(F.sqrt(clip(half, 0, 1)))


def required_speed(distance, hours) -> Column:
    hours = number(hours)
    return (F.when(hours <= 0, F.lit(SPEED_LIMIT))
            .otherwise(F.least(F.lit(SPEED_LIMIT), number(distance) / F.when(hours > 0, hours))))


def guarded_z(value, count, mean, std, floor: float = 1.0, limit: float = 20.0) -> Column:
    z = (number(value) - number(mean)) / F.greatest(number(std), F.lit(floor))
    return F.when(F.coalesce(col(count), F.lit(0)) < 2, F.lit(0.0)).otherwise(clip(z, -limit, limit))


def padded_distance(left, right) -> Column:
    """Share of differing positions after padding both strings to one width."""
    left, right = col(left), col(right)
    width = F.greatest(F.length(left), F.length(right), F.lit(1))
    a, b = F.rpad(left, width, F.lit(" ")), F.rpad(right, width, F.lit(" "))
    differing = F.filter(F.sequence(F.lit(1), width),
                         lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.size(differing).cast("double") / width


def nearest_print(value, known, empty: float = .35) -> Column:
    """Smallest padded distance to an array of known prints."""
    distances = F.transform(col(known), lambda other: padded_distance(value, other))
    return F.when(F.size(col(known)) <= 0, F.lit(empty)).otherwise(F.array_min(distances))


def words(value) -> Column:
    return F.initcap(F.replace(col(value), F.lit("_"), F.lit(" ")))


def display_class(predicted, confidence) -> Column:
    doubtful = (number(confidence) < .6) & (col(predicted) != "normal")
    return F.concat(F.when(doubtful, F.lit("Possible ")).otherwise(F.lit("")), words(predicted))


def display_name(entity) -> Column:
    return F.initcap(F.replace(col(entity), F.lit("-"), F.lit(" ")))


def partition_number(entity, partitions: int) -> Column:
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return F.pmod(F.xxhash64(col(entity)), F.lit(partitions)).cast("int")


def log1p_share(total, scale: float = 10_000_000.0) -> Column:
    return clip(F.log1p(number(total)) / F.lit(math.log1p(scale)), 0, 1)


def python_round(value, digits: int) -> Column:
    """Round the exact binary value, exact ties to even, as the contract's published numbers do.

    The value is split in two halves so that its product with twice the scale has no rounding error
    and the side of the tie is known exactly.
    """
    scale = float(10 ** digits)

    def settle(v: Column) -> Column:
        wide = v * F.lit(134217729.0)
        high = wide - (wide - v)
        down = F.floor(v * scale).cast("double")
        side = (high * F.lit(2 * scale) - (2 * down + 1)) + (v - high) * F.lit(2 * scale)
        up = (side > 0) | ((side == 0) & (F.pmod(down, F.lit(2.0)) == 1))
        return (down + up.cast("double")) / F.lit(scale)

    # The one-element array names the value, so a long input expression is evaluated once.
    return F.element_at(F.transform(F.array(number(value)), settle), 1)

"""Registry of the driver queries and the shared inputs they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import risk as R
from wardline.functions.scalar import criticality
from wardline.operators.profiles import trusted_by_label
from wardline.plans.oracle import T
from wardline.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def over_t(sql: str) -> str:
    return f"WITH {T} {sql}"


def r6(value) -> Column:
    """Six decimals, without negative zero. The nudge settles exact ties the same way in both engines."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(1e-9), 6) + F.lit(0.0)


def d6(sql: str) -> str:
    return f"(round(CAST(({sql}) AS DOUBLE) + 1e-9, 6) + 0.0)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and integers to one width, so both engines print one value."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(r6(name).alias(name))
        elif kind in ("int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trusted_by_label(telemetry(spark, sf_dir))


K = "CAST(round(sequence_anomaly_score * 99) AS INT)"
PREDICTED = f"""CASE WHEN p_malicious >= 0.7 THEN CASE {K} % 6 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'credential_stuffing'
 WHEN 2 THEN 'lateral_movement' WHEN 3 THEN 'impossible_travel' WHEN 4 THEN 'device_spoofing' ELSE 'low_slow_exfiltration' END
 WHEN eid % 5 = 0 THEN label ELSE 'normal' END"""
CONFIDENT = "CASE WHEN p_malicious >= 0.5 THEN p_malicious ELSE 1.0 - p_malicious END"
ALERT, PRIORITY, BEHAVIOUR = 50.0, 60.0, 0.6

SCORED = f"""{T}, scored_rows AS (SELECT *, least(1.0, greatest(0.0, 0.75 * resource_sensitivity + 0.25 * is_privileged_action::INT)) AS criticality,
  {PREDICTED} AS predicted_attack, CAST({CONFIDENT} AS DOUBLE) AS classifier_confidence FROM t),
scored AS MATERIALIZED (SELECT *, 100.0 * (0.30 * anomaly_score + 0.05 * sequence_anomaly_score + 0.25 * p_malicious + 0.35 * deviation + 0.05 * criticality) AS risk_score,
  least(1.0, greatest(0.0, (0.30 * anomaly_score + 0.05 * sequence_anomaly_score + 0.35 * deviation) / 0.7)) AS behaviour FROM scored_rows)"""
SEVERITY_SQL = f"CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 50 THEN 'medium' WHEN risk_score < {PRIORITY} THEN 'high' ELSE 'critical' END"


def over_scored(sql: str) -> str:
    return f"WITH {SCORED} {sql}"


PARTS = ("anomaly_score", "sequence_anomaly_score", "p_malicious", "deviation", "criticality")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with stand-in component scores and everything derived from them."""
    rows = events(spark, sf_dir).withColumn("anomaly_score", F.col("anomaly_score").cast("double"))
    rows = rows.withColumns({"criticality": criticality("resource_sensitivity", "is_privileged_action"),
                             "predicted_attack": F.expr(PREDICTED), "classifier_confidence": F.expr(f"CAST({CONFIDENT} AS DOUBLE)")})
    rows = rows.withColumns({"risk_score": R.combined_risk(*PARTS),
                             "behaviour": R.behavioural_score("anomaly_score", "sequence_anomaly_score", "deviation")})
    return rows.withColumn("severity", R.severity("risk_score", PRIORITY))

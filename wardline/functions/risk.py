"""Risk arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.scalar import clip, col, number, python_round
from wardline.schema import ATTACKS, CLASS_ACTIONS, COMMON_ACTIONS, ESCALATION, RISK_WEIGHTS


def checked_weights(weights: dict | None = None) -> dict:
    weights = dict(weights or RISK_WEIGHTS)
    if any(w < 0 for w in weights.values()) or not math.isclose(sum(weights.values()), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("risk weights must not be negative and must sum to one")
    return weights


def profile_deviation(values) -> Column:
    """Mean absolute scaled value, each capped at five, over three."""
    values = col(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.least(F.abs(x), F.lit(5.0)))
    return clip(total / F.size(values) / 3.0, 0, 1)


def behavioural_score(anomaly, sequence, deviation, weights: dict | None = None) -> Column:
    w = checked_weights(weights)
    total = w["anomaly"] + w["sequence"] + w["deviation"]
    if total <= 0:
        raise ValueError("behavioural risk needs a normal-only component")
    mix = (F.lit(w["anomaly"]) * number(anomaly) + F.lit(w["sequence"]) * number(sequence)
           + F.lit(w["deviation"]) * number(deviation))
    return clip(mix / F.lit(total), 0, 1)


def risk_parts(anomaly, sequence, malicious, deviation, criticality, weights: dict | None = None) -> dict[str, Column]:
    w = checked_weights(weights)
    return {
        "behavioral_anomaly": F.lit(100 * w["anomaly"]) * number(anomaly),
        "sequence_anomaly": F.lit(100 * w["sequence"]) * number(sequence),
        "attack_classifier": F.lit(100 * w["classifier"]) * number(malicious),
        "profile_deviation": F.lit(100 * w["deviation"]) * number(deviation),
        "resource_criticality": F.lit(100 * w["criticality"]) * number(criticality),
    }


def combined_risk(anomaly, sequence, malicious, deviation, criticality, weights: dict | None = None) -> Column:
    w = checked_weights(weights)
    return F.lit(100.0) * (F.lit(w["anomaly"]) * number(anomaly) + F.lit(w["sequence"]) * number(sequence)
                           + F.lit(w["classifier"]) * number(malicious) + F.lit(w["deviation"]) * number(deviation)
                           + F.lit(w["criticality"]) * number(criticality))


def bounded_risk(*parts, weights: dict | None = None) -> Column:
    return clip(combined_risk(*parts, weights=weights), 0, 100)


def risk_composition(*parts, weights: dict | None = None) -> Column:
    """Contributions rounded half to even, two places."""
    return F.struct(*[python_round(v, 2).alias(k) for k, v in risk_parts(*parts, weights=weights).items()])


def severity(risk, priority: float = 70.0) -> Column:
    risk = number(risk)
    return (F.when(risk < 30, "low").when(risk < 50, "medium").when(risk < priority, "high").otherwise("critical"))


def model_confidence(classifier, baseline) -> Column:
    return clip((number(classifier) + number(baseline)) / 2.0, 0, 1)


def strongest_malicious(probabilities, classes=ATTACKS) -> Column:
    """Largest probability of a class other than normal, from a map of class to probability."""
    p = col(probabilities)
    return F.coalesce(F.array_max(F.array(*[F.coalesce(p[c], F.lit(0.0)) for c in classes])), F.lit(0.0))


def best_class(probabilities, classes) -> Column:
    """First class with the largest probability."""
    values = F.array(*[F.coalesce(col(probabilities)[c], F.lit(0.0)) for c in classes])
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def routed_class(predicted, behaviour, probabilities, threshold: float) -> Column:
    """A normal verdict over the behavioural threshold goes to the closest attack class."""
    flagged = (number(behaviour) >= threshold) & (col(predicted) == "normal")
    return F.when(flagged, best_class(probabilities, sorted(ATTACKS))).otherwise(col(predicted))


def recommended_actions(predicted, level) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_ACTIONS.items() for x in pair])
    own = F.coalesce(F.try_element_at(table, col(predicted)), F.lit(CLASS_ACTIONS["normal"]))
    common = F.array(*[F.lit(a) for a in COMMON_ACTIONS])
    urgent = F.when(col(level) == "critical", F.array(F.lit(ESCALATION))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(own), urgent, common)

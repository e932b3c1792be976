"""One series of the drift monitor in order: it freezes on detection and resumes after a review. Shared by log and stream."""

from __future__ import annotations

import math

import numpy as np

from wardline.schema import SIGNALS

REVIEW_RESULTS = {"investigate": "investigating", "approve_adaptation": "approved_adaptation",
                  "reject_change": "rejected_change", "dismiss": "dismissed"}
START = ((), (), "collecting_reference", 1, 0, 0)


def _sum(values: np.ndarray) -> float:
    """From left to right, as Spark's `aggregate` adds the values of a block."""
    return float(np.cumsum(values)[-1])


def _center(values: np.ndarray, hours: bool) -> float:
    if not hours:
        return _sum(values) / len(values)
    turn = 2 * math.pi / 24
    angle = math.atan2(_sum(np.sin(values * turn)) / len(values), _sum(np.cos(values * turn)) / len(values)) % (2 * math.pi)
    return angle / (2 * math.pi) * 24


def _gap(a, b, hours: bool):
    if not hours:
        return np.abs(a - b)
    d = np.abs(a - b) % 24
    return np.minimum(d, 24 - d)


def compare(feature: str, old, new, policy) -> tuple[bool, float, float, float]:
    """(significant, effect, shift, distance) of two blocks."""
    hours, floor = feature == "access_hour", SIGNALS[feature][1]
    left, right = np.sort(np.asarray(old, dtype=float)), np.sort(np.asarray(new, dtype=float))
    a, b = _center(left, hours), _center(right, hours)
    shift = float(_gap(a, b, hours))
    spread = (math.sqrt(_sum(_gap(left, a, hours) ** 2) / len(left)) + math.sqrt(_sum(_gap(right, b, hours) ** 2) / len(right))) / 2
    effect = shift / max(spread, floor / policy.effect)
    points = np.concatenate([left, right])
    ks = float(np.abs(np.searchsorted(left, points, "right") / len(left) - np.searchsorted(right, points, "right") / len(right)).max())
    return shift >= floor and effect >= policy.effect and ks >= policy.ks, effect, shift, ks


def replay(feature: str, state: tuple, us, event, kind, value, action, analyst, policy) -> tuple[tuple, list[tuple]]:
    """The state (reference, current, status, version, observed, finding_us) after rows in order, and what they led to.

    Each entry: kind, us, event_id, status, version, effect, shift, distance, analyst. Values arriving while a finding
    is pending are not learnt. Between two reviews values are taken block by block.
    """
    size, (reference, current, status, version, observed, since), out = policy.block, state, []
    reference, current = np.asarray(reference, dtype=float), np.asarray(current, dtype=float)
    at = 0
    for stop in (*np.flatnonzero(kind == "review"), len(us)):
        while at < stop and status != "pending_review":
            learning = len(reference) < size
            upto = min(stop, at + size - len(reference if learning else current))
            taken, observed, at = value[at:upto], observed + upto - at, upto
            if learning:
                reference = np.concatenate([reference, taken])
                status = "collecting_reference" if len(reference) < size else "collecting_current"
                continue
            current = np.concatenate([current, taken])
            if len(current) < size:
                continue
            significant, effect, shift, ks = compare(feature, reference, current, policy)
            if significant:
                status, since = "pending_review", int(us[at - 1])
                out.append(("finding", since, event[at - 1], status, version, effect, shift, ks, None))
            else:
                reference, current, version = current, np.empty(0), version + 1
        at = stop + 1
        if stop == len(us):
            break
        if status != "pending_review" or action[stop] not in REVIEW_RESULTS:
            out.append(("refused", int(us[stop]), "", status, version, None, None, None, analyst[stop]))
            continue
        if action[stop] == "approve_adaptation":
            reference, version = current, version + 1
        if action[stop] != "investigate":
            current, status, since = np.empty(0), "collecting_current", 0
        out.append((REVIEW_RESULTS[action[stop]], int(us[stop]), "", status, version, None, None, None, analyst[stop]))
    return (reference.tolist(), current.tolist(), status, version, observed, since), out

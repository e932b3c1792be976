"""Drift windows as keyed state: the monitor freezes on detection and resumes after a review."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import drift_replay
from wardline.operators.drift import DriftPolicy
from wardline.operators.drift_replay import START, replay

STATE = "reference array<double>, current array<double>, status string, version int, observed long, finding_us long"
OUTPUT = ("subject string, feature string, kind string, us long, event_id string, status string, baseline_version int, "
          "magnitude double, absolute_shift double, ks_distance double, analyst string")
RANK = {"value": 0, "review": 1}


def compare(feature: str, old, new, policy: DriftPolicy = DriftPolicy()) -> tuple[bool, float, float, float]:
    """(significant, effect, shift, distance) of two blocks, as the stream compares them."""
    return drift_replay.compare(feature, old, new, policy)


def inputs(values: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Values (subject, feature, us, event_id, value) and reviews (subject, feature, us, action, analyst) as one stream."""
    rows = values.select("subject", "feature", "us", "event_id", F.lit("value").alias("kind"), F.col("value").cast("double").alias("value"),
                         F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("analyst"))
    if reviews is None:
        return rows
    return rows.unionByName(reviews.select("subject", "feature", "us", F.lit("").alias("event_id"), F.lit("review").alias("kind"),
                                           F.lit(None).cast("double").alias("value"), "action", "analyst"))


def monitor(rows: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """Findings and review outcomes of a stream from `inputs`.

    State per (subject, feature) is two blocks and a few numbers. The rows of a micro-batch are ordered by
    time; the trigger size bounds them. Values arriving while a finding is pending are not learnt. Between two
    reviews values are taken block by block. `operators.drift.reviewed_log` gives the same for a whole log.
    """

    def advance(key, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        us, value, event, kind, action, analyst = (np.concatenate([f[c].to_numpy() for f in parts]) for c in ("us", "value", "event_id", "kind", "action", "analyst"))
        order = sorted(range(len(us)), key=lambda i: (us[i], RANK[kind[i]], event[i], action[i] or "", analyst[i] or ""))
        us, value, event, kind, action, analyst = (x[order] for x in (us, value.astype(float), event, kind, action, analyst))
        after, out = replay(key[1], state.get if state.exists else START, us, event, kind, value, action, analyst, policy)
        state.update(after)
        yield pd.DataFrame([(*key, *row) for row in out], columns=[f.split()[0] for f in OUTPUT.split(", ")])

    return rows.groupBy("subject", "feature").applyInPandasWithState(advance, OUTPUT, STATE, "append", "NoTimeout")

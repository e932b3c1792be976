"""Gated recurrent reservoir with a ridge decoder, fitted on normal sequences only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.scaling import long_quantiles
from wardline.operators.scores import entity_sequences, normalise, top_residual
from wardline.session import cut_lineage


@dataclass
class Reservoir:
    """Fixed random weights drawn from a seed in the order update, reset, candidate (input, hidden)."""

    inputs: int
    hidden: int = 32
    window: int = 12
    ridge: float = 1e-3
    top: int = 5
    seed: int = 42
    minimum: int = 3
    mode: str = "linear_clip"
    decoder: np.ndarray | None = None
    low: float = 0.0
    high: float = 1.0
    weights: dict = field(init=False, repr=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        across, within = 1 / np.sqrt(max(self.inputs, 1)), 1 / np.sqrt(self.hidden)
        self.weights = {}
        for gate in ("update", "reset", "candidate"):
            self.weights[gate] = (rng.normal(0, across, (self.inputs, self.hidden)), rng.normal(0, within, (self.hidden, self.hidden)))

    def encode(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Final hidden state of each sequence; sequences of unequal length advance together from the right."""
        state = np.zeros((len(sequences), self.hidden))
        lengths = np.array([min(len(s), self.window) for s in sequences], dtype=int)
        longest = int(lengths.max()) if len(lengths) else 0
        padded = np.zeros((len(sequences), longest, self.inputs))
        for row, sequence in enumerate(sequences):
            if lengths[row]:
                padded[row, longest - lengths[row]:] = np.vstack(sequence[-self.window:])
        for step in range(longest):
            live = lengths >= longest - step
            x, h = padded[live, step], state[live]
            squash = lambda v: 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))
            gates = {g: x @ wx for g, (wx, _) in self.weights.items()}
            update = squash(gates["update"] + h @ self.weights["update"][1])
            reset = squash(gates["reset"] + h @ self.weights["reset"][1])
            fresh = np.tanh(gates["candidate"] + (reset * h) @ self.weights["candidate"][1])
            state[live] = (1 - update) * h + update * fresh
        return state

    def design(self, sequences: list[np.ndarray]) -> np.ndarray:
        hidden = self.encode(sequences)
        return np.hstack([hidden, np.ones((len(hidden), 1))])


def with_history(rows: DataFrame, vector: str, model: Reservoir, entity: str = "entity_id", order=("us", "event_id"), chunk: int = 4096,
                 width: int | None = None) -> DataFrame:
    """Add `sequence`, the entity's preceding vectors, and `position`, its rank within the entity."""
    return entity_sequences(rows, F.col(vector), model.window, entity, "sequence", order, chunk, width)


def _arrays(frame: pd.DataFrame, vector: str) -> tuple[list, np.ndarray]:
    sequences = [list(s) for s in frame["sequence"]]
    return sequences, np.vstack(frame[vector].to_numpy()) if len(frame) else np.zeros((0, 0))


def fit_decoder(rows: DataFrame, vector: str, model: Reservoir) -> Reservoir:
    """Solve the ridge decoder from per-partition Gram blocks.

    Each partition emits one (hidden+1) x (hidden+1+inputs) block whatever its rows; the blocks are summed
    by cell in Spark, so the driver receives a single block.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    side = model.hidden + 1
    cells = side * (side + model.inputs)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = shared.value, np.zeros((side, side + shared.value.inputs))
        for frame in batches:
            if len(frame):
                sequences, target = _arrays(frame, vector)
                design = held.design(sequences)
                total += design.T @ np.hstack([design, target])
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    summed = (rows.select("sequence", vector).mapInPandas(blocks, "cell long, value double")
              .groupBy("cell").agg(F.sum("value").alias("value")).collect())
    if not summed:
        raise ValueError("the decoder needs normal sequences")
    gram = np.zeros(cells)
    for r in summed:
        gram[r["cell"]] = r["value"]
    gram = gram.reshape(side, side + model.inputs)
    penalty = model.ridge * np.eye(side)
    penalty[-1, -1] = 0.0
    model.decoder = np.linalg.solve(gram[:, :side] + penalty, gram[:, side:])
    return model


def with_predictions(rows: DataFrame, model: Reservoir) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        for sequences in batches:
            design = held.design([list(s) for s in sequences])
            yield pd.Series(list(design @ held.decoder))

    return rows.withColumn("predicted", predict("sequence"))


def with_residuals(rows: DataFrame, vector: str, model: Reservoir) -> DataFrame:
    return with_predictions(rows, model).withColumn("residual", top_residual("predicted", vector, min(model.top, model.inputs))).drop("predicted")


def fit(rows: DataFrame, vector: str, model: Reservoir, entity: str = "entity_id", order=("us", "event_id"), label: str = "label",
        width: int | None = None) -> Reservoir:
    """Fit on normal rows; histories advance on normal rows only. Needs no minimum history."""
    normal = with_history(rows.where(F.col(label) == "normal"), vector, model, entity, order, width=width)
    fit_decoder(normal, vector, model)
    # Written down: the quantiles read them several times, and their null filter would encode every sequence once more.
    errors = cut_lineage(with_residuals(normal, vector, model).select(F.lit("residual").alias("name"), F.col("residual").alias("value")))
    bounds = long_quantiles(errors, (.5, .9975)).first()
    model.low, model.high = float(bounds["q0"]), float(bounds["q1"])
    return model


def score(rows: DataFrame, vector: str, model: Reservoir, entity: str = "entity_id", order=("us", "event_id"), name: str = "sequence_anomaly_score",
          width: int | None = None) -> DataFrame:
    """Score every row against the entity's preceding rows; below the minimum history the score is zero."""
    held = with_history(rows, vector, model, entity, order, width=width)
    scored = with_residuals(held, vector, model)
    value = F.when(F.col("position") <= model.minimum, F.lit(0.0)).otherwise(
        normalise("residual", F.lit(model.low), F.lit(model.high), model.mode))
    return scored.withColumn(name, value).drop("sequence", "residual", "position")

"""Synthetic panels with planted advances, generated where they are used: each entity from its own seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BARS = "entity_id long, date date, open double, high double, low double, close double, volume double, planted_signal double, null_feature double"
TRUTH = "entity_id long, trough_day int, magnitude double, duration int"


def _starts(rng: np.random.Generator, n_days: int, n: int, gap: int = 200) -> list[int]:
    """Up to n starts at least gap days apart, none so late that a move does not fit."""
    kept: list[int] = []
    for day in rng.permutation(np.arange(100, max(101, n_days - 160))):
        if len(kept) < n and all(abs(int(day) - k) >= gap for k in kept):
            kept.append(int(day))
    return sorted(kept)


def _entity(entity: int, n_days: int, seed: int, planted: int, adversarial: bool) -> tuple[dict, list[tuple]]:
    rng = np.random.default_rng([seed, entity])
    r = rng.normal(0.0, 0.015, n_days)
    volume = rng.lognormal(13, 0.3, n_days)
    signal, truth = rng.normal(0, 1, n_days), []
    for start in _starts(rng, n_days, planted):
        duration, magnitude = int(rng.integers(40, 120)), float(rng.uniform(0.4, 1.5))
        r[start + 1 : start + 1 + duration] += np.log1p(magnitude) / duration
        signal[max(0, start - 20) : start + 1] += 2.5
        truth.append((entity, start, magnitude, duration))
    if adversarial:  # crashes, gaps, shakeouts and volume spikes
        for day in rng.integers(50, n_days, 4):
            r[day] += float(rng.choice([-0.35, 0.25, -0.12]))
            volume[rng.integers(0, n_days)] *= 15
    close = 50 * np.exp(np.cumsum(r))
    spread = np.abs(rng.normal(0, 0.006, (2, n_days)))
    days = pd.bdate_range("2005-01-03", periods=n_days).date
    columns = {"entity_id": entity, "date": days, "open": close, "high": close * (1 + spread[0]), "low": close * (1 - spread[1]), "close": close, "volume": volume, "planted_signal": signal, "null_feature": rng.normal(0, 1, n_days)}
    return columns, truth


def generate_panel(spark: SparkSession, n_entities: int = 20, n_days: int = 2520, seed: int = 0, planted: int = 3, adversarial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bars, truth). Both are lazy and agree: an entity's numbers depend on the seed and its id alone."""
    ids = spark.range(n_entities)

    def bars(batches):
        for pdf in batches:
            for e in pdf["id"]:
                yield pd.DataFrame(_entity(int(e), n_days, seed, planted, adversarial)[0])

    def truth(batches):
        for pdf in batches:
            rows = [t for e in pdf["id"] for t in _entity(int(e), n_days, seed, planted, adversarial)[1]]
            yield pd.DataFrame(rows, columns=["entity_id", "trough_day", "magnitude", "duration"])

    return ids.mapInPandas(bars, BARS), ids.mapInPandas(truth, TRUTH)

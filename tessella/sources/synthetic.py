"""Seeded populations with known selectivity, made where they are needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(t: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """A circular and a linear feature and a binary one, as walks."""
    rng = np.random.default_rng(seed)
    return {
        "direction": np.mod(np.cumsum(rng.normal(0, 0.15, len(t))), 2 * np.pi),
        "speed": np.abs(np.convolve(rng.normal(size=len(t)), np.ones(15) / 15, "same")) * 10,
        "rest": (np.convolve(rng.normal(size=len(t)), np.ones(40) / 40, "same") > 0).astype(float),
    }


def kernel(fps: float, rise: float = 0.2, decay: float = 1.0) -> np.ndarray:
    t = np.arange(0, 5 * decay, 1 / fps)
    k = np.exp(-t / decay) - np.exp(-t / rise)
    return k / k.max()


def tuned_units(spark: SparkSession, units: int, frames: int, fps: float = 20.0, seed: int = 42) -> DataFrame:
    """(unit_id, tuned_to, t, value): unit k is tuned to feature k mod 4 (3: to none); its events are
    Bernoulli with a rate that follows the feature, blurred by the kernel, with noise."""
    names = ["direction", "speed", "rest", "none"]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(frames)
        f = features(t, seed)
        for pdf in batches:
            for u in pdf["id"]:
                rng = np.random.default_rng([seed, int(u)])
                kind = names[int(u) % 4]
                if kind == "direction":
                    drive = np.exp(4 * (np.cos(f["direction"] - rng.uniform(0, 2 * np.pi)) - 1))
                elif kind == "speed":
                    drive = 1 / (1 + np.exp(-(f["speed"] - np.median(f["speed"]))))
                elif kind == "rest":
                    drive = f["rest"]
                else:
                    drive = np.full(frames, 0.3)
                rate = np.clip(0.05 + 1.5 * drive + rng.normal(0, 0.03, frames), 0, None)
                events = (rng.random(frames) < rate / fps) * rng.uniform(0.5, 1.5, frames)
                value = np.convolve(events, kernel(fps))[:frames] + rng.normal(0, 0.05, frames)
                yield pd.DataFrame({"unit_id": int(u), "tuned_to": kind, "t": t, "value": value})

    return spark.range(units).mapInPandas(make, "unit_id long, tuned_to string, t long, value double")


def feature_rows(spark: SparkSession, frames: int, seed: int = 42) -> DataFrame:
    f = features(np.arange(frames), seed)
    return spark.createDataFrame(pd.DataFrame([(n, t, v) for n, x in f.items() for t, v in enumerate(x)], columns=["feature", "t", "value"]))


def score(found: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """(tp, fp, fn, sensitivity, precision, f1) of found against true keys."""
    j = found.select(*on).distinct().withColumn("_f", F.lit(1)).join(truth.select(*on).distinct().withColumn("_t", F.lit(1)), on, "full_outer")
    n = j.agg(F.count(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_f").isNull(), 1)).alias("fn"))
    return n.select("tp", "fp", "fn", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))

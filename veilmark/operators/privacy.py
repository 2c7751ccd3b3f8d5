"""Clipping, noise, accounting and the greedy choice of compatible merges."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def l1_clip(vectors: DataFrame, bound: int | DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, coord, value): vectors over the bound scaled to it by largest remainders (ties by coordinate),
    integer-exact in DECIMAL(38,0) while value x bound stays below 1e38. bound: a number, or (keys..., bound)."""
    own = [*keys, "site_id"]
    w = Window.partitionBy(*own)
    big = "decimal(38,0)"
    rows = vectors.withColumn("bound", F.lit(bound)) if isinstance(bound, int) else vectors.join(bound, list(keys)) if keys else vectors.crossJoin(F.broadcast(bound))
    rows = rows.select(*own, "coord", F.col("value").cast(big).alias("value"), F.col("bound").cast(big).alias("bound")).withColumn("norm", F.sum("value").over(w).cast(big))
    scaled = rows.withColumn("whole", F.expr(f"CASE WHEN norm > bound THEN CAST((value * bound) div norm AS {big}) ELSE value END"))
    scaled = scaled.withColumn("rest", F.expr(f"CASE WHEN norm > bound THEN CAST((value * bound) % norm AS {big}) ELSE CAST(0 AS {big}) END"))
    order = Window.partitionBy(*own).orderBy(F.desc("rest"), "coord")
    ranked = scaled.withColumns({"rank": F.row_number().over(order), "left": F.col("bound") - F.sum("whole").over(w)})
    extra = F.when((F.col("norm") > F.col("bound")) & (F.col("rank") <= F.col("left")), 1).otherwise(0)
    return ranked.select(*own, "coord", (F.col("whole") + extra).cast("bigint").alias("value"))


def coordinate_sums(vectors: DataFrame, *keys: str) -> DataFrame:
    return vectors.groupBy(*keys, "coord").agg(F.sum("value").alias("value"))


def site_norms(vectors: DataFrame, *keys: str) -> DataFrame:
    """L1 norms; sites with zeros only are kept."""
    return vectors.groupBy(*keys, "site_id").agg(F.sum("value").alias("norm"))


def clip_bound(norms: DataFrame, q: float = 0.75, *keys: str) -> DataFrame:
    """(keys..., bound): max(1, ceil(percentile)) of public norms."""
    return norms.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.percentile("norm", F.lit(q)))).cast("bigint").alias("bound"))


def two_sided_geometric(epsilon: float, sensitivity: int, size: int, rng: np.random.Generator) -> list[int]:
    """Discrete Laplace noise as the difference of two geometrics."""
    if not (math.isfinite(epsilon) and epsilon > 0) or sensitivity <= 0:
        raise ValueError("epsilon and sensitivity must be positive")
    p = -math.expm1(-epsilon / sensitivity)
    a, b = rng.geometric(p, size), rng.geometric(p, size)
    return [int(x) - int(y) for x, y in zip(a, b)]


def noise_table(spark, coords: int, epsilon: float, sensitivity: int, seed: int) -> DataFrame:
    """(coord, noise), drawn in coordinate order."""
    draw = two_sided_geometric(epsilon, sensitivity, coords, np.random.default_rng(seed))
    return spark.createDataFrame(list(enumerate(draw)), "coord int, noise bigint")


def with_noise(sums: DataFrame, noise: DataFrame) -> DataFrame:
    """(coord, value, noise): noisy sums and the noise in them."""
    return sums.join(F.broadcast(noise), "coord").select("coord", (F.col("value") + F.col("noise")).alias("value"), "noise")


def stable_generator(*parts: object) -> np.random.Generator:
    """A generator that depends on the parts only, so a draw is the same in whatever partition it is made."""
    return np.random.default_rng(np.frombuffer(hashlib.sha256(":".join(map(str, parts)).encode()).digest(), np.uint32))


def client_noise(vectors: DataFrame, epsilon: float, bounds: int | DataFrame, seed: int, *keys: str) -> DataFrame:
    """vectors (keys..., site_id, coord, value) with a draw of each client added to each of its coordinates, made where the
    client's rows are; a client has one row a candidate."""
    own = [*keys, "site_id"]
    rows = vectors.withColumn("bound", F.lit(bounds)) if isinstance(bounds, int) else vectors.join(bounds, list(keys)) if keys else vectors.crossJoin(F.broadcast(bounds))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("coord")
        draw = two_sided_geometric(epsilon, int(pdf["bound"].iloc[0]), len(pdf), stable_generator(seed, *pdf[own].iloc[0]))
        return pdf.assign(value=pdf["value"] + draw)[[*own, "coord", "value"]]

    plain = rows.select(*own, "coord", F.col("value").cast("bigint").alias("value"), "bound")
    return plain.groupBy(*own).applyInPandas(run, plain.drop("bound").schema)


def round_budget(epsilon: float, planned_rounds: int) -> float:
    if not (math.isfinite(epsilon) and epsilon > 0) or planned_rounds <= 0:
        raise ValueError("epsilon and rounds must be positive")
    return epsilon / planned_rounds


def composed(budgets: list[float]) -> dict[str, float]:
    """Sequential composition over the executed rounds, by compensated sum; delta is 0."""
    if not budgets or any(not math.isfinite(b) or b <= 0 for b in budgets):
        raise ValueError("round budgets must be positive")
    return {"rounds": len(budgets), "epsilon": math.fsum(budgets), "delta": 0.0}


def accounting(rounds: DataFrame, *keys: str) -> DataFrame:
    """(keys..., rounds, least, most, epsilon) of executed rounds (keys..., epsilon)."""
    return rounds.groupBy(*keys).agg(F.count("*").alias("rounds"), F.min("epsilon").alias("least"), F.max("epsilon").alias("most"), F.sum("epsilon").alias("epsilon"))


def compatible_top(values: list[int], pairs: list[tuple[str, str]], batch: int) -> list[int]:
    """Indices of a batch of merges that do not interfere, best value first, ties by index.

    Choosing a pair strikes out all that it conflicts with: those that begin with its right part, end with its left part or
    have its product. Negative values may be chosen.
    """
    struck = np.zeros(len(pairs), bool)
    holders: dict[tuple[str, str], list[int]] = {}
    for k, (left, right) in enumerate(pairs):
        for role, symbol in (("begins", left), ("ends", right), ("makes", left + right)):
            holders.setdefault((role, symbol), []).append(k)
    chosen: list[int] = []
    for k in np.argsort(-np.array(values, object), kind="stable").tolist() if pairs else ():
        if len(chosen) < batch and not struck[k]:
            left, right = pairs[k]
            chosen.append(k)
            for conflict in (("begins", right), ("ends", left), ("makes", left + right)):
                struck[holders.get(conflict, [])] = True
    return chosen

"""Ranking metrics with exact tie groups, curves, and stratified bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALARS = ("roc_auc", "balanced_accuracy", "tpr_at_fpr_le_0_01", "tpr_at_fpr_le_0_001", "average_precision")


def clean_scores(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, label, score): repeated rows once; rows with a null label or score have no place in a ranking."""
    return df.where("is_member IS NOT NULL AND score IS NOT NULL").select(*keys, "site_id", F.col("is_member").cast("int").alias("label"), "score").distinct()


def curve_points(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., score, tp, pp, fp, positives, negatives) at each tie group, best score first.

    Ties are one group before anything is sorted; the window runs over distinct scores of a run, not over rows.
    """
    groups = df.groupBy(*keys, "score").agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    points = groups.withColumns({"tp": F.sum("y").over(w), "pp": F.sum("n").over(w), "positives": F.sum("y").over(whole), "all": F.sum("n").over(whole)})
    return points.select(*keys, "score", "tp", "pp", (F.col("pp") - F.col("tp")).alias("fp"), "positives", (F.col("all") - F.col("positives")).alias("negatives"))


def scalar_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """The five metrics of each run that has both classes; df: keys..., label, score."""
    points = curve_points(df, *keys).where("positives > 0 AND negatives > 0")
    w = Window.partitionBy(*keys).orderBy("pp")
    tpr, fpr = F.col("tp") / F.col("positives"), F.col("fp") / F.col("negatives")
    steps = points.select(*keys, tpr.alias("tpr"), fpr.alias("fpr"), (F.col("tp") / F.col("pp")).alias("precision"), "pp").withColumns(
        {"tpr0": F.coalesce(F.lag("tpr").over(w), F.lit(0.0)), "fpr0": F.coalesce(F.lag("fpr").over(w), F.lit(0.0))}
    )
    at = lambda most: F.coalesce(F.max(F.when(F.col("fpr") <= most, F.col("tpr"))), F.lit(0.0))  # noqa: E731  (0, 0) is a point
    return steps.groupBy(*keys).agg(
        F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("roc_auc"),
        F.greatest(F.max((F.col("tpr") + 1 - F.col("fpr")) / 2), F.lit(0.5)).alias("balanced_accuracy"),
        at(0.01).alias("tpr_at_fpr_le_0_01"),
        at(0.001).alias("tpr_at_fpr_le_0_001"),
        F.sum((F.col("tpr") - F.col("tpr0")) * F.col("precision")).alias("average_precision"),
    )


def roc_curve(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., fpr, tpr, threshold) with the start (0, 0), whose infinite threshold is null."""
    points = curve_points(df, *keys).where("positives > 0 AND negatives > 0")
    rows = points.select(*keys, (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / F.col("positives")).alias("tpr"), F.col("score").alias("threshold"))
    start = points.select(*keys).distinct().select(*keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return start.unionByName(rows)


def pr_curve(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., recall, precision, threshold) with the end (0, 1)."""
    points = curve_points(df, *keys).where("positives > 0 AND negatives > 0")
    rows = points.select(*keys, (F.col("tp") / F.col("positives")).alias("recall"), (F.col("tp") / F.col("pp")).alias("precision"), F.col("score").alias("threshold"))
    end = points.select(*keys).distinct().select(*keys, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"))
    return rows.unionByName(end)


def interpolated_roc(curve: DataFrame, grid_size: int, *keys: str) -> DataFrame:
    """(keys..., x, tpr): the curve on an even grid of false-positive rates by linear interpolation (last value at ties)."""
    flat = curve.groupBy(*keys, "fpr").agg(F.max("tpr").alias("tpr"))
    spark = curve.sparkSession
    grid = spark.range(grid_size).select((F.col("id") / (grid_size - 1)).alias("fpr"))
    wanted = flat.select(*keys).distinct().crossJoin(F.broadcast(grid)).withColumns({"tpr": F.lit(None).cast("double"), "wanted": F.lit(1)})
    rows = flat.withColumn("wanted", F.lit(0)).unionByName(wanted)
    w = Window.partitionBy(*keys).orderBy("fpr", "wanted")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("wanted") == 0, F.struct("fpr", "tpr"))
    both = rows.withColumns({"a": F.last(known, True).over(before), "b": F.first(known, True).over(after)}).where("wanted = 1")
    slope = F.coalesce(F.try_divide(F.col("b.tpr") - F.col("a.tpr"), F.nullif(F.col("b.fpr") - F.col("a.fpr"), F.lit(0.0))), F.lit(0.0))
    return both.select(*keys, F.col("fpr").alias("x"), (F.col("a.tpr") + slope * (F.col("fpr") - F.col("a.fpr"))).alias("tpr"))


def _by_ties(weights: np.ndarray, score: np.ndarray) -> np.ndarray:
    """(draws, tie groups): weights of the sites (draws, sites) summed over equal scores, best score first."""
    order = np.argsort(-score)
    fresh = np.flatnonzero(np.diff(score[order], prepend=np.inf))
    return np.add.reduceat(weights[:, order], fresh, axis=1)


def weighted_metrics(label: np.ndarray, score: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The five metrics of one ranking under each row of site weights (draws, sites), from the tie groups' counts.

    A member beats the others of later groups and half of those of its own: that is the area under the ROC curve.
    """
    own, other = _by_ties(weights * (label == 1), score), _by_ties(weights * (label != 1), score)
    tp, fp = own.cumsum(1), other.cumsum(1)
    members, others = tp[:, -1:], fp[:, -1:]
    beaten = others - fp + other / 2
    recall, fallout = tp / members, fp / others
    best = lambda most: np.where(fallout <= most, recall, 0).max(1)  # noqa: E731  (the start of the curve has 0)
    return {
        "roc_auc": (own * beaten).sum(1) / (members * others)[:, 0],
        "balanced_accuracy": np.maximum((recall + 1 - fallout).max(1) / 2, 0.5),
        "tpr_at_fpr_le_0_01": best(0.01),
        "tpr_at_fpr_le_0_001": best(0.001),
        "average_precision": (own * tp / np.maximum(tp + fp, 1)).sum(1) / members[:, 0],
    }


def stratified_weights(label: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """(draws, sites): how often each site stands in a resample that keeps the numbers of members and others."""
    out = np.zeros((draws, len(label)), np.int64)
    for stratum in (label == 1, label != 1):
        n = int(stratum.sum())
        out[:, stratum] = rng.multinomial(n, np.full(n, 1 / n), draws)
    return out


def bootstrap_intervals(df: DataFrame, key: str, iterations: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(key, metric, lower, upper): stratified percentile intervals over sites. Runs are resampled in parallel, all draws
    of a run at once as weights; a run's sites are the bounded pool of an experiment. Runs of one class have no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["site_id", "score"])
        y, s = pdf["label"].to_numpy(), pdf["score"].to_numpy()
        if y.min() == y.max():
            return pd.DataFrame(columns=[key, "metric", "lower", "upper"])
        found = weighted_metrics(y, s, stratified_weights(y, iterations, np.random.default_rng(seed)))
        tail = (1 - confidence) / 2
        bounds = {m: np.quantile(found[m], [tail, 1 - tail]) for m in SCALARS}
        return pd.DataFrame({key: pdf[key].iloc[0], "metric": SCALARS, "lower": [bounds[m][0] for m in SCALARS], "upper": [bounds[m][1] for m in SCALARS]})

    kind = dict(df.dtypes)[key]
    return df.select(key, "site_id", "label", "score").groupBy(key).applyInPandas(run, f"{key} {kind}, metric string, lower double, upper double")


def paired_rows(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Scores of two methods by site; sites or labels that differ are an error."""
    left = a.select(*keys, "site_id", F.col("label").alias("label_a"), F.col("score").alias("score_a"))
    right = b.select(*keys, "site_id", F.col("label").alias("label_b"), F.col("score").alias("score_b"))
    rows = left.join(right, [*keys, "site_id"], "full_outer")
    same = F.col("label_a").eqNullSafe(F.col("label_b")) & F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    return rows.withColumn("label", F.when(same, F.col("label_a")).otherwise(F.raise_error(F.concat(F.lit("unpaired site "), "site_id"))))


def paired_auc_bootstrap(rows: DataFrame, key: str, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(key, difference, lower, upper): AUC difference with the same weights of the sites for both scores."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site_id")
        y, a, b = (pdf[c].to_numpy() for c in ("label", "score_a", "score_b"))
        if y.min() == y.max():
            return pd.DataFrame(columns=[key, "difference", "lower", "upper"])
        weights = np.vstack([np.ones((1, len(y)), np.int64), stratified_weights(y, iterations, np.random.default_rng(seed))])
        point, *draws = weighted_metrics(y, a, weights)["roc_auc"] - weighted_metrics(y, b, weights)["roc_auc"]
        low, high = np.quantile(draws, [0.025, 0.975])
        return pd.DataFrame([(pdf[key].iloc[0], point, low, high)], columns=[key, "difference", "lower", "upper"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "site_id", "label", "score_a", "score_b").groupBy(key).applyInPandas(run, f"{key} {kind}, difference double, lower double, upper double")


def pairing_conflicts(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, conflict): sites that paired_rows fails on: missing on a side, or with another label there."""
    left = a.select(*keys, "site_id", F.col("label").alias("label_a"), F.col("score").alias("score_a"))
    right = b.select(*keys, "site_id", F.col("label").alias("label_b"), F.col("score").alias("score_b"))
    conflict = F.when(F.col("score_a").isNull(), "only_b").when(F.col("score_b").isNull(), "only_a").when(F.col("label_a") != F.col("label_b"), "label")
    return left.join(right, [*keys, "site_id"], "full_outer").select(*keys, "site_id", conflict.alias("conflict")).where("conflict IS NOT NULL")


def bootstrap_mean(df: DataFrame, key: str, value: str, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(key, mean, lower, upper) of repeated measurements."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy())
        rng = np.random.default_rng(seed)
        means = rng.choice(x, (iterations, len(x))).mean(1)
        return pd.DataFrame([(pdf[key].iloc[0], float(x.mean()), float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975)))], columns=[key, "mean", "lower", "upper"])

    kind = dict(df.dtypes)[key]
    return df.select(key, value).dropna().groupBy(key).applyInPandas(run, f"{key} {kind}, mean double, lower double, upper double")


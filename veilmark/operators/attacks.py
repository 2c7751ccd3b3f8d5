"""Five site-level membership scores as DataFrame -> (site_id, score)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.statistics import safe_correlation
from veilmark.operators.tokens import SPECIAL_TOKENS

SATURATED = 1e300  # fixed value: the score of a certain member


def compression_scores(texts: DataFrame, tokens_by_site: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, bytes, tokens, score): UTF-8 bytes by tokens; tokens_by_site: (keys..., site_id, tokens). A site
    without tokens is an error."""
    size = texts.groupBy("site_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    both = size.join(tokens_by_site, "site_id", "left")
    ratio = F.when(F.coalesce("tokens", F.lit(0)) > 0, F.col("bytes") / F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("no tokens for "), "site_id")))
    return both.select(*keys, "site_id", "bytes", "tokens", ratio.alias("score"))


def shadow_patterns(target_vocab: DataFrame, shadow_vocab: DataFrame, *keys: str) -> DataFrame:
    """(keys..., shadows, in_target, n): how many tokens are in exactly these shadows (sorted ids), in the target or not."""
    on = [*keys, "token"]
    held = shadow_vocab.groupBy(*on).agg(F.sort_array(F.collect_set("shadow_id")).alias("shadows"))  # at most all shadows
    both = held.join(target_vocab.select(*on, F.lit(True).alias("in_target")), on, "full_outer")
    none = F.array().cast("array<int>")
    return both.groupBy(*keys, F.coalesce("shadows", none).alias("shadows"), F.coalesce("in_target", F.lit(False)).alias("in_target")).agg(F.count("*").alias("n"))


def overlap_scores(target_vocab: DataFrame, shadow_vocab: DataFrame, training: DataFrame, sites: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, score): vocabulary overlap, for any number of shadows.

    Tokens collapse to the distinct sets of shadows that hold them, so sites meet those and not vocabularies. training:
    (keys..., shadow_id, site_id). A site needs shadows on both sides, else it is left out. An experiment (one value of the
    keys) is one task, with at most one row a vocabulary token and one a site; its comparisons are matrix products.
    """
    named = list(keys) or ["_all"]
    one = (lambda df: df) if keys else (lambda df: df.withColumn("_all", F.lit(0)))
    classes = one(shadow_patterns(target_vocab, shadow_vocab, *keys).where("in_target OR size(shadows) > 0"))
    inside = training.groupBy(*keys, "site_id").agg(F.collect_set("shadow_id").alias("inside"))
    placed = one(sites.select(*keys, "site_id").distinct().join(inside, [*keys, "site_id"], "left"))
    kinds = dict(placed.dtypes)

    def run(classes_: pd.DataFrame, placed_: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({s for row in classes_["shadows"] for s in row})
        place = {s: k for k, s in enumerate(ids)}

        def matrix(rows) -> np.ndarray:
            out = np.zeros((len(rows), len(ids)))
            for k, row in enumerate(rows):
                out[k, [place[s] for s in (row if row is not None else ()) if s in place]] = 1
            return out

        holds, within = matrix(list(classes_["shadows"])), matrix(list(placed_["inside"]))
        n, target = classes_["n"].to_numpy(float), classes_["in_target"].to_numpy(bool)
        # a token held on both sides of a site's shadows is left out for the site
        kept = ((holds @ within.T == 0) | (holds @ (1 - within).T == 0)) * n[:, None]
        common = holds[target].T @ kept[target]
        union = kept[target].sum(0) + holds[~target].T @ kept[~target]
        share = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        own, others = within.sum(1), len(ids) - within.sum(1)
        some = (own > 0) & (others > 0)
        mean = lambda w, size: (share.T * w).sum(1) / np.maximum(size, 1)
        score = (mean(within, own) - mean(1 - within, others) + 1) / 2
        return placed_.assign(score=score)[[*named, "site_id", "score"]][some]

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*named, "site_id"]) + ", score double"
    scored = classes.groupBy(*named).cogroup(placed.groupBy(*named)).applyInPandas(run, schema)
    return scored.select(*keys, "site_id", "score")


def rank_correlations(target_vocab: DataFrame, shadow_vocab: DataFrame, *keys: str) -> DataFrame:
    """(keys..., shadow_id, r): correlation of the ids of shared tokens; 0 for fewer than two or constant ones."""
    own = [*keys, "shadow_id"]
    shared = shadow_vocab.join(target_vocab.select(*keys, "token", F.col("id").alias("target_id")), [*keys, "token"])
    r = shared.groupBy(*own).agg(safe_correlation((F.col("id") + 1).cast("double"), (F.col("target_id") + 1).cast("double")).alias("r"))
    return shadow_vocab.select(*own).distinct().join(r, own, "left").fillna({"r": 0.0})


def merge_similarity_scores(correlations: DataFrame, training: DataFrame, sites: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, score): (mean r over in-shadows - mean over out-shadows + 2) / 4. Shadows are a bounded list."""
    each = sites.select(*keys, "site_id").distinct()
    grid = each.join(correlations, list(keys)) if keys else each.crossJoin(F.broadcast(correlations))
    placed = grid.join(training.select(*keys, "shadow_id", "site_id", F.lit(True).alias("in")).distinct(), [*keys, "shadow_id", "site_id"], "left")
    inside = F.coalesce("in", F.lit(False))
    means = placed.groupBy(*keys, "site_id").agg(F.avg(F.when(inside, F.col("r"))).alias("a"), F.avg(F.when(~inside, F.col("r"))).alias("b"))
    return means.where("a IS NOT NULL AND b IS NOT NULL").select(*keys, "site_id", ((F.col("a") - F.col("b") + 2) / 4).alias("score"))


def _with_background(counts: DataFrame, background: DataFrame, involved: DataFrame, how: str, *keys: str) -> DataFrame:
    """counts with the background denominator: a site outside the involved set adds its own count."""
    inv = involved.select(*keys, "site_id").distinct().withColumn("_in", F.lit(True))
    rows = counts.where("cnt > 0").join(background.select(*keys, "token", F.col("cnt").alias("_bg")), [*keys, "token"], how).join(inv, [*keys, "site_id"], "left")
    own = F.when(F.col("_in").isNull(), F.col("cnt")).otherwise(0)
    return rows.withColumn("denominator", F.coalesce("_bg", F.lit(0)) + own)


def zipf_rarity(vocab: DataFrame, fits: DataFrame, *keys: str) -> DataFrame:
    """(keys..., token, rank, rarity): -log of the truncated power-law mass of a rank; ranks from xmin + 1 on.

    fits: (keys..., alpha, xmin), one row a vocabulary.
    """
    size = vocab.groupBy(*keys).agg(F.count("*").alias("v"))
    both = size.join(fits, list(keys)) if keys else size.crossJoin(F.broadcast(fits.select("alpha", "xmin")))  # one row
    ranks = F.sequence(F.col("xmin").cast("bigint") + 1, F.greatest(F.col("v"), F.col("xmin").cast("bigint") + 1))
    a = F.greatest(F.col("alpha"), F.lit(0.0))
    mass = both.select(*keys, a.alias("a"), "xmin", F.aggregate(F.transform(ranks, lambda r: F.pow(r.cast("double"), -a)), F.lit(0.0), lambda s, x: s + x).alias("mass"))
    ranked = vocab.select(*keys, "token", (F.col("id") + 1).alias("rank"))
    rows = ranked.join(mass, list(keys)) if keys else ranked.crossJoin(F.broadcast(mass))
    return rows.where("rank >= xmin + 1").select(*keys, "token", "rank", F.ln(F.greatest(F.pow(F.col("rank").cast("double"), F.col("a")) * F.col("mass"), F.lit(1e-300))).alias("rarity"))


def frequency_scores(counts: DataFrame, background: DataFrame, involved: DataFrame, vocab: DataFrame, sites: DataFrame, fits: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, score): largest share-of-token x rarity of a site; 0 without signals. fits: as in zipf_rarity."""
    rows = _with_background(counts, background, involved, "inner", *keys).join(zipf_rarity(vocab, fits, *keys), [*keys, "token"]).where("denominator > 0")
    best = rows.groupBy(*keys, "site_id").agg(F.max(F.col("cnt") / F.col("denominator") * F.col("rarity")).alias("score"))
    return sites.select(*keys, "site_id").distinct().join(best, [*keys, "site_id"], "left").fillna({"score": 0.0})


def most_ids(vocab: DataFrame, top_k: int, *keys: str) -> DataFrame:
    """(keys..., token): the tokens of the top_k highest ids, ties by token."""
    w = Window.partitionBy(*keys).orderBy(F.desc("id"), "token")
    return vocab.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k).select(*keys, "token")


def naive_bayes_scores(counts: DataFrame, background: DataFrame, involved: DataFrame, vocab: DataFrame, sites: DataFrame, top_k: int, *keys: str) -> DataFrame:
    """(keys..., site_id, score): -sum log(1 - p) over the top_k highest ids (ties by token); 1e300 once a p reaches 1."""
    rows = _with_background(counts.join(most_ids(vocab, top_k, *keys), [*keys, "token"], "left_semi"), background, involved, "left", *keys)
    p = F.coalesce(F.try_divide(F.col("cnt").cast("double"), "denominator"), F.lit(0.0))
    sums = rows.withColumn("p", p).groupBy(*keys, "site_id").agg(F.max("p").alias("top"), F.sum(F.when(F.col("p") < 1, F.log1p(-F.col("p"))).otherwise(0.0)).alias("s"))
    score = sums.select(*keys, "site_id", F.when(F.col("top") >= 1, F.lit(SATURATED)).otherwise(-F.col("s")).alias("score"))
    return sites.select(*keys, "site_id").distinct().join(score, [*keys, "site_id"], "left").fillna({"score": 0.0})


def hurwitz_zeta(s: float, q: np.ndarray | float) -> np.ndarray:
    """Hurwitz zeta by Euler-Maclaurin summation."""
    q = np.asarray(q, float)
    n = 12
    out = sum((q + k) ** -s for k in range(n))
    x = q + n
    out = out + x ** (1 - s) / (s - 1) + 0.5 * x**-s
    factor = s * x ** (-s - 1)
    for k, b in enumerate((1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)):
        out = out + b * factor
        factor = factor * (s + 2 * k + 1) * (s + 2 * k + 2) / x**2
    return out


#: Fixed values of the fit: bounds of the exponent, starts tried, least points of a tail and least share of all points,
#: and the result for fewer than three points.
LEAST_ALPHA, MOST_ALPHA, STARTS, TAIL_POINTS, TAIL_SHARE, FEW_POINTS_ALPHA = 1.000001, 10.0, 128, 20, 0.05, 2.0


def tail_exponents(log_sum: np.ndarray, weight: np.ndarray, xmin: np.ndarray) -> np.ndarray:
    """The likeliest exponent of each tail, all tails at once.

    The likelihood's slope, log_sum + weight x d/da log zeta(a, xmin), grows with a, so its root is halved in."""
    low, high = np.full(len(xmin), LEAST_ALPHA), np.full(len(xmin), MOST_ALPHA)
    for _ in range(60):
        middle = (low + high) / 2
        step = 1e-6 * middle
        slope = log_sum + weight * (np.log(hurwitz_zeta(middle + step, xmin)) - np.log(hurwitz_zeta(middle - step, xmin))) / (2 * step)
        low, high = np.where(slope < 0, middle, low), np.where(slope < 0, high, middle)
    return (low + high) / 2


def tail_fit(rank: np.ndarray, weight: np.ndarray) -> tuple[float, int, int, float]:
    """(alpha, xmin, points, ks) of sorted ranks with weights: the tail of least Kolmogorov-Smirnov distance, ties by xmin.

    Every tail is a suffix, so sums over tails are differences of running sums, and distances are running maxima of blocks.
    """
    n = len(rank)
    if n < 3:
        return FEW_POINTS_ALPHA, int(rank[0]) if n else 1, n, 0.0
    starts = np.unique(np.linspace(0, max(0, n - max(TAIL_POINTS, math.ceil(TAIL_SHARE * n))), STARTS).astype(int))
    suffix = lambda x: x.sum() - np.concatenate([[0.0], np.cumsum(x)])[starts]
    total, xmin = suffix(weight), rank[starts]
    alpha = tail_exponents(suffix(weight * np.log(rank)), total, xmin)
    below = np.cumsum(weight)
    ks = np.empty(len(starts))
    for k, start in enumerate(starts):  # a row of the tails' distances at a time
        empirical = (below[start:] - (below[start - 1] if start else 0)) / total[k]
        ks[k] = np.abs(empirical - 1 + hurwitz_zeta(alpha[k], rank[start:] + 1) / hurwitz_zeta(alpha[k], xmin[k])).max()
    best = np.lexsort((xmin, ks))[0]
    return float(alpha[best]), int(xmin[best]), n, float(ks[best])


def fit_zipf(vocab: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., alpha, xmin, points, ks): a weighted discrete power-law tail over the token ranks of each vocabulary.

    Special and single-character tokens are left out of the fit. A vocabulary (a bounded list) is one task.
    """
    rows = vocab.join(counts, [*keys, "token"]).where((F.col("cnt") > 0) & (F.length("token") > 1) & ~F.col("token").isin(*SPECIAL_TOKENS))
    named = list(keys) or ["_all"]
    points = (rows if keys else rows.withColumn("_all", F.lit(0))).select(*named, (F.col("id") + 1).cast("double").alias("rank"), F.col("cnt").cast("double").alias("weight"))
    kinds = dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        found = tail_fit(pdf["rank"].to_numpy(), pdf["weight"].to_numpy())
        return pd.DataFrame([(*pdf[named].iloc[0], *found)], columns=[*named, "alpha", "xmin", "points", "ks"])

    fits = points.groupBy(*named).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in named) + ", alpha double, xmin bigint, points bigint, ks double")
    if not keys:
        return fits.drop("_all")
    # a vocabulary without points has the fallback as well
    none = vocab.select(*keys).distinct().join(fits, named, "left_anti").select(*keys, F.lit(FEW_POINTS_ALPHA).alias("alpha"), F.lit(1).cast("bigint").alias("xmin"), F.lit(0).cast("bigint").alias("points"), F.lit(0.0).alias("ks"))
    return fits.unionByName(none)

"""Audit queries: each returns the offending rows, or counts that must be 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.functions.statistics import is_finite


def corpus_audit(df: DataFrame) -> DataFrame:
    """(check, n) over corpus records by one pass of conditional sums: blanks, URLs or ids in the text, stored hashes that
    do not match, sizes that do not match."""
    t = F.col("text")
    checks = {
        "null_text": t.isNull(),
        "blank_text": T.stripped(t) == "",
        "url_in_text": t.rlike(T.URL),
        "site_id_in_text": F.contains(t, F.col("site_id")),
        "text_hash": F.lower("text_sha256") != F.sha2(t, 256),
        "char_count": F.col("char_count") != F.length(t),
        "byte_count": F.col("byte_count") != F.octet_length(t),
    }
    row = df.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0)).alias(n) for n, c in checks.items()])
    return row.unpivot([], list(checks), "check", "n")


def overlapping_roles(roles: DataFrame) -> DataFrame:
    """(manifest_id, role_a, role_b, n): pairs of roles that share sites; self-join on the site, never roles x roles."""
    other = roles.select("manifest_id", "site_id", F.col("role").alias("role_b"))
    both = roles.withColumnRenamed("role", "role_a").join(other, ["manifest_id", "site_id"]).where("role_a < role_b")
    return both.groupBy("manifest_id", "role_a", "role_b").agg(F.count("*").alias("n"))


def unbalanced_probes(probes: DataFrame, prefixes: list[int], *keys: str) -> DataFrame:
    """(keys..., site_id, prefix, n): sites that are not a probe of exactly half of a prefix's shadows."""
    own = [*keys, "site_id"]
    each = probes.select(*own, "shadow_id", F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("prefix"))
    counts = each.groupBy(*own, "prefix").agg(F.sum((F.col("shadow_id") < F.col("prefix")).cast("int")).alias("n"))
    return counts.where(F.col("n") * 2 != F.col("prefix"))


def uncovered_sites(training: DataFrame, sites: DataFrame, *keys: str) -> DataFrame:
    """Sites that are in no shadow or in all shadows of their plan."""
    shadows = training.groupBy(*keys).agg(F.countDistinct("shadow_id").alias("shadows"))
    inside = training.groupBy(*keys, "site_id").agg(F.countDistinct("shadow_id").alias("n"))
    rows = sites.join(shadows, list(keys)).join(inside, [*keys, "site_id"], "left").fillna({"n": 0})
    return rows.where("n = 0 OR n = shadows")


def non_finite(df: DataFrame) -> DataFrame:
    """Rows with a null, NaN or infinite value in a double column."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.where(~reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in doubles], F.lit(True)))


def run_balance(details: DataFrame) -> DataFrame:
    """(run_id, n_rows, sites, members, null_scores, repeated) of each run, for cardinality checks."""
    return details.groupBy("run_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("site_id").alias("sites"), F.countDistinct(F.when(F.col("is_member"), F.col("site_id"))).alias("members"),
        F.sum(F.col("score").isNull().cast("int")).alias("null_scores"), (F.count("*") - F.countDistinct("site_id")).alias("repeated"),
    )


def bad_intervals(df: DataFrame) -> DataFrame:
    """Rows whose interval does not hold their value or whose provenance is unknown."""
    return df.where(~(F.col("value").between(F.col("lower"), F.col("upper"))) | ~F.col("data_source").isin("measured", "extrapolated"))

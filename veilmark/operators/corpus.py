"""Corpus building: validity with first failing reason, ordered de-duplication, caps, qualification, selection."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.session import checkpointed


@dataclass(frozen=True)
class Validity:
    min_chars: int = 200
    max_chars: int = 50_000
    min_letters: int = 80
    min_ascii_ratio: float = 0.65


def reject_reason(text: Column, rules: Validity = Validity()) -> Column:
    """First failing reason of a text, null when it is valid."""
    t = T.stripped(text)
    return (
        F.when(text.isNull() | (t == ""), "empty_text")
        .when(F.contains(t, F.lit("\0")), "encoding_anomaly")
        .when(F.length(t) < rules.min_chars, "too_short")
        .when(F.length(t) > rules.max_chars, "too_long")
        .when(~F.is_valid_utf8(t), "encoding_anomaly")
        .when((T.letter_count(t) < rules.min_letters) | (T.letter_ratio(t) < rules.min_ascii_ratio), "language_anomaly")
    )


def with_validity(df: DataFrame, rules: Validity = Validity()) -> DataFrame:
    """df with ``reason``; ``text`` is trimmed."""
    return df.withColumn("reason", reject_reason(F.col("text"), rules)).withColumn("text", T.stripped(F.col("text")))


def reason_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in stream order. Aggregation with the row as value, so it combines map-side; no window."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_row")).select(key, "_row.*").select(*df.columns)


def duplicate_kinds(df: DataFrame, key: str, order: str) -> DataFrame:
    """Later copies by whether the first owner is the same site: (kind, n)."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"), F.min_by("site_id", order).alias("_owner"))
    later = df.join(first, key).where(F.col(order) > F.col("_first"))
    return later.groupBy(F.when(F.col("site_id") == F.col("_owner"), "within_site").otherwise("cross_site").alias("kind")).agg(F.count("*").alias("n"))


def capped(df: DataFrame, site: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` accepted rows a site, the first in stream order. Spark prunes the ranks before the shuffle
    (WindowGroupLimit), so a hot site sends at most cap rows a partition."""
    w = Window.partitionBy(site).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def qualified_sites(df: DataFrame, site: str, least: int) -> DataFrame:
    return df.groupBy(site).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def retained_sequential(df: DataFrame, cap: int) -> DataFrame:
    """Rows retained by the strictly sequential rule: valid, the site under its cap of retained rows, and no retained
    earlier row with the same ``norm_hash``. (idx, site_id, norm_hash) only.

    The rule is a recursion in stream order that only rows of one site or one hash link; it is solved by rounds over the
    undecided rows. A round looks at the first ``cap`` undecided rows of each site (pruned before the shuffle, so a site of a
    third of all rows is no hot group) and retains those that are the first undecided of their hash and have room in their
    site even if all undecided rows before them are retained. What is retained stays behind as counts by site and hashes.
    """
    rows = checkpointed(df.select("idx", "site_id", "norm_hash"))
    first_of_site = Window.partitionBy("site_id").orderBy("idx")
    retained = rows.limit(0)
    held = rows.groupBy("site_id").agg(F.lit(0).cast("bigint").alias("held")).limit(0)
    while not rows.isEmpty():
        first_of_hash = rows.groupBy("norm_hash").agg(F.min("idx").alias("idx"))
        front = rows.withColumn("_n", F.row_number().over(first_of_site)).where(F.col("_n") <= cap)
        room = front.join(held, "site_id", "left").where(F.col("_n") + F.coalesce("held", F.lit(0)) <= cap)
        new = checkpointed(room.join(first_of_hash, ["norm_hash", "idx"], "left_semi").select("idx", "site_id", "norm_hash"))
        retained = retained.unionByName(new)
        held = checkpointed(held.unionByName(new.groupBy("site_id").agg(F.count("*").alias("held"))).groupBy("site_id").agg(F.sum("held").alias("held")))
        full = held.where(F.col("held") >= cap)
        rows = checkpointed(rows.join(new.select("norm_hash"), "norm_hash", "left_anti").join(full, "site_id", "left_anti").select("idx", "site_id", "norm_hash"))
    return retained


def scan_limit(accepted: DataFrame, main_least: int, main_sites: int, dev_least: int, dev_sites: int) -> DataFrame:
    """(cut_index, scan_limit): where a scan may stop once the main and the development sites have qualified."""

    def reached(least: int, place: int) -> DataFrame:
        w = Window.partitionBy("site_id").orderBy("idx")
        at = accepted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == least).select("idx")
        # the place-th smallest index: order and limit run as a bounded top-k
        return at.orderBy("idx").limit(place).agg(F.when(F.count("*") >= place, F.max("idx")).alias("idx"))

    both = reached(main_least, main_sites).unionByName(reached(dev_least, main_sites + dev_sites))
    return both.agg(F.when(F.count("idx") == 2, F.max("idx")).alias("cut_index")).withColumn("scan_limit", F.col("cut_index") + 1)


def choose_sites(counts: DataFrame, seed: int, scales: dict[str, tuple[int, int]], buffer: float = 1.25) -> DataFrame:
    """(scale, site_id, rank, buffered): for each scale (least texts, sites) the first sites of its hash ranking among
    those that qualify; ranks within buffer x sites are kept, those beyond sites marked as the buffer."""
    out = None
    for scale, (least, sites) in scales.items():
        ranked = counts.where(F.col("n") >= least).withColumn("key", T.hash_rank_key("final", scale, str(seed), F.col("site_id")))
        top = ranked.orderBy("key").limit(int(-(-sites * buffer // 1)))
        part = top.withColumn("rank", F.row_number().over(Window.orderBy("key"))).select(F.lit(scale).alias("scale"), "site_id", "rank", (F.col("rank") > sites).alias("buffered"))
        out = part if out is None else out.unionByName(part)
    return out


def site_text_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes"))


def missing_sites(sites: DataFrame, df: DataFrame) -> DataFrame:
    """Listed sites without texts: the strict grouped scan fails on them."""
    return sites.select("site_id").distinct().join(df.select("site_id"), "site_id", "left_anti")


def grouped_texts(df: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, texts) for the listed sites, in stream order; use where a site's texts fit one row."""
    return df.join(sites.select("site_id").distinct(), "site_id", "left_semi").groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("texts"))


def sequential_reference(rows: pd.DataFrame, cap: int) -> pd.DataFrame:
    """The sequential rule on a small table, for tests."""
    held: dict[str, int] = {}
    seen: set[str] = set()
    keep = []
    for r in rows.sort_values("idx").itertuples():
        ok = held.get(r.site_id, 0) < cap and r.norm_hash not in seen
        keep.append(ok)
        if ok:
            held[r.site_id] = held.get(r.site_id, 0) + 1
            seen.add(r.norm_hash)
    return rows.sort_values("idx")[keep]

"""Site indexes, strict audits, resource gates, hashed documents, benchmark matrices and SQL views."""

from __future__ import annotations

import resource
import shutil
import time
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.functions.statistics import exact_percentile, sample_sd
from veilmark.session import table
from veilmark.sources.tables import canonical_digest, load_json, replace_json


def utc_now() -> str:
    """The time in UTC, to the second."""
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def hashed(document: dict, name: str = "manifest_sha256") -> dict:
    """The document with the digest of all its other fields."""
    rest = {k: v for k, v in document.items() if k != name}
    return rest | {name: canonical_digest(rest)}


def site_index(df: DataFrame) -> DataFrame:
    """(site_id, texts, bytes) of a corpus (site_id, text)."""
    return df.groupBy("site_id").agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes"))


def check_resources(started: float, most_seconds: float, most_bytes: int, least_free: int, folder: str = "/") -> dict[str, float]:
    """Elapsed seconds, peak memory of the driver and free disk; each beyond its limit is an error."""
    seen = {"elapsed": time.perf_counter() - started, "peak": 1024 * resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, "free": shutil.disk_usage(folder).free}
    for name, bad, error in (("elapsed", seen["elapsed"] > most_seconds, TimeoutError), ("peak", seen["peak"] > most_bytes, MemoryError), ("free", seen["free"] < least_free, OSError)):
        if bad:
            raise error(f"{name} is {seen[name]}")
    return seen


def retained_audit(df: DataFrame) -> DataFrame:
    """(check, n) over a retained corpus (idx, site_id, text, digest, norm): what must not be there, copies of a text or of its
    normal form within a site and across sites among them. Aggregates by digest only."""
    t = F.col("text")
    row = df.agg(
        F.sum((t.isNull() | (T.stripped(t) == "")).cast("bigint")).alias("empty"),
        F.sum(F.coalesce(t.rlike(T.URL), F.lit(False)).cast("bigint")).alias("url_in_text"),
        F.sum(F.coalesce(F.contains(t, F.col("site_id")), F.lit(False)).cast("bigint")).alias("site_id_in_text"),
    )
    parts = [row.unpivot([], row.columns, "check", "n")]
    for name in ("digest", "norm"):
        groups = df.groupBy(name).agg(F.count("*").alias("c"), F.min_by("site_id", "idx").alias("owner"))
        later = df.join(groups.where("c > 1"), name).where("idx IS NOT NULL")
        first = groups.where("c > 1")
        own = later.where(F.col("site_id") == F.col("owner")).agg((F.count("*")).alias("n"))
        all_ = later.agg(F.count("*").alias("n"))
        within = own.crossJoin(first.agg(F.count("*").alias("g"))).select(F.lit(f"{name}_copy_within").alias("check"), (F.col("n") - F.col("g")).alias("n"))  # one row each
        cross = all_.crossJoin(own.select(F.col("n").alias("o"))).select(F.lit(f"{name}_copy_across").alias("check"), (F.col("n") - F.col("o")).alias("n"))
        parts += [within, cross]
    return reduce(DataFrame.unionByName, parts).select("check", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def manifest_audit(roles: DataFrame, plans: DataFrame) -> DataFrame:
    """(manifest_id, check, n) of what a manifest must not have: sites that are member and nonmember, pool sites in neither,
    sites of two of target, shadow auxiliary and public, training sites of a shadow that are neither auxiliary nor probe.

    roles: manifest_id, role, site_id; plans: manifest_id, shadow_id, kind (auxiliary, target_probe, training), site_id.
    """
    held = roles.groupBy("manifest_id", "site_id").agg(F.collect_set("role").alias("r"))  # at most the roles
    has = lambda *names: reduce(lambda a, b: a & b, [F.array_contains("r", n) for n in names])
    checks = {
        "member_and_nonmember": has("target_member", "target_nonmember"),
        "pool_in_neither": has("target_pool") & ~has("target_member") & ~has("target_nonmember"),
        "split_outside_pool": (has("target_member") | has("target_nonmember")) & ~has("target_pool"),
        "target_and_auxiliary": has("target_pool", "shadow_auxiliary"),
        "target_and_public": has("target_pool", "public_candidate"),
        "auxiliary_and_public": has("shadow_auxiliary", "public_candidate"),
    }
    sums = held.groupBy("manifest_id").agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in checks.items()])
    lists = plans.groupBy("manifest_id", "shadow_id", "site_id").agg(F.collect_set("kind").alias("k"))
    trains = F.array_contains("k", "training")
    off = trains != (F.array_contains("k", "auxiliary") | F.array_contains("k", "target_probe"))
    shadow = lists.groupBy("manifest_id").agg(F.sum(off.cast("bigint")).alias("n")).select("manifest_id", F.lit("training_mismatch").alias("check"), "n")
    return sums.unpivot(["manifest_id"], list(checks), "check", "n").unionByName(shadow)


def plan_lists(manifests: DataFrame) -> DataFrame:
    """(manifest_id, shadow_id, kind, site_id) of the shadow plans, distinct and without nulls."""
    plans = manifests.select("manifest_id", F.explode("shadow_plans").alias("p"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}_site_ids").alias("ids")) for k in ("auxiliary", "target_probe", "training")])).alias("x")
    rows = plans.select("manifest_id", "p.shadow_id", kinds).select("manifest_id", "shadow_id", "x.kind", F.explode("x.ids").alias("site_id"))
    return rows.where("site_id IS NOT NULL").distinct()


STAGES = ("encrypt", "sum", "noise", "decrypt", "choose")


def benchmark_matrix(run: Callable[[int, int, int], dict[str, float]], clients: list[int], dimensions: list[int], warmups: int, repetitions: int, state: str | None = None) -> list[dict]:
    """Measured rounds of every cell: (clients, k, repetition, seconds of the stages, total, bytes). run(clients, k, seed)
    measures one round and fails when its result is not the plain one. Warm-up rounds are run and left out. With a state
    file finished cells are taken from it, after a check that it was made for the same matrix."""
    design = canonical_digest([clients, dimensions, warmups, repetitions])
    done: dict = {"design": design, "cells": {}}
    if state and Path(state).exists():
        done = load_json(state)
        if done["design"] != design:
            raise ValueError("the state belongs to another matrix")
    for place, (c, k) in enumerate((c, k) for c in clients for k in dimensions):
        name = f"{c}:{k}"
        if name not in done["cells"]:
            rounds = [run(c, k, 1000 * place + n) for n in range(warmups + repetitions)][warmups:]
            done["cells"][name] = [{"clients": c, "k": k, "repetition": n} | r for n, r in enumerate(rounds)]
            if state:
                replace_json(state, done)
    return [r for cell in done["cells"].values() for r in cell]


def benchmark_summary(rounds: DataFrame, expected: DataFrame, repetitions: int, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(clients, k, repetitions, median, mean, sd, p95, medians of the stages, complete) of measured rounds (clients, k,
    repetition, total, stages...), one row an expected cell (clients, k); complete: it has every repetition once."""
    own = rounds.groupBy("clients", "k").agg(
        F.count("*").alias("repetitions"), F.countDistinct("repetition").alias("_distinct"), F.median("total").alias("median"), F.avg("total").alias("mean"),
        sample_sd(F.col("total")).alias("sd"), exact_percentile(F.col("total"), 0.95).alias("p95"), *[F.median(c).alias(f"{c}_median") for c in stages],
    )
    complete = (F.coalesce("repetitions", F.lit(0)) == repetitions) & (F.col("_distinct") == repetitions)
    return expected.join(own, ["clients", "k"], "left").withColumn("complete", F.coalesce(complete, F.lit(False))).fillna({"repetitions": 0}).drop("_distinct")


def grouped_report(runs: DataFrame, metrics: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys..., a text ``mean ± sd`` a metric) of runs."""
    from veilmark.operators.reporting import mean_sd_text

    rows = runs.groupBy(*keys).agg(*[x for m in metrics for x in (F.round(F.avg(m), 6).alias(m), F.round(sample_sd(F.col(m)), 6).alias(f"_{m}"))])
    return rows.select(*keys, *[mean_sd_text(F.col(m), F.col(f"_{m}")).alias(m) for m in metrics])


def pilot_summary(runs: DataFrame, intervals: DataFrame, expected: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """(keys..., metrics, their bounds, state) for every expected and every found run; state is ok, missing or unexpected.

    runs: keys..., metrics; intervals: keys..., metric, lower, upper.
    """
    wide = intervals.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in metrics for c in ("lower", "upper")])
    found = runs.select(*keys, *metrics, F.lit(True).alias("_found")).join(wide, keys, "left")
    rows = expected.select(*keys, F.lit(True).alias("_wanted")).join(found, keys, "full_outer")
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected").otherwise("ok")
    return rows.withColumn("state", state).drop("_found", "_wanted")


#: Views of the SQL front-end beside the stored tables: name to SQL over them, in order.
VIEWS = {
    "corpus_records": "SELECT source_record_index AS idx, first(site_id) AS site_id, first(text) AS text FROM stream_final_c4 WHERE source_record_index IS NOT NULL GROUP BY source_record_index",
    "corpus_units": rf"SELECT site_id, unit, count(*) AS cnt FROM (SELECT site_id, explode(regexp_extract_all(text, r'{T.UNIT}', 0)) AS unit FROM corpus_records WHERE site_id IS NOT NULL) GROUP BY site_id, unit",
    "target_sites": "SELECT DISTINCT manifest_id, site_id, array_contains(target_member_site_ids, site_id) AS is_member FROM (SELECT manifest_id, target_member_site_ids, explode(target_pool_site_ids) AS site_id FROM manifests) WHERE site_id IS NOT NULL",
}


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """The stored tables and the views over them as temporary views, for spark.sql."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)

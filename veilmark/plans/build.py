"""Builders: a corpus from a record stream, experiment manifests, shadow plans, labelled splits."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.operators import corpus, roles
from veilmark.session import bounded_broadcast, checkpointed


def final_corpus(records: DataFrame, rules: corpus.Validity, least: int, cap: int, sites: int, seed: int, sequential: bool = False) -> DataFrame:
    """Records (idx, site_id, text) to the published corpus: valid texts, first copies, sites that still reach ``least``,
    the first ``sites`` of their hash ranking, ``cap`` texts each.

    The duplicates go before the sites are chosen, as a site may fall below its least number by them. ``sequential``
    applies the strict stream rule, in which a copy is kept when the first one was turned away by its site's cap.
    Only indexes, sites and digests are shuffled; the texts join the published rows at the end.
    """
    valid = corpus.with_validity(records, rules).where("reason IS NULL AND site_id IS NOT NULL").drop("reason")
    keys = checkpointed(valid.select("idx", "site_id", F.sha2(T.normalized(F.col("text")), 256).alias("norm_hash")))
    if sequential:
        kept = corpus.retained_sequential(keys, cap).select("idx", "site_id", "norm_hash")
    else:
        kept = corpus.capped(corpus.first_occurrences(keys.select("norm_hash", "idx", "site_id"), "norm_hash", "idx"), "site_id", "idx", cap)
    kept = checkpointed(kept.select("idx", "site_id", "norm_hash"))
    counts = corpus.qualified_sites(kept, "site_id", least)
    chosen = counts.orderBy(T.hash_rank_key("final", "main", str(seed), F.col("site_id"))).limit(sites).select("site_id")
    published = kept.join(chosen, "site_id", "left_semi").select("idx", "norm_hash")
    rows = valid.join(bounded_broadcast(published), "idx")
    return rows.select("idx", "site_id", "norm_hash", "text", F.length("text").alias("char_count"), F.octet_length("text").alias("byte_count"))


def development_sites(candidates: DataFrame, main_candidates: DataFrame, main: DataFrame) -> DataFrame:
    """Development candidates together with the main candidates that were not taken."""
    return candidates.select("site_id").union(main_candidates.select("site_id").exceptAll(main.select("site_id"))).distinct()


def manifest(sites: DataFrame, seed: int, shadows: int = 8) -> DataFrame:
    """(role, site_id, shadow_id) of an experiment: target member, target nonmember, shadow auxiliary, public candidate;
    and probe rows with their shadow. Sites of an experiment are few; each list is a few rows of a long table."""
    placed = roles.role_slices(sites, seed)
    role = F.when(F.col("role") != "target", F.col("role")).when(F.col("is_member"), "target_member").otherwise("target_nonmember")
    lists = placed.select(role.alias("role"), "site_id", F.lit(None).cast("int").alias("shadow_id"))
    probes = roles.balanced_probes(placed.where("role = 'target'"), shadows, seed)
    return lists.unionByName(probes.select(F.lit("probe").alias("role"), "site_id", F.col("shadow_id").cast("int")))


def pilot_plans(target: list[str], auxiliary: list[str], shadows: int, seed: int, strict: bool = False) -> list[dict]:
    """Shadow plans of a pilot: each takes half of the shared sites, drawn again until every target site is inside some and
    outside others; strict plans take each target site in exactly half of the shadows."""
    rng = random.Random(seed)
    if strict:
        inside = [set() for _ in range(shadows)]
        for site in sorted(target):
            for s in rng.sample(range(shadows), shadows // 2):
                inside[s].add(site)
        return [{"shadow_id": s, "training_site_ids": sorted(auxiliary) + sorted(x)} for s, x in enumerate(inside)]
    pool = sorted({*target, *auxiliary})
    for _ in range(10_000):
        plans = [sorted(rng.sample(pool, len(pool) // 2)) for _ in range(shadows)]
        if all(0 < sum(site in p for p in plans) < shadows for site in target):
            return [{"shadow_id": s, "training_site_ids": p} for s, p in enumerate(plans)]
    raise RuntimeError("no plan covers every site on both sides")


def labelled_splits(train: DataFrame, test: DataFrame, seed: int, fraction: float = 0.1) -> DataFrame:
    """(h, id, label, text, split): validation drawn by hash from train, copies kept in test before validation before
    train. Inputs: id, label, text."""
    drawn = roles.stratified_split(train, "label", "id", seed, fraction)
    hashed = lambda df: df.withColumn("h", F.sha2(T.collapsed(F.col("text")), 256)).select("h", "id", "label", "text")
    parts = [("test", hashed(test)), ("validation", hashed(drawn.where("split = 'validation'"))), ("train", hashed(drawn.where("split = 'train'")))]
    return roles.split_priority(parts, "h", "id")


def search_plan(spark, modes: dict[str, dict[str, list[str]]], base: dict[str, str]) -> DataFrame:
    """(mode, pos, parameters..., id): a one-factor grid for each mode."""
    from veilmark.operators.reporting import one_factor_grid
    from veilmark.plans.matrix import configuration_id

    out = None
    for mode, options in modes.items():
        grid = one_factor_grid(spark, base, options).withColumn("mode", F.lit(mode))
        out = grid if out is None else out.unionByName(grid)
    return out.withColumn("id", configuration_id(F.col("mode"), *[(c, F.col(c)) for c in base]))


def downstream_tasks(selected: DataFrame, baselines: DataFrame, seeds: list[int]) -> DataFrame:
    """(method_id, seed, pos): the selected methods and the baselines, each once in the order given, for every seed."""
    methods = selected.select("method_id", "pos").unionByName(baselines.select("method_id", "pos")).groupBy("method_id").agg(F.min("pos").alias("pos"))
    return methods.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))

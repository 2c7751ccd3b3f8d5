"""The five attacks on trained tokenizers, for every manifest at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators import attacks, binattacks, bpe, gathered, tokens, unitbags
from veilmark.plans.matrix import ATTACKS
from veilmark.session import bounded_broadcast, checkpointed

M = "manifest_id"


def five_attacks(units: DataFrame, texts: DataFrame, roles: DataFrame, training: DataFrame, target_size: int, shadow_size: int, groups: int = 10, top_k: int = 20_000) -> DataFrame:
    """(run_id, manifest_id, attack, site_id, is_member, score) of the five attacks in every manifest.

    units: site_id, unit, cnt; texts: site_id, text; roles: manifest_id, role, site_id; training: manifest_id, shadow_id,
    site_id. Targets are trained on the member sites, shadows on their training sites. ``groups``: shadow plans whose sites
    are the background. The power law is fitted for each manifest on its first shadow. Sites of the target pool without
    texts, and for the shadow attacks those without shadows on both sides, are left out.
    """
    units = checkpointed(units)
    pool = checkpointed(roles.where("role = 'target_pool'").select(M, "site_id").distinct())
    members = roles.where("role = 'target_member'").select(M, "site_id", F.lit(True).alias("is_member")).distinct()
    target = checkpointed(bpe.train_target(units, roles, target_size))
    shadows = checkpointed(bpe.train_shadows(units, training, shadow_size))
    vocab, shadow_vocab = bpe.vocabularies(target, M), bpe.vocabularies(shadows, M, "shadow_id")
    present = checkpointed(pool.join(units.select("site_id").distinct(), "site_id"))
    in_pool = units.join(present, "site_id")
    encoded = bpe.encode_each(in_pool, target, M)
    scores = {"compression_rate": attacks.compression_scores(texts.join(present.select("site_id").distinct(), "site_id", "left_semi"), bpe.tokens_by(in_pool, encoded, M, "site_id"), M)}
    scores["vocabulary_overlap"] = attacks.overlap_scores(vocab, shadow_vocab, training, present, M)
    scores["merge_similarity"] = attacks.merge_similarity_scores(attacks.rank_correlations(vocab, shadow_vocab, M), training, present, M)
    involved = training.where(F.col("shadow_id") < groups).select(M, "site_id").distinct()
    first = shadow_vocab.where("shadow_id = 0").select(M, "token", "id")
    known = vocab.select("token").unionByName(first.select("token"))
    counts = checkpointed(tokens.token_counts(units, tokens.substring_tokens(units, known), "site_id"))
    own = counts.join(present.unionByName(involved).distinct(), "site_id").join(vocab.select(M, "token"), [M, "token"], "left_semi")
    own = checkpointed(own)
    background = checkpointed(tokens.background_counts(own, involved, M))
    fit_sites = training.where("shadow_id = 0").select(M, "site_id").distinct()
    fits = attacks.fit_zipf(first, counts.join(fit_sites, "site_id").groupBy(M, "token").agg(F.sum("cnt").alias("cnt")), M)
    at_sites = own.join(present, [M, "site_id"], "left_semi")
    scores["frequency_estimation"] = attacks.frequency_scores(at_sites, background, involved, vocab, present, fits, M)
    scores["naive_bayes"] = attacks.naive_bayes_scores(at_sites, background, involved, vocab, present, top_k, M)
    return _labelled(reduce(DataFrame.unionByName, [scores[a].select(M, F.lit(a).alias("attack"), "site_id", "score") for a in ATTACKS]), members)


def _labelled(rows: DataFrame, members: DataFrame) -> DataFrame:
    run = F.concat(F.lit("run_"), F.col(M).cast("string"), F.lit("_"), F.col("attack"))
    return rows.join(members, [M, "site_id"], "left").select(run.alias("run_id"), M, "attack", "site_id", F.coalesce("is_member", F.lit(False)).alias("is_member"), "score")


def packed_attacks(bags: DataFrame, texts: DataFrame, roles: DataFrame, training: DataFrame, target_size: int, shadow_size: int, groups: int = 10, top_k: int = 20_000) -> DataFrame:
    """five_attacks from the bags of the sites (of unitbags.site_bags): a manifest is attacked where its bin's bags meet."""
    parts = gathered.members(roles).unionByName(gathered.pool(roles)).unionByName(gathered.shadows(training))
    split, large = gathered.split(bags, parts)

    def run(own: gathered.Bin) -> Iterator[pa.RecordBatch]:
        for manifest in own.parts:
            rows = binattacks.scores(own, manifest, target_size, shadow_size, groups, top_k)
            attack, site, score = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([manifest] * len(rows), pa.int64()), pa.array(attack, pa.string()), pa.array(site, pa.string()), pa.array(score, pa.float64())], names=[M, "attack", "site_id", "score"])

    rows = bags.select("site_id", "bag").join(bounded_broadcast(split), "site_id").select("bin", "site_id", "held", "bag")
    found = checkpointed(gathered.each_bin(rows, run, f"{M} bigint, attack string, site_id string, score double"))
    by_site = found.where("attack = 'compression_rate'").select(M, "site_id", F.col("score").cast("bigint").alias("tokens"))
    rates = attacks.compression_scores(texts.join(by_site.select("site_id").distinct(), "site_id", "left_semi"), by_site, M)
    scored = found.where("attack <> 'compression_rate'").unionByName(rates.select(M, F.lit("compression_rate").alias("attack"), "site_id", "score"))
    members = roles.where("role = 'target_member'").select(M, "site_id", F.lit(True).alias("is_member")).distinct()
    out = _labelled(scored, members)
    if large:
        units = unitbags.unit_rows(bags.join(gathered.of(parts, large).select("site_id").distinct(), "site_id", "left_semi"))
        out = out.unionByName(five_attacks(units, texts, gathered.of(roles, large), gathered.of(training, large), target_size, shadow_size, groups, top_k))
    return out

"""Private training of a vocabulary: public candidates, private vectors, one aggregation a round, compatible merges.

A training reads packed bags of its sites' units; each pass applies the merges so far where it reads a bag, and no words are
written. The driver holds the candidate list (K rows) and the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators import bagpairs, paillier, privacy, tokens, unitbags
from veilmark.operators.bpe import Tokenizer, merge_pair
from veilmark.operators.tokens import SPECIAL_TOKENS
from veilmark.session import checkpointed

MODES = ("plain", "local_dp", "he_only", "sa_dp")


def _touched(merges: list[tuple[str, str]]):
    """Whether a word holds one of the pairs."""
    adjacent = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda k: F.concat_ws("\0", F.element_at("symbols", k), F.element_at("symbols", k + 1)))
    pairs = F.when(F.size("symbols") > 1, adjacent).otherwise(F.array().cast("array<string>"))
    return F.arrays_overlap(pairs, F.array(*[F.lit(f"{a}\0{b}") for a, b in merges]))


def _rewritten(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    table = {m: m[0] + m[1] for m in merges}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(symbols=[merge_pair(list(s), table) for s in rows["symbols"]])

    return words.mapInPandas(run, words.schema)


def apply_merges(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """words(keys..., symbols, freq) after the merges; only affected words pass through Python."""
    hit = _touched(merges)
    return words.where(~hit).unionByName(_rewritten(words.where(hit), merges))


def merge_round(words: DataFrame, counts: DataFrame, merges: list[tuple[str, str]], *keys: str) -> tuple[DataFrame, DataFrame]:
    """Words (keys..., symbols, freq) and their pair counts (keys..., left, right, cnt) after the merges. Only the pairs of
    the words that hold one are counted again: what they had is taken off, what they have now is added."""
    hit = _touched(merges)
    old = checkpointed(words.where(hit))
    new = checkpointed(_rewritten(old, merges))
    change = tokens.symbol_pairs(new, *keys).unionByName(tokens.symbol_pairs(old.withColumn("freq", -F.col("freq")), *keys))
    counted = counts.unionByName(change).groupBy(*keys, "left", "right").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
    return checkpointed(words.where(~hit).unionByName(new)), checkpointed(counted)


def aggregate_round(vectors: DataFrame, pairs: list[tuple[str, str]], mode: str, batch: int, bound: int, epsilon: float | None, rng: np.random.Generator, keys: paillier.PrivateKey | None = None) -> tuple[list[int], dict]:
    """Indices of the chosen candidates. vectors: (site_id, coord, value).

    plain and he_only sum unclipped vectors without noise; local_dp adds one draw a client and coordinate to clipped
    vectors, where the client's rows are; sa_dp one draw on the sum. With keys the sum of he_only and sa_dp is formed on
    ciphertexts.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    spark = vectors.sparkSession
    k = len(pairs)
    used = privacy.l1_clip(vectors, bound) if mode in ("local_dp", "sa_dp") else vectors
    noise: list[int] = []
    if mode == "local_dp":
        used = privacy.client_noise(used, epsilon, bound, int(rng.integers(1 << 62)))
    if mode == "sa_dp":
        noise = privacy.two_sided_geometric(epsilon, bound, k, rng)
    if keys is not None and mode in ("he_only", "sa_dp"):
        sums = paillier.encrypted_sums(paillier.encrypted(used.select(F.col("coord").cast("int"), "value"), keys.public), keys.public)
        if noise:
            sums = paillier.add_encrypted_noise(sums, spark.createDataFrame(list(enumerate(noise)), "coord int, value bigint"), keys.public)
        values = paillier.decrypted(sums, keys)
    else:
        values = [int(r["value"]) for r in privacy.coordinate_sums(used).orderBy("coord").collect()]
        values = [v + e for v, e in zip(values, noise)] if noise else values
    return privacy.compatible_top(values, pairs, batch), {"noise_l1": sum(map(abs, noise)), "clients_sum": sum(values)}


def rounds_by_mode(vectors: DataFrame, candidates: DataFrame, bounds: DataFrame, batch: int, epsilon: float, seed: int, *keys: str) -> DataFrame:
    """(keys..., mode, place, left, right): one round of every mode for each value of the keys.

    vectors: keys..., site_id, coord, value; candidates: keys..., coord, left, right; bounds: keys..., bound. An experiment's
    candidate list, a few rows, is one task.
    """
    clipped = checkpointed(privacy.l1_clip(vectors, bounds, *keys))
    noisy = privacy.client_noise(clipped, epsilon, bounds, seed, *keys)
    sums = {m: privacy.coordinate_sums(v, *keys) for m, v in (("plain", vectors), ("local_dp", noisy), ("sa_dp", clipped))}
    sums["he_only"] = sums["plain"]
    rows = reduce(DataFrame.unionByName, [sums[m].withColumn("mode", F.lit(m)) for m in MODES])
    rows = rows.join(F.broadcast(candidates.select(*keys, "coord", "left", "right")), [*keys, "coord"]).join(F.broadcast(bounds), list(keys))
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("coord")
        mode, own = pdf["mode"].iloc[0], tuple(pdf[list(keys)].iloc[0])
        values = [int(v) for v in pdf["value"]]
        if mode == "sa_dp":
            draw = privacy.two_sided_geometric(epsilon, int(pdf["bound"].iloc[0]), len(values), privacy.stable_generator(seed, *own))
            values = [v + e for v, e in zip(values, draw)]
        pairs = list(zip(pdf["left"], pdf["right"]))
        chosen = privacy.compatible_top(values, pairs, batch)
        return pd.DataFrame([(*own, mode, n, *pairs[k]) for n, k in enumerate(chosen)], columns=[*keys, "mode", "place", "left", "right"])

    return rows.groupBy(*keys, "mode").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", mode string, place int, left string, right string")


@dataclass
class PrivateTraining:
    """A training; ``advance`` runs one round and returns False at the end. ``state`` is all that a resumed training
    needs besides its inputs: the merges of each round, the spent budgets and the generator."""

    public: DataFrame  # (site_id, unit, cnt), or bags as of unitbags.site_bags
    private: DataFrame
    vocab_size: int
    mode: str = "plain"
    pool: int = 1024
    batch: int = 32
    epsilon: float | None = None
    clip_quantile: float = 0.75
    seed: int = 0
    keys: paillier.PrivateKey | None = None
    rounds_done: list[list[tuple[str, str]]] = field(default_factory=list)
    budgets: list[float] = field(default_factory=list)
    generator: dict | None = None

    def __post_init__(self) -> None:
        shared = self.public.select("site_id").distinct().join(self.private.select("site_id").distinct(), "site_id", "left_semi")
        if shared.limit(1).count():
            raise ValueError("public and private sites overlap")
        if self.mode in ("local_dp", "sa_dp") and not self.epsilon:
            raise ValueError("a private mode needs epsilon")
        self.bags = [x.select("site_id", "bag") if "bag" in x.columns else unitbags.bags_of_units(x).select("site_id", "bag") for x in (self.public, self.private)]
        letters = bagpairs.letters(self.bags[0])
        self.vocab = {t: k for k, t in enumerate([*SPECIAL_TOKENS, *letters])}
        self.rounds = max(1, math.ceil((self.vocab_size - len(self.vocab)) / self.batch))
        self.rng = np.random.default_rng(np.random.SeedSequence([self.seed, MODES.index(self.mode), int(1000 * (self.epsilon or 0))]))
        if self.generator:
            self.rng.bit_generator.state = self.generator
        for a, b in self.merges:
            self.vocab.setdefault(a + b, len(self.vocab))

    @property
    def merges(self) -> list[tuple[str, str]]:
        return [m for merges in self.rounds_done for m in merges]

    def state(self) -> dict:
        return {"rounds_done": [list(r) for r in self.rounds_done], "budgets": list(self.budgets), "generator": self.rng.bit_generator.state}

    def advance(self) -> bool:
        if len(self.vocab) >= self.vocab_size or len(self.rounds_done) >= self.rounds:
            return False  # a budget is divided by the planned rounds: no more are run
        spark = self.public.sparkSession
        known = spark.createDataFrame([(t,) for t in self.vocab], "token string")
        candidates = tokens.top_pairs(bagpairs.pair_counts(self.bags[0], self.rounds_done), known, self.pool)
        pairs = [(r["left"], r["right"]) for r in candidates.orderBy("coord").collect()]
        if not pairs:
            return False
        bound = privacy.clip_bound(bagpairs.vectors(self.bags[0], self.rounds_done, pairs, norms=True), self.clip_quantile).first()["bound"]
        vectors = bagpairs.vectors(self.bags[1], self.rounds_done, pairs)
        budget = privacy.round_budget(self.epsilon, self.rounds) if self.mode in ("local_dp", "sa_dp") else None
        room = self.vocab_size - len(self.vocab)
        chosen, _ = aggregate_round(vectors, pairs, self.mode, min(self.batch, room), bound, budget, self.rng, self.keys)
        if not chosen:
            return False
        merges = [pairs[k] for k in chosen]
        for a, b in merges:
            self.vocab.setdefault(a + b, len(self.vocab))
        self.rounds_done.append(merges)
        self.budgets += [budget] if budget else []
        return True

    def run(self) -> Tokenizer:
        while self.advance():
            pass
        return Tokenizer(self.vocab, self.merges)

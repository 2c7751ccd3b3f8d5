"""Byte-pair vocabularies over Whitespace-style units: training, deriving, encoding.

Spark reduces the corpus to distinct units with frequencies; merges are learned over those (a vocabulary's worth of
driver state), and encoding runs once for each distinct unit and is joined back.
"""

from __future__ import annotations

import heapq
import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.operators import tokens
from veilmark.operators.tokens import SPECIAL_TOKENS
from veilmark.session import checkpointed
from veilmark.sources.tables import canonical_digest, load_json, publish_json

#: Distinct units up to which a vocabulary is learned in one process (about 300 bytes each); more stay in Spark and are
#: learned in rounds, with the same result.
LOCAL_UNITS = 2_000_000


@dataclass
class Tokenizer:
    """Vocabulary and ordered merges."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]

    def __post_init__(self) -> None:
        self.ranks = {m: k for k, m in enumerate(self.merges)}

    def encode_unit(self, unit: str) -> list[str]:
        """Lowest-rank merge first, leftmost first; unknown characters become ``[UNK]``."""
        symbols = list(unit)
        while len(symbols) > 1:
            rank, place = min(((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:]))))
            if rank == 1 << 60:
                break
            symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]
        return [s if s in self.vocab else "[UNK]" for s in symbols]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(token, id) and (pos, left, right)."""
        return (
            spark.createDataFrame(sorted(self.vocab.items(), key=lambda x: x[1]), "token string, id int"),
            spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(self.merges)], "pos int, left string, right string"),
        )

    @staticmethod
    def from_tables(vocab: DataFrame, merges: DataFrame) -> Tokenizer:
        return Tokenizer({r["token"]: r["id"] for r in vocab.collect()}, [(r["left"], r["right"]) for r in merges.orderBy("pos").collect()])


def learn_merges(units: dict[str, int], vocab_size: int, min_pairs: int = 2, special: tuple[str, ...] = SPECIAL_TOKENS) -> Tokenizer:
    """Merges by pair count; ties by left, then right. Counts are kept up to date by the units a merge touches."""
    vocab = {t: k for k, t in enumerate([*special, *sorted({c for u in units for c in u})])}
    words = [list(u) for u in units]
    freq = list(units.values())
    counts: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for w, symbols in enumerate(words):
        for p in zip(symbols, symbols[1:]):
            counts[p] += freq[w]
            where[p].add(w)
    heap = [(-n, p) for p, n in counts.items()]
    heapq.heapify(heap)
    merges = []
    while heap and len(vocab) < vocab_size:
        n, pair = heapq.heappop(heap)
        if counts[pair] != -n:
            if counts[pair] > 0:
                heapq.heappush(heap, (-counts[pair], pair))
            continue
        if -n < min_pairs:
            break
        merges.append(pair)
        product = pair[0] + pair[1]
        vocab.setdefault(product, len(vocab))
        changed = set()
        for w in where.pop(pair):
            old = words[w]
            for p in zip(old, old[1:]):
                counts[p] -= freq[w]
                changed.add(p)
            words[w] = new = merge_pair(old, {pair: product})
            for p in zip(new, new[1:]):
                counts[p] += freq[w]
                where[p].add(w)
                changed.add(p)
        counts.pop(pair, None)
        for p in changed:
            if p != pair and counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
    return Tokenizer(vocab, merges)


def merge_pair(symbols: list[str], replacements: dict[tuple[str, str], str]) -> list[str]:
    """Left-to-right, non-overlapping rewrite of adjacent pairs."""
    out, k = [], 0
    while k < len(symbols):
        product = replacements.get((symbols[k], symbols[k + 1])) if k + 1 < len(symbols) else None
        out.append(symbols[k] if product is None else product)
        k += 1 if product is None else 2
    return out


def train(unit_counts: DataFrame, vocab_size: int, local_units: int | None = None) -> Tokenizer:
    """A base tokenizer from (unit, cnt), over all units; null units are left out."""
    limit = LOCAL_UNITS if local_units is None else local_units
    total = checkpointed(unit_counts.where("unit IS NOT NULL").groupBy("unit").agg(F.sum("cnt").alias("cnt")))
    if total.limit(limit + 1).count() <= limit:
        return learn_merges({r["unit"]: r["cnt"] for r in total.toLocalIterator(True)}, vocab_size)
    return learn_in_rounds(total, vocab_size)


def sure_prefix(pairs: list[tuple[int, str, str]]) -> int:
    """How many of the most frequent pairs (cnt, left, right), in order, are the next merges whatever they change.

    A merge changes only counts of pairs that share a symbol with it, and what it makes is no more frequent than one of
    those. So pairs that share no symbol with each other are sure while they are more frequent than the first that does.
    """
    used: set[str] = set()
    cut = 0
    for _, left, right in pairs:
        if {left, right, left + right} & used:
            break
        used |= {left, right, left + right}
        cut += 1
        if left == right:  # it overlaps itself, and what it makes may come next
            break
    unseen = pairs[min(cut, len(pairs) - 1)][0] if pairs else 0
    return min(len(pairs), max(1, sum(n > unseen for n, _, _ in pairs[:cut])))


def learn_in_rounds(units: DataFrame, vocab_size: int, min_pairs: int = 2, special: tuple[str, ...] = SPECIAL_TOKENS, look: int = 256) -> Tokenizer:
    """learn_merges with the words and their pair counts in Spark; a round makes all merges that are sure and recounts only
    the words they touch. units: unit, cnt, distinct. The driver holds the vocabulary and ``look`` pairs."""
    from veilmark.operators.private_bpe import merge_round

    letters = [r[0] for r in tokens.alphabet(units, ()).orderBy("token").select("token").collect()]  # an alphabet is small
    vocab = {t: k for k, t in enumerate([*special, *letters])}
    words = checkpointed(tokens.words_of(units).select("symbols", "freq"))
    counts = checkpointed(tokens.symbol_pairs(words))
    merges: list[tuple[str, str]] = []
    while len(vocab) < vocab_size:
        top = [(r["cnt"], r["left"], r["right"]) for r in counts.where(F.col("cnt") >= min_pairs).orderBy(F.desc("cnt"), "left", "right").limit(look).collect()]
        if not top:
            break
        now = []
        for _, left, right in top[: sure_prefix(top)]:
            if len(vocab) < vocab_size:
                now.append((left, right))
                vocab.setdefault(left + right, len(vocab))
        merges += now
        words, counts = merge_round(words, counts, now)
    return Tokenizer(vocab, merges)


def train_each(unit_counts: DataFrame, vocab_size: int, *keys: str) -> DataFrame:
    """(keys..., kind, n, token, left, right): a tokenizer for each value of the keys, its tokens with their ids and its
    merges with their places. unit_counts: keys..., unit, cnt.

    A tokenizer of at most LOCAL_UNITS distinct units is learned in one task; larger ones in rounds over all tasks.
    """
    totals = checkpointed(unit_counts.where("unit IS NOT NULL").groupBy(*keys, "unit").agg(F.sum("cnt").alias("cnt")))
    large = totals.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_UNITS).select(*keys).collect()  # few
    kinds = dict(totals.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", kind string, n int, token string, left string, right string"

    def rows_of(t: Tokenizer) -> list[tuple]:
        return [("token", k, w, None, None) for w, k in t.vocab.items()] + [("merge", k, a + b, a, b) for k, (a, b) in enumerate(t.merges)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        found = pd.DataFrame(rows_of(learn_merges(dict(zip(pdf["unit"], pdf["cnt"])), vocab_size)), columns=["kind", "n", "token", "left", "right"])
        for c in keys:
            found[c] = pdf[c].iloc[0]
        return found[[*keys, "kind", "n", "token", "left", "right"]]

    spark = unit_counts.sparkSession
    small = totals
    if large:
        small = totals.join(F.broadcast(spark.createDataFrame(large, totals.select(*keys).schema)), list(keys), "left_anti")
    out = small.groupBy(*keys).applyInPandas(run, schema)
    for key in large:
        own = totals.where(reduce(lambda a, b: a & b, [F.col(c) == key[c] for c in keys]))
        t = learn_in_rounds(own.select("unit", "cnt"), vocab_size)
        out = out.unionByName(spark.createDataFrame([(*key, *r) for r in rows_of(t)], schema))
    return out


def vocabularies(tokenizers: DataFrame, *keys: str) -> DataFrame:
    """(keys..., token, id) of the tokenizers of train_each."""
    return tokenizers.where("kind = 'token'").select(*keys, "token", F.col("n").alias("id"))


def encode_each(units: DataFrame, tokenizers: DataFrame, *keys: str, blocks: int = 8) -> DataFrame:
    """(keys..., unit, tokens) of the distinct units of each key by its tokenizer; the units of a key in several blocks."""
    cut = units.select(*keys, "unit").distinct().withColumn("_block", F.pmod(F.xxhash64("unit"), F.lit(blocks)))
    each = tokenizers.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    kinds = dict(units.dtypes)

    def run(units_: pd.DataFrame, tokenizer: pd.DataFrame) -> pd.DataFrame:
        ordered = tokenizer.sort_values("n")
        own, merges = ordered[ordered["kind"] == "token"], ordered[ordered["kind"] == "merge"]
        t = Tokenizer(dict(zip(own["token"], own["n"])), list(zip(merges["left"], merges["right"])))
        return units_[[*keys, "unit"]].assign(tokens=[t.encode_unit(u) for u in units_["unit"]])

    on = [*keys, "_block"]
    return cut.groupBy(*on).cogroup(each.groupBy(*on)).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", unit string, tokens array<string>")


def provenance(tokenizer: Tokenizer, method: str, requested: int, **given: object) -> dict:
    """Metadata of a tokenizer artifact: method, sizes, its digest and what it was derived from."""
    artifact = {"vocab": tokenizer.vocab, "merges": [list(m) for m in tokenizer.merges]}
    return {"method": method, "requested_vocab_size": requested, "actual_vocab_size": len(tokenizer.vocab), "merges": len(tokenizer.merges), "artifact_sha256": canonical_digest(artifact), **given}


def publish(tokenizer: Tokenizer, folder: str, method: str, requested: int, **given: object) -> dict:
    """Writes tokenizer.json and metadata.json; an artifact that exists is never overwritten."""
    os.makedirs(folder, exist_ok=True)
    metadata = provenance(tokenizer, method, requested, **given)
    publish_json(f"{folder}/tokenizer.json", {"vocab": tokenizer.vocab, "merges": [list(m) for m in tokenizer.merges]})
    publish_json(f"{folder}/metadata.json", metadata)
    return metadata


def load(folder: str, **expected: object) -> tuple[Tokenizer, dict]:
    """A published tokenizer; a changed artifact or metadata other than expected is an error."""
    content, metadata = load_json(f"{folder}/tokenizer.json"), load_json(f"{folder}/metadata.json")
    if canonical_digest(content) != metadata["artifact_sha256"]:
        raise ValueError(f"the artifact in {folder} does not match its digest")
    wrong = {k: metadata.get(k) for k, v in expected.items() if metadata.get(k) != v}
    if wrong:
        raise ValueError(f"the metadata in {folder} has {wrong}")
    return Tokenizer(content["vocab"], [tuple(m) for m in content["merges"]]), metadata


def train_target(units: DataFrame, manifest: DataFrame, vocab_size: int) -> DataFrame:
    """Target tokenizers (as train_each, by manifest_id) over the member sites; units: site_id, unit, cnt; manifest:
    (manifest_id, role, site_id)."""
    members = manifest.where("role = 'target_member'").select("manifest_id", "site_id").distinct()
    return train_each(units.join(members, "site_id"), vocab_size, "manifest_id")


def train_shadows(units: DataFrame, training: DataFrame, vocab_size: int) -> DataFrame:
    """Shadow tokenizers (by manifest_id, shadow_id) over the training sites (manifest_id, shadow_id, site_id)."""
    return train_each(units.join(training.distinct(), "site_id"), vocab_size, "manifest_id", "shadow_id")


def derive_each(tokenizers: DataFrame, vocab: DataFrame, *keys: str) -> DataFrame:
    """Tokenizers (as train_each) with another vocabulary (keys..., token, id) and the merges that survive in it."""
    merges = tokenizers.where("kind = 'merge'").select(*keys, F.col("n").alias("coord"), "left", "right")
    kept = tokens.valid_merges(merges, vocab, *keys)
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("coord")) - 1).alias("n")
    none = F.lit(None).cast("string")
    named = vocab.select(*keys, F.lit("token").alias("kind"), F.col("id").cast("int").alias("n"), "token", none.alias("left"), none.alias("right"))
    return named.unionByName(kept.select(*keys, F.lit("merge").alias("kind"), place, F.concat("left", "right").alias("token"), "left", "right"))


def truncate(base: Tokenizer, size: int) -> Tokenizer:
    """The lowest ids and the merges that survive."""
    vocab = {t: k for k, (t, _) in enumerate(sorted(base.vocab.items(), key=lambda x: x[1])[:size])}
    return Tokenizer(vocab, surviving(base.merges, vocab))


def min_count(base: Tokenizer, counts: dict[str, int], least: int) -> Tokenizer:
    """Special tokens and tokens of at least that count."""
    kept = [t for t, _ in sorted(base.vocab.items(), key=lambda x: x[1]) if t in SPECIAL_TOKENS or counts.get(t, 0) >= least]
    kept = kept if "[UNK]" in kept else ["[UNK]", *kept]
    vocab = {t: k for k, t in enumerate(kept)}
    return Tokenizer(vocab, surviving(base.merges, vocab))


def surviving(merges: list[tuple[str, str]], vocab: dict[str, int]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in merges if a in vocab and b in vocab and a + b in vocab]


def encode_units(units: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(unit, tokens) for each distinct unit."""
    shared = units.sparkSession.sparkContext.broadcast((tokenizer.vocab, tokenizer.merges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokenizer(*shared.value)
        for rows in batches:
            yield pd.DataFrame({"unit": rows["unit"], "tokens": [t.encode_unit(u) for u in rows["unit"]]})

    return units.select("unit").distinct().mapInPandas(run, "unit string, tokens array<string>")


def tokens_by(counts: DataFrame, encoded: DataFrame, *keys: str) -> DataFrame:
    """(keys..., tokens): token totals from unit counts; encoded: unit, tokens and keys of its own, if any."""
    on = [c for c in encoded.columns if c != "tokens"]
    return counts.join(encoded.select(*on, F.size("tokens").alias("_n")), on).groupBy(*keys).agg(F.sum(F.col("cnt") * F.col("_n")).alias("tokens"))


def utility(texts: DataFrame, encode: Tokenizer | Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """Eleven corpus measures of a tokenizer over (keys..., idx, text), one row a key. Rare words occur at most twice.

    encode: a tokenizer, or what gives (keys..., unit, tokens) of (keys..., unit). Null texts are left out.
    """
    docs = texts.where("text IS NOT NULL").select(*keys, "idx", "text")
    # sentences are cut once, whatever the keys; a mean over them needs only the totals of their units
    whole = docs.select("idx", "text").dropDuplicates(["idx"]) if keys else docs
    cut = whole.select("idx", T.sentence_list(F.col("text")).alias("parts"))
    cut = cut.select("idx", F.size("parts").alias("parts"), F.flatten(F.transform("parts", T.units)).alias("units"))
    in_sentences = checkpointed(docs.select(*keys, "idx").join(cut, "idx"))
    by_sentence = in_sentences.select(*keys, F.explode("units").alias("unit")).groupBy(*keys, "unit").agg(F.count("*").alias("cnt"))
    by_doc = docs.select(*keys, "idx", F.explode(T.units(F.col("text"))).alias("unit")).groupBy(*keys, "idx", "unit").agg(F.count("*").alias("cnt"))
    by_doc = checkpointed(by_doc)
    words = docs.select(*keys, F.explode(T.word_list(F.col("text"))).alias("unit")).groupBy(*keys, "unit").agg(F.count("*").alias("n")).where("n <= 2").select(*keys, "unit")
    needed = by_doc.select(*keys, "unit").unionByName(by_sentence.select(*keys, "unit")).unionByName(words)
    encoded = checkpointed(encode_units(needed, encode) if isinstance(encode, Tokenizer) else encode(needed))
    on = [*keys, "unit"]
    n_doc = docs.select(*keys, "idx").join(tokens_by(by_doc, encoded, *keys, "idx"), [*keys, "idx"], "left").fillna({"tokens": 0})
    n_sentence = in_sentences.groupBy(*keys).agg(F.sum("parts").alias("sentences"))
    all_sentences = tokens_by(by_sentence, encoded, *keys).withColumnRenamed("tokens", "_all")
    n_sentence = n_sentence.join(all_sentences, list(keys), "left") if keys else n_sentence.crossJoin(all_sentences)
    parts = [
        docs.groupBy(*keys).agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("characters")),
        n_doc.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.avg("tokens").alias("tokens_per_document"), F.median("tokens").alias("median_tokens_per_document")),
        n_sentence.select(*keys, "sentences", F.try_divide(F.coalesce("_all", F.lit(0)).cast("double"), "sentences").alias("tokens_per_sentence")),
        words.join(encoded, on).groupBy(*keys).agg(
            F.count("*").alias("rare_words"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("rare_split_length"),
            F.coalesce(F.avg(F.when((F.size("tokens") == 1) & (F.col("tokens")[0] != "[UNK]"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("rare_single_coverage"),
        ),
    ]
    row = reduce(lambda a, b: a.join(b, list(keys), "left") if keys else a.crossJoin(b), parts)  # one row a key each
    return row.withColumns({"bytes_per_token": F.col("bytes") / F.col("tokens"), "characters_per_token": F.col("characters") / F.col("tokens")})

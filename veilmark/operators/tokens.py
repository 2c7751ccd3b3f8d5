"""Unit, token, substring and pair statistics. Expensive steps run on distinct units, never on occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import text as T

SPECIAL_TOKENS = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")  # fixed values
#: Distinct tokens up to which they are sent to the tasks as an automaton; more are joined with the units' substrings.
AUTOMATON_TOKENS = 1_000_000


def unit_counts(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., unit, cnt); partial aggregation keeps the explosion map-side."""
    return df.select(*keys, F.explode(T.units(F.col("text"))).alias("unit")).groupBy(*keys, "unit").agg(F.count("*").alias("cnt"))


def word_frequencies(df: DataFrame) -> DataFrame:
    return df.select(F.explode(T.word_list(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def alphabet(units: DataFrame, special: tuple[str, ...] = SPECIAL_TOKENS, *keys: str) -> DataFrame:
    """(keys..., token, id): special tokens first, then the distinct characters in code-point order. An alphabet is small."""
    chars = units.select(*keys, F.explode(F.split("unit", "")).alias("token")).where("token <> ''").distinct()
    ranked = chars.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("token")) - 1 + len(special))
    first = units.select(*keys).distinct() if keys else units.sparkSession.range(1).select()
    named = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(k).alias("id")) for k, t in enumerate(special)])) if special else None
    return ranked if named is None else first.select(*keys, named.alias("x")).select(*keys, "x.token", "x.id").unionByName(ranked)


def symbol_pairs(words: DataFrame, *keys: str) -> DataFrame:
    """(keys..., left, right, cnt) of adjacent symbols inside words(keys..., symbols, freq)."""
    pair = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda k: F.struct(F.element_at("symbols", k).alias("left"), F.element_at("symbols", k + 1).alias("right")))
    rows = words.where(F.size("symbols") > 1).select(*keys, "freq", F.explode(pair).alias("p"))
    return rows.groupBy(*keys, F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("freq").alias("cnt"))


def words_of(units: DataFrame, *keys: str) -> DataFrame:
    """(keys..., unit, symbols, freq): units as lists of characters with their frequency."""
    return units.select(*keys, "unit", F.filter(F.split("unit", ""), lambda c: c != "").alias("symbols"), F.col("cnt").alias("freq"))


def pair_counts_two_levels(words: DataFrame) -> DataFrame:
    """Pair counts by site and over all sites (site_id null) by one rollup."""
    pair = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda k: F.struct(F.element_at("symbols", k).alias("left"), F.element_at("symbols", k + 1).alias("right")))
    rows = words.where(F.size("symbols") > 1).select("site_id", "freq", F.explode(pair).alias("p")).select("site_id", "freq", "p.left", "p.right")
    by_site = rows.groupBy("site_id", "left", "right").agg(F.sum("freq").alias("cnt"))  # before the grouping sets double the rows
    return by_site.groupingSets([["left", "right", "site_id"], ["left", "right"]], "left", "right", "site_id").agg(F.sum("cnt").alias("cnt")).select("site_id", "left", "right", "cnt")


def _top(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """df with ``_n`` from 0 in the order of cnt, then the other columns; the first ``size`` rows of each key. Ranks are
    pruned before the shuffle, so a key sends at most ``size`` rows a partition."""
    order = [F.desc("cnt"), *[c for c in df.columns if c not in (*keys, "cnt")]]
    if not keys:
        df = df.orderBy(*order).limit(size)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("_n") < size)


def top_pairs(pairs: DataFrame, vocab: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys..., coord, left, right, cnt): the most frequent pairs whose product is not in the vocabulary; ties by left, right."""
    totals = pairs.groupBy(*keys, "left", "right").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    fresh = totals.join(vocab.select(F.col("token").alias("_out")), F.concat("left", "right") == F.col("_out"), "left_anti")
    return _top(fresh, size, *keys).select(*keys, F.col("_n").alias("coord"), "left", "right", "cnt")


def candidate_vectors(pairs_by_site: DataFrame, sites: DataFrame, candidates: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, coord, value) with zeros: sites x candidates is the result itself; the candidate list is a bounded
    top-k of each key."""
    on = [*keys, "left", "right"]
    values = pairs_by_site.join(F.broadcast(candidates.select(*on, "coord")), on).select(*keys, "site_id", "coord", F.col("cnt").alias("value"))
    each = sites.select(*keys, "site_id").distinct()
    coords = F.broadcast(candidates.select(*keys, "coord"))
    grid = each.join(coords, list(keys)) if keys else each.crossJoin(coords)
    return grid.join(values, [*keys, "site_id", "coord"], "left").fillna({"value": 0})


def substring_tokens(units: DataFrame, vocab: DataFrame) -> DataFrame:
    """(unit, token): every vocabulary token that occurs in a unit, once a unit, tokens and units of any length.

    The distinct tokens are sent to the tasks as one automaton; more than AUTOMATON_TOKENS are joined with the substrings
    of the units, up to the length of the longest token.
    """
    distinct = units.select("unit").distinct()
    tokens = vocab.select("token").where("token <> ''").distinct()
    found = tokens.limit(AUTOMATON_TOKENS + 1).toArrow().column(0).to_pylist()
    if len(found) <= AUTOMATON_TOKENS:
        return _automaton(distinct, found)
    longest = tokens.agg(F.max(F.length("token"))).first()[0]
    starts = F.sequence(F.lit(1), F.length("unit"))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - i + 1)), lambda n: F.substring("unit", i, n))))
    return distinct.where("unit <> ''").select("unit", F.explode(F.array_distinct(grams)).alias("token")).join(tokens, "token").select("unit", "token")


def _automaton(units: DataFrame, tokens: list[str]) -> DataFrame:
    schema = pa.schema([("unit", pa.string()), ("token", pa.string())])
    vocabulary = units.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in vocabulary.value:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for batch in batches:
            own, found = [], []
            for unit in batch.column(0).to_pylist() if len(automaton) else ():
                tokens_ = {t for _, t in automaton.iter(unit)}
                own += [unit] * len(tokens_)
                found += tokens_
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(found, pa.string())], schema=schema)

    return units.mapInArrow(run, "unit string, token string")


def token_counts(counts: DataFrame, matches: DataFrame, *keys: str) -> DataFrame:
    """(keys..., token, cnt): each token once for every occurrence of a unit that holds it."""
    return counts.join(matches, "unit").groupBy(*keys, "token").agg(F.sum("cnt").alias("cnt"))


def background_counts(token_counts_by_site: DataFrame, involved: DataFrame, *keys: str) -> DataFrame:
    """(keys..., token, cnt) over the distinct involved sites (keys..., site_id)."""
    own = [*keys, "site_id"]
    return token_counts_by_site.join(involved.select(*own).distinct(), own, "left_semi").groupBy(*keys, "token").agg(F.sum("cnt").alias("cnt"))


def top_units_as_vocab(units: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys..., token, id): a pseudo tokenizer, the most frequent units, ties by unit; id is the rank from 0."""
    total = units.groupBy(*keys, "unit").agg(F.sum("cnt").alias("cnt"))
    return _top(total, size, *keys).select(*keys, F.col("unit").alias("token"), F.col("_n").alias("id"))


def truncated_vocab(vocab: DataFrame, size: int, *keys: str) -> DataFrame:
    """The lowest ids, numbered densely."""
    return vocab.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("id")) - 1).where(F.col("id") < size).select(*keys, "token", "id")


def min_count_vocab(vocab: DataFrame, counts: DataFrame, least: int | list[int], special: tuple[str, ...] = SPECIAL_TOKENS, *keys: str) -> DataFrame:
    """(keys..., token, id): special tokens and tokens of at least that count, numbered densely in the old order; ``[UNK]`` is
    added first if missing. A list of thresholds shares the one join with the counts and gives a column ``least``."""
    named = [*keys, "least"] if isinstance(least, list) else list(keys)
    each = F.explode(F.array(*[F.lit(x) for x in (least if isinstance(least, list) else [least])])).alias("least")
    with_counts = vocab.join(counts, [*keys, "token"], "left").select(*keys, "token", "id", "cnt", each)
    kept = with_counts.where(F.col("token").isin(*special) | (F.coalesce("cnt", F.lit(0)) >= F.col("least"))).select(*named, "token", "id")
    wanted = vocab.select(*keys).distinct() if keys else vocab.sparkSession.range(1).select()
    unknown = wanted.select(*keys, each).select(*named).withColumns({"token": F.lit("[UNK]"), "id": F.lit(-1)}).join(kept, [*named, "token"], "left_anti")
    return kept.unionByName(unknown).select(*named, "token", (F.row_number().over(Window.partitionBy(*named).orderBy("id")) - 1).alias("id"))


def valid_merges(merges: DataFrame, vocab: DataFrame, *keys: str) -> DataFrame:
    """Merges whose parts and product are all in the vocabulary."""
    tokens = vocab.select(*keys, "token").distinct()
    out = merges
    for side in ("left", "right"):
        out = out.join(tokens.withColumnRenamed("token", side), [*keys, side], "left_semi")
    return out.withColumn("token", F.concat("left", "right")).join(tokens, [*keys, "token"], "left_semi").drop("token")


def fixed_length(ids: DataFrame, length: int, cls: int, sep: int, pad: int, unk: int, vocab_size: int) -> DataFrame:
    """``ids`` as CLS + ids + SEP, cut to ``length`` with SEP kept, padded on the right; ids out of range become UNK."""
    known = F.transform("ids", lambda i: F.when((i < 0) | (i >= vocab_size), F.lit(unk)).otherwise(i))
    body = F.concat(F.array(F.lit(cls)), F.slice(known, 1, length - 2), F.array(F.lit(sep)))
    return ids.withColumn("ids", F.concat(body, F.array_repeat(F.lit(pad), length - F.size(body))))

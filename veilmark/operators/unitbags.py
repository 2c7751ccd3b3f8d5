"""Units of a site as one packed row, so that groups of sites (members of a manifest, shadows) are summed up where they meet.

A site stands in many groups, and a row a unit for each of them is many times the texts. A bag is a site's distinct units
with their counts, compressed; it is copied to the groups, and a group is summed up in the task that holds it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.session import bounded_broadcast, checkpointed

#: The target, and a shadow without a number, among the shadows of a manifest.
TARGET, UNNUMBERED = -(1 << 40), -(1 << 41)
#: Units that a task holds before it passes partial bags on.
HELD_UNITS = 400_000


def packed(held: Counter) -> bytes:
    units = sorted(held)
    names = "\n".join(units).encode()  # units have no white space
    raw = len(units).to_bytes(8, "little") + np.fromiter(map(held.__getitem__, units), "<i8", len(units)).tobytes() + names
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(bag: bytes) -> tuple[str, np.ndarray]:
    """Units in order, a line each, and their counts."""
    raw = pa.decompress(bag[8:], int.from_bytes(bag[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    return raw[8 + 8 * n :].decode(), np.frombuffer(raw, "<i8", n, 8)


def unpacked(bag: bytes) -> tuple[list[str], np.ndarray]:
    """Units in order and their counts."""
    units, counts = opened(bag)
    return units.split("\n") if len(counts) else [], counts


def add(held: Counter, bag: bytes) -> None:
    units, counts = unpacked(bag)
    get = held.get
    for u, n in zip(units, counts.tolist()):
        held[u] = get(u, 0) + n


_SCHEMA = pa.schema([("site_id", pa.string()), ("size", pa.int64()), ("bag", pa.binary())])


def _rows(sites: dict[str, Counter]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sites), pa.string()), pa.array([len(x) for x in sites.values()], pa.int64()), pa.array([packed(x) for x in sites.values()], pa.binary())], schema=_SCHEMA)


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    size = 0
    for batch in batches:
        for site, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(site, Counter()).update(units)
            size += len(units)
            if size > HELD_UNITS:
                yield _rows({s: x for s, x in held.items() if x})
                held, size = {}, 0
    yield _rows({s: x for s, x in held.items() if x})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial bags in the order of their sites."""
    site, parts = None, []

    def out() -> pa.RecordBatch:
        if len(parts) == 1:
            units, _ = unpacked(parts[0])
            return pa.RecordBatch.from_arrays([pa.array([site]), pa.array([len(units)], pa.int64()), pa.array(parts, pa.binary())], schema=_SCHEMA)
        held: Counter = Counter()
        for p in parts:
            add(held, p)
        return _rows({site: held})

    for batch in batches:
        for s, bag in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if s != site:
                if parts:
                    yield out()
                site, parts = s, []
            parts.append(bag)
    if parts:
        yield out()


def site_bags(texts: DataFrame) -> DataFrame:
    """(site_id, size, bag), checkpointed: a row for each site with units. texts: site_id, text."""
    kind = "site_id string, size bigint, bag binary"
    parts = texts.select("site_id", T.units(F.col("text")).alias("units")).where("site_id IS NOT NULL AND units IS NOT NULL").mapInArrow(_of_texts, kind)
    return checkpointed(parts.repartition("site_id").sortWithinPartitions("site_id").mapInArrow(_merged, kind))


def bags_of_units(units: DataFrame) -> DataFrame:
    """As site_bags, of (site_id, unit, cnt); units have no white space, null ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, Counter] = {}
            for site, unit, cnt in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(site, Counter())
                if unit is not None:
                    own[unit] += cnt
            yield _rows(held)

    parts = units.select("site_id", "unit", "cnt").where("site_id IS NOT NULL").mapInArrow(run, "site_id string, size bigint, bag binary")
    return checkpointed(parts.repartition("site_id").sortWithinPartitions("site_id").mapInArrow(_merged, "site_id string, size bigint, bag binary"))


def unit_rows(bags: DataFrame) -> DataFrame:
    """(site_id, unit, cnt) of bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for site, bag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units, counts = unpacked(bag)
                yield pa.RecordBatch.from_arrays([pa.array([site] * len(units), pa.string()), pa.array(units, pa.string()), pa.array(counts, pa.int64())], names=["site_id", "unit", "cnt"])

    return bags.select("site_id", "bag").mapInArrow(run, "site_id string, unit string, cnt bigint")


def grouped(bags: DataFrame, groups: DataFrame) -> DataFrame:
    """The bags of each group: groups' columns, size, bag. groups: keys..., site_id and more, distinct."""
    return bags.join(bounded_broadcast(groups), "site_id")


def _most(units: list[str], counts: np.ndarray, size: int) -> list[str]:
    """The most frequent units of a sum, ties by unit."""
    some = np.flatnonzero(counts)
    if len(some) > size:
        some = some[counts[some] >= np.partition(counts[some], len(some) - size)[len(some) - size]]
    return [units[k] for k in sorted(some.tolist(), key=lambda k: (-counts[k], units[k]))[:size]]


def top_units(bags: DataFrame, members: DataFrame, training: DataFrame, size: int, shadow_size: int) -> DataFrame:
    """(manifest_id, target, shadow_id, tokens), checkpointed: the most frequent units of a manifest's member sites (target)
    and of each shadow's training sites, in the order of their ids; as tokens.top_units_as_vocab.

    members: manifest_id, site_id; training: manifest_id, shadow_id, site_id. A manifest is one task: a site's bag goes there
    once, however many of its shadows have the site.
    """
    sides = members.select("manifest_id", F.lit(TARGET).alias("part"), "site_id")
    sides = sides.unionByName(training.select("manifest_id", F.coalesce(F.col("shadow_id").cast("bigint"), F.lit(UNNUMBERED)).alias("part"), "site_id"))
    groups = sides.groupBy("manifest_id", "site_id").agg(F.collect_set("part").alias("parts"))
    rows = grouped(bags, groups).select("manifest_id", "parts", "bag").repartition("manifest_id").sortWithinPartitions("manifest_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        sums: dict[int, np.ndarray] = {}
        last, begun = None, False

        def out() -> pa.RecordBatch:
            units, found = list(place), sorted(sums)
            lists = [_most(units, sums[k], size if k == TARGET else shadow_size) for k in found]
            return pa.RecordBatch.from_arrays([pa.array([last] * len(found), pa.int64()), pa.array([k == TARGET for k in found]), pa.array([None if k in (TARGET, UNNUMBERED) else k for k in found], pa.int32()), pa.array(lists, pa.list_(pa.string()))], names=["manifest_id", "target", "shadow_id", "tokens"])

        for batch in batches:
            for manifest, parts, bag in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and manifest != last:
                    yield out()
                    place.clear()
                    sums.clear()
                last, begun = manifest, True
                units, counts = unpacked(bag)
                at = np.fromiter((place.setdefault(u, len(place)) for u in units), np.int64, len(units))
                for k in parts:
                    own = sums.get(k)
                    if own is None or len(own) < len(place):
                        wider = np.zeros(2 * len(place) + 1000, np.int64)
                        if own is not None:
                            wider[: len(own)] = own
                        own = sums[k] = wider
                    own[at] += counts  # a bag's units are distinct
        if begun:
            yield out()

    return checkpointed(rows.mapInArrow(run, "manifest_id bigint, target boolean, shadow_id int, tokens array<string>"))


def target_rows(lists: DataFrame) -> DataFrame:
    """(manifest_id, token, id) of top_units."""
    return lists.where("target").select("manifest_id", F.posexplode("tokens").alias("id", "token")).select("manifest_id", "token", "id")


def shadow_rows(lists: DataFrame) -> DataFrame:
    """(manifest_id, shadow_id, token, id) of top_units."""
    return lists.where("NOT target").select("manifest_id", "shadow_id", F.posexplode("tokens").alias("id", "token")).select("manifest_id", "shadow_id", "token", "id")


def token_sums(tokens: list[str], bags: list[bytes]) -> Iterator[np.ndarray]:
    """Counts of the tokens in each bag by substrings: a token once for every occurrence of a unit that holds it."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, t in enumerate(tokens):
        if t:
            automaton.add_word(t, k)
    if not len(automaton):
        yield from (np.zeros(len(tokens), np.int64) for _ in bags)
        return
    automaton.make_automaton()
    known: dict[str, list[int]] = {}
    for bag in bags:
        units, counts = unpacked(bag)
        held = []
        for u in units:
            found = known.get(u)
            if found is None:
                found = known[u] = list({k for _, k in automaton.iter(u)})
            held.append(found)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        at = np.fromiter((k for x in held for k in x), np.int64, int(sizes.sum()))
        yield np.bincount(at, np.repeat(counts, sizes), len(tokens)).astype(np.int64)


def background(bags: DataFrame, vocab: DataFrame, involved: DataFrame, *keys: str) -> DataFrame:
    """(keys..., token, cnt), as tokens.background_counts: tokens (keys..., token) of each group in the units of its sites
    (keys..., site_id), counts over 0."""
    kinds = dict(vocab.dtypes)
    own = grouped(bags, involved.select(*keys, "site_id").distinct()).select(*keys, "bag")

    def run(bags_: pd.DataFrame, vocab_: pd.DataFrame) -> pd.DataFrame:
        total = sum(token_sums(list(vocab_["token"]), list(bags_["bag"])), np.zeros(len(vocab_), np.int64))
        return vocab_.assign(cnt=total)[total > 0][[*keys, "token", "cnt"]]

    return own.groupBy(*keys).cogroup(vocab.select(*keys, "token").groupBy(*keys)).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "token")) + ", cnt bigint")


def frequency_scores(bags: DataFrame, background_: DataFrame, rarity: DataFrame, involved: DataFrame, sites: DataFrame, *keys: str) -> DataFrame:
    """(keys..., site_id, score), as attacks.frequency_scores, with the sites' tokens counted where they are scored.

    background_: keys..., token, cnt; rarity: keys..., token, rarity; involved, sites: keys..., site_id, sites those with units.
    """
    own = [*keys, "site_id"]
    kinds = dict(sites.dtypes)
    inside = involved.select(*own, F.lit(True).alias("inside")).distinct()
    scored = sites.select(*own).distinct().join(inside, own, "left").select(*own, F.coalesce("inside", F.lit(False)).alias("inside"))
    signals = rarity.join(background_, [*keys, "token"]).select(*keys, "token", "rarity", F.col("cnt").alias("bg"))

    def run(bags_: pd.DataFrame, signals_: pd.DataFrame) -> pd.DataFrame:
        rare, bg = signals_["rarity"].to_numpy(float), signals_["bg"].to_numpy(np.int64)
        scores = []
        for n, inside_ in zip(token_sums(list(signals_["token"]), list(bags_["bag"])), bags_["inside"]):
            some = n > 0
            denominator = (bg if inside_ else bg + n)[some]
            scores.append((n[some] / denominator * rare[some]).max() if some.any() else 0.0)
        return bags_.assign(score=scores)[[*own, "score"]]

    made = grouped(bags, scored).select(*own, "inside", "bag").groupBy(*keys).cogroup(signals.groupBy(*keys))
    return made.applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in own) + ", score double")

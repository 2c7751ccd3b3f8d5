"""Tokenizers of manifests, trained and used where the bags of their sites meet.

Manifests are dealt into bins, a bin is one task. A site's bag goes to a bin once, however many manifests of the bin hold the
site, so a site of most manifests is not copied to each of them. Manifests of more than bpe.LOCAL_UNITS units are left to the
functions of bpe, whose rows are spread over all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.operators import bpe, flat
from veilmark.operators.bpe import Tokenizer
from veilmark.operators.unitbags import HELD_UNITS, TARGET, UNNUMBERED, packed, unit_rows, unpacked
from veilmark.session import bounded_broadcast, checkpointed

#: Part of a manifest besides its target (the member sites) and its shadows: the sites that are scored.
POOL = -(1 << 42)
#: Manifests of a bin and units of its bags, about.
BIN_MANIFESTS, BIN_UNITS = 32, 4_000_000
#: Letters of a unit that is encoded by itself, at most.
UNIT_LETTERS = 40


def members(manifest: DataFrame) -> DataFrame:
    """(manifest_id, site_id, part) of the member sites."""
    return manifest.where("role = 'target_member'").select("manifest_id", "site_id", F.lit(TARGET).alias("part"))


def pool(manifest: DataFrame, role: str = "target_pool") -> DataFrame:
    return manifest.where(F.col("role") == role).select("manifest_id", "site_id", F.lit(POOL).alias("part"))


def shadows(training: DataFrame) -> DataFrame:
    return training.select("manifest_id", "site_id", F.coalesce(F.col("shadow_id").cast("bigint"), F.lit(UNNUMBERED)).alias("part"))


@dataclass
class Bin:
    """Units of all bags of a bin, once; the sites of each manifest's parts."""

    place: dict[str, int] = field(default_factory=dict)
    bags: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by site: units, counts
    parts: dict[int | None, dict[int, list[str]]] = field(default_factory=dict)  # by manifest and part: sites
    _flat: tuple[np.ndarray, np.ndarray] | None = None
    _names: list[str] = field(default_factory=list)

    def names(self) -> list[str]:
        """The units by number."""
        if len(self._names) < len(self.place):
            self._names = list(self.place)
        return self._names

    def numbers(self, units: list[str]) -> np.ndarray:
        place = self.place
        return np.fromiter((place.setdefault(u, len(place)) for u in units), np.int32, len(units))

    def take(self, site: str, held: list[dict], bag: bytes) -> None:
        units, counts = unpacked(bag)
        self.bags[site] = self.numbers(units), counts
        self.hold(site, held)

    def hold(self, site: str, held: list[dict]) -> None:
        for x in held:
            own = self.parts.setdefault(x["manifest_id"], {})
            for part in x["parts"]:
                own.setdefault(part, []).append(site)

    def sums(self, sites: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of the sites and their counts."""
        if len(sites) == 1:
            return self.bags[sites[0]]
        total = np.zeros(len(self.place), np.int64)
        for s in sites:
            at, counts = self.bags[s]
            total[at] += counts  # a bag's units are distinct
        some = np.flatnonzero(total)
        return some, total[some]

    def flat(self, some: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._flat is None or len(self._flat[1]) < len(self.place):
            self._flat = flat.flat(list(self.place))
        return flat.chosen(*self._flat, some, counts)

    def trained(self, sites: list[str], vocab_size: int) -> Tokenizer:
        codes, _, weights = self.flat(*self.sums(sites))
        return flat.learn(codes, weights, vocab_size)[0]


def split(bags: DataFrame, parts: DataFrame) -> tuple[DataFrame, list]:
    """(bin, site_id, held) and the manifests that are too large for a task. parts: manifest_id, site_id, part. bags: site_id
    and size."""
    groups = checkpointed(parts.groupBy("manifest_id", "site_id").agg(F.collect_set("part").alias("parts")))
    sized = groups.select("manifest_id", "site_id").join(bags.select("site_id", "size"), "site_id")
    large = [r[0] for r in sized.groupBy("manifest_id").agg(F.sum("size").alias("n")).where(F.col("n") > bpe.LOCAL_UNITS).select("manifest_id").collect()]  # few
    cores = bags.sparkSession.sparkContext.defaultParallelism
    manifests = groups.select("manifest_id").distinct().count()
    bins = max(2 * cores, -(-manifests // BIN_MANIFESTS))
    copies = sized.groupBy("site_id", "size").agg(F.count("*").alias("n")).agg(F.sum(F.col("size") * F.least("n", F.lit(bins)))).first()[0] or 0
    bins = max(bins, -(-copies // BIN_UNITS))
    if large:
        groups = groups.where(~F.coalesce(F.col("manifest_id").isin(*large), F.lit(False)))
    binned = groups.withColumn("bin", F.pmod(F.xxhash64("manifest_id"), F.lit(bins)))
    return binned.groupBy("bin", "site_id").agg(F.collect_list(F.struct("manifest_id", "parts")).alias("held")), large


def each_bin(rows: DataFrame, run: Callable[[Bin], Iterator[pa.RecordBatch]], schema: str, take: Callable = Bin.take, kind: type[Bin] = Bin) -> DataFrame:
    """What run gives of each bin. rows: bin, then what take gets: site_id, held, bag."""
    bins = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    count = rows.select("bin").distinct().count()
    dealt = rows.repartition(max(bins, count), "bin").sortWithinPartitions("bin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, kind()
        for batch in batches:
            for k in range(batch.num_rows):
                number, *row = (c[k].as_py() for c in batch.columns)
                if number != last:
                    if last is not None:
                        yield from run(own)
                    last, own = number, kind()
                take(own, *row)
        if last is not None:
            yield from run(own)

    return dealt.mapInArrow(read, schema)


def of(df: DataFrame, large: list) -> DataFrame:
    """The rows of the large manifests."""
    return df.where(F.col("manifest_id").isin(*large))


_TOKENIZERS = "manifest_id bigint, shadow_id int, target boolean, kind string, n int, token string, left string, right string"


def tokenizer_rows(manifest: int | None, part: int, t: Tokenizer) -> pa.RecordBatch:
    """A row of train_each for each token and merge, with shadow_id and target."""
    left, right = [a for a, _ in t.merges], [b for _, b in t.merges]
    v, m = len(t.vocab), len(t.merges)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([manifest] * (v + m), pa.int64()), pa.array([None if part in (TARGET, UNNUMBERED) else part] * (v + m), pa.int32()), pa.array([part == TARGET] * (v + m), pa.bool_()),
            pa.array(["token"] * v + ["merge"] * m, pa.string()), pa.array([*t.vocab.values(), *range(m)], pa.int32()),
            pa.array([*t.vocab, *(a + b for a, b in t.merges)], pa.string()), pa.array([None] * v + left, pa.string()), pa.array([None] * v + right, pa.string()),
        ],
        names=["manifest_id", "shadow_id", "target", "kind", "n", "token", "left", "right"],
    )


def train(bags: DataFrame, parts: DataFrame, size: int, shadow_size: int) -> DataFrame:
    """(manifest_id, shadow_id, target, kind, n, token, left, right): the tokenizers of the manifests' targets and shadows, as
    bpe.train_each. bags: of unitbags.site_bags; parts: of members and shadows."""
    groups, large = split(bags, parts)

    def run(own: Bin) -> Iterator[pa.RecordBatch]:
        for manifest, by_part in own.parts.items():
            for part, sites in by_part.items():
                yield tokenizer_rows(manifest, part, own.trained(sites, size if part == TARGET else shadow_size))

    rows = bags.select("site_id", "bag").join(bounded_broadcast(groups), "site_id").select("bin", "site_id", "held", "bag")
    out = each_bin(rows, run, _TOKENIZERS)
    for target in (True, False) if large else ():
        own = of(parts, large).where((F.col("part") == TARGET) == target).distinct()
        units = unit_rows(bags.join(own.select("site_id").distinct(), "site_id", "left_semi"))
        each = bpe.train_each(units.join(own, "site_id"), size if target else shadow_size, "manifest_id", "part")
        shadow = F.when(~F.col("part").isin(TARGET, UNNUMBERED), F.col("part")).cast("int").alias("shadow_id")
        out = out.unionByName(each.select("manifest_id", shadow, F.lit(target).alias("target"), "kind", "n", "token", "left", "right"))
    return out


def targets(trained: DataFrame) -> DataFrame:
    """The tokenizers of the targets (as train_each, by manifest_id)."""
    return trained.where("target").drop("target", "shadow_id")


@dataclass
class Encoder:
    """A target's tokenizer and the tokens of each unit of its bin, as far as asked for."""

    own: Bin
    tokenizer: Tokenizer
    tokens: np.ndarray
    done: np.ndarray

    @staticmethod
    def of(own: Bin, sites: list[str], vocab_size: int) -> Encoder:
        """Of the member sites; without any, every letter is unknown."""
        size = len(own.place)
        t = Encoder(own, Tokenizer({}, []), np.zeros(size, np.int32), np.zeros(size, bool))
        if sites:
            some, counts = own.sums(sites)
            codes, starts, weights = own.flat(some, counts)
            t.tokenizer, begins = flat.learn(codes, weights, vocab_size)
            if begins is not None:
                t.tokens[some], t.done[some] = flat.sizes_of(begins, starts), True
        return t

    def encode(self, wanted: np.ndarray) -> None:
        """wanted: a flag for each unit of the bin."""
        some = np.flatnonzero(wanted & ~self.done)
        if len(some):
            self.done[some] = True
            names = self.own.names() if len(some) <= len(self.tokenizer.merges) else []  # few for the merges: unit by unit, but for long ones
            few = np.array([len(names[k]) <= UNIT_LETTERS for k in some.tolist()]) if names else np.zeros(len(some), bool)
            self.tokens[some[few]] = [len(self.tokenizer.encode_unit(names[k])) for k in some[few].tolist()]
            some = some[~few]
            codes, starts, _ = self.own.flat(some, some)
            self.tokens[some] = flat.sizes_of(flat.encoded(codes, starts, self.tokenizer), starts)

    def site_tokens(self, sites: list[str]) -> list[int]:
        wanted = np.zeros(len(self.done), bool)
        for s in sites:
            wanted[self.own.bags[s][0]] = True
        self.encode(wanted)
        return [int(counts @ self.tokens[at].astype(np.int64)) for at, counts in map(self.own.bags.get, sites)]


def site_tokens(bags: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """(manifest_id, site_id, tokens) of the pool sites by the target tokenizers. parts: of members and pool."""
    groups, large = split(bags, parts)

    def run(own: Bin) -> Iterator[pa.RecordBatch]:
        for manifest, by_part in own.parts.items():
            sites = by_part.get(POOL, [])
            found = Encoder.of(own, by_part.get(TARGET, []), size).site_tokens(sites) if sites else []
            yield pa.RecordBatch.from_arrays([pa.array([manifest] * len(sites), pa.int64()), pa.array(sites, pa.string()), pa.array(found, pa.int64())], names=["manifest_id", "site_id", "tokens"])

    rows = bags.select("site_id", "bag").join(bounded_broadcast(groups), "site_id").select("bin", "site_id", "held", "bag")
    out = each_bin(rows, run, "manifest_id bigint, site_id string, tokens bigint")
    if large:
        units = unit_rows(bags.join(of(parts, large).select("site_id").distinct(), "site_id", "left_semi"))
        own = checkpointed(units.join(of(parts, large).where(F.col("part") == POOL).select("manifest_id", "site_id").distinct(), "site_id"))
        inside = of(parts, large).where(F.col("part") == TARGET).select("manifest_id", "site_id").distinct()
        t = checkpointed(bpe.train_each(units.join(inside, "site_id"), size, "manifest_id"))
        out = out.unionByName(bpe.tokens_by(own, bpe.encode_each(own, t, "manifest_id"), "manifest_id", "site_id"))
    return out


_DOCUMENTS = pa.schema([("site_id", pa.string()), ("totals", pa.list_(pa.int64())), ("documents", pa.binary()), ("change", pa.binary()), ("words", pa.binary())])


class _Held:
    """Documents of a site, as a task reads them."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.totals = [0, 0, 0, 0]
        self.sizes: list[int] = []
        self.units: list[int] = []
        self.change: Counter = Counter()
        self.words: Counter = Counter()

    def row(self, site: str) -> pa.RecordBatch:
        names = "\n".join(self.place).encode()  # units have no white space
        head = np.array([len(self.sizes), len(self.units)], "<i8").tobytes()
        raw = head + np.array(self.sizes, "<i4").tobytes() + np.array(self.units, "<i4").tobytes() + names
        body = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
        change = Counter({u: n for u, n in self.change.items() if n})
        return pa.RecordBatch.from_arrays([pa.array([site]), pa.array([self.totals], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (body, packed(change), packed(self.words)))], schema=_DOCUMENTS)


def site_documents(texts: DataFrame) -> DataFrame:
    """(site_id, totals, documents, change, words), checkpointed, one row or more a site: documents, bytes, characters and
    sentences; the units of each document; how often more a unit is in the sentences than in the documents; the words.
    texts: site_id, text, none of them null."""
    sentences = T.sentence_list(F.col("text"))
    cut = texts.select(
        "site_id", F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("characters"), T.units(F.col("text")).alias("units"),
        F.size(sentences).cast("bigint").alias("sentences"), F.flatten(F.transform(sentences, T.units)).alias("inside"), T.word_list(F.col("text")).alias("words"),
    ).select("site_id", "bytes", "characters", "sentences", "units", F.when(F.col("inside") != F.col("units"), F.col("inside")).alias("inside"), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        size = 0
        for batch in batches:
            for site, bytes_, characters, sentences_, units, inside, words in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(site, _Held())
                own.totals = [a + b for a, b in zip(own.totals, (1, bytes_, characters, sentences_))]
                place = own.place
                own.sizes.append(len(units))
                own.units += [place.setdefault(u, len(place)) for u in units]
                if inside is not None:
                    own.change.update(inside)
                    own.change.subtract(units)
                own.words.update(words)
                size += len(units)
                if size > HELD_UNITS:
                    yield from (x.row(s) for s, x in held.items())
                    held, size = {}, 0
        yield from (x.row(s) for s, x in held.items())

    return checkpointed(cut.mapInArrow(run, "site_id string, totals array<bigint>, documents binary, change binary, words binary"))


@dataclass
class _Documents:
    totals: np.ndarray
    ends: np.ndarray
    units: np.ndarray
    change: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]


class _TextBin(Bin):
    """A bin that also holds the documents of the sites whose texts are measured."""

    def __init__(self) -> None:
        super().__init__()
        self.documents: dict[str, list[_Documents]] = {}

    def take_documents(self, site: str, held: list[dict], bag: bytes | None, totals: list[int], documents: bytes, change: bytes, words: bytes) -> None:
        if bag is not None:
            return self.take(site, held, bag)
        raw = pa.decompress(documents[8:], int.from_bytes(documents[:8], "little"), codec="zstd", asbytes=True)
        n, size = np.frombuffer(raw, "<i8", 2).tolist()
        names = raw[16 + 4 * (n + size) :].decode()
        number = self.numbers(names.split("\n") if names else [])
        units = number[np.frombuffer(raw, "<i4", size, 16 + 4 * n)] if size else np.zeros(0, np.int32)
        numbered = [(self.numbers(u), c) for u, c in (unpacked(change), unpacked(words))]
        if site not in self.documents:
            self.hold(site, held)
        self.documents.setdefault(site, []).append(_Documents(np.array(totals), np.cumsum(np.frombuffer(raw, "<i4", n, 16)), units, *numbered))
        return None

    def measures(self, manifest: int | None, sites: list[str], t: Encoder) -> tuple:
        """Of a manifest's texts, as bpe.utility."""
        chunks = [c for s in sites for c in self.documents.get(s, ())]
        words = np.zeros(len(self.place), np.int64)
        wanted = np.zeros(len(self.place), bool)
        for c in chunks:
            wanted[c.units] = True
            wanted[c.change[0]] = True
            words[c.words[0]] += c.words[1]
        rare = np.flatnonzero((words > 0) & (words <= 2))
        wanted[rare] = True
        t.encode(wanted)
        of_document, change = [], 0
        for c in chunks:
            total = np.concatenate([[0], np.cumsum(t.tokens[c.units], dtype=np.int64)])[np.concatenate([[0], c.ends])]
            of_document.append(np.diff(total))
            change += int(c.change[1] @ t.tokens[c.change[0]].astype(np.int64))
        each = np.concatenate(of_document)
        documents, size, characters, sentences = (int(x) for x in sum(c.totals for c in chunks))
        tokens = int(each.sum())
        single = [k for k in rare.tolist() if t.tokens[k] == 1]
        known = sum(self.name(k) in t.tokenizer.vocab and self.name(k) != "[UNK]" for k in single)
        n = len(rare)
        return (
            manifest, documents, size, characters, tokens, tokens / documents, float(np.median(each)), sentences, (tokens + change) / sentences if sentences else None,
            n or None, float(t.tokens[rare].sum()) / n if n else None, known / n if n else None,
        )

    def name(self, k: int) -> str:
        return self.names()[k]


_MEASURES = "manifest_id bigint, documents bigint, bytes bigint, characters bigint, tokens bigint, tokens_per_document double, median_tokens_per_document double, sentences bigint, tokens_per_sentence double, rare_words bigint, rare_split_length double, rare_single_coverage double"


def utility(texts: DataFrame, bags: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """bpe.utility of the targets' tokenizers over the texts of the pool sites, one row a manifest. texts: idx, site_id, text,
    none of them null; parts: of members and pool."""
    groups, large = split(bags, parts)
    inside = checkpointed(groups)
    one = lambda some: inside.withColumn("held", F.expr(f"filter(transform(held, x -> named_struct('manifest_id', x.manifest_id, 'parts', filter(x.parts, p -> {some}))), x -> size(x.parts) > 0)")).where("size(held) > 0")
    targets_, pools = one(f"p <> {POOL}"), one(f"p = {POOL}")
    documents = site_documents(texts.join(pools.select("site_id").distinct(), "site_id", "left_semi"))
    bag = bags.select("site_id", "bag").join(bounded_broadcast(targets_), "site_id").select("bin", "site_id", "held", "bag")
    rows = bag.unionByName(documents.join(bounded_broadcast(pools), "site_id").select("bin", *_DOCUMENTS.names, "held"), allowMissingColumns=True)

    def run(own: _TextBin) -> Iterator[pa.RecordBatch]:
        found = []
        for manifest, by_part in own.parts.items():
            if by_part.get(POOL):
                found.append(own.measures(manifest, by_part[POOL], Encoder.of(own, by_part.get(TARGET, []), size)))
        kinds = [pa.float64() if " double" in x else pa.int64() for x in _MEASURES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found) if found else [[]] * len(kinds), kinds)], names=[x.split()[0] for x in _MEASURES.split(", ")])

    columns = rows.select("bin", "site_id", "held", "bag", "totals", "documents", "change", "words")
    out = each_bin(columns, run, _MEASURES, _TextBin.take_documents, _TextBin)
    out = out.withColumns({"bytes_per_token": F.col("bytes") / F.col("tokens"), "characters_per_token": F.col("characters") / F.col("tokens")})
    if large:
        own = of(parts, large)
        units = unit_rows(bags.join(own.select("site_id").distinct(), "site_id", "left_semi"))
        t = checkpointed(bpe.train_each(units.join(own.where(F.col("part") == TARGET).select("manifest_id", "site_id").distinct(), "site_id"), size, "manifest_id"))
        held = texts.join(own.where(F.col("part") == POOL).select("manifest_id", "site_id").distinct(), "site_id")
        out = out.unionByName(bpe.utility(held, lambda u: bpe.encode_each(u, t, "manifest_id"), "manifest_id"))
    return out

"""Problem 5: the same or nearly the same records across splits.

Method: an index of the texts, in which every training text meets every evaluation text that can share 80 % of its words;
matches are filtered by exact bounds, and what is left is compared exactly.

Word order does not matter here, so a text stands as its tokens (word, occurrence number) from the rarest to the most
common (rare ones by the powers of two of their counts, see Order); equal bags of words are one class before anything is searched. Of n tokens the n - ceil(0.8 n) + 1 rarest are
indexed: two texts that share 80 % have one of these in common, as all their tokens before the first common one differ
(prefix filtering). Lengths, the places of the common token and the parities of the hashed tokens behind it bound what a
pair can share, so no bound drops a pair. Among the texts of a token that many have, those meet that agree in one of more
parts of the parities than may differ, so that not every two are compared. Tokens that too many texts have are searched in
blocks of texts, every block with every block.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import ALL_PAIRS_UP_TO, digest, records, spread
from veilmark.llm.textform import words
from veilmark.session import bounded_broadcast, checkpointed, table

MEMBER, NONMEMBER = "target_member_site_ids", "target_nonmember_site_ids"
#: 80 % as a fraction.
SHARED, OF = 4, 5
#: A token of at least this share of the records is ordered by its frequency; there are at most (mean tokens of a
#: record / share) such tokens. Rarer ones come first, by the logarithm of their cell's count, then by their hash.
COMMON_WORD_SHARE = 2e-4
#: Cells, by hash, in which the rarer tokens are counted: a byte each for the tasks, whatever the input.
CELLS = 1 << 23
#: Indexed texts of a token before it is searched in blocks of about so many; candidates compared at once.
HOT_KEY, CANDIDATES = 500_000, 2_000_000
#: Indexed texts of a token from which on they meet by parts of their parities; parts up to which that is worth it.
DENSE_KEY, PARTS = 4_000, 36
#: Bounds of the classes of texts by the differences left to them behind the token.
LEFT = (0, 1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32)
#: 64-bit words of a text's parity bitmap.
LANES = 4
_RARE = np.uint32(1 << 31)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def tokens(found: list[str]) -> list[str]:
    """The words of a text with their repeats told apart: all different, shared as often as both texts repeat the word."""
    seen: dict[str, int] = {}
    out = []
    for w in found:
        k = seen[w] = seen.get(w, 0) + 1
        out.append(w if k == 1 else f"{w}\0{k}")
    return out


def rare_symbol(word: str) -> int:
    """A token by 31 bits of its hash, over the places of the common ones."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little") | 1 << 31


def _word_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([rare_symbol(w) % CELLS for w in held], pa.int32()), pa.array(list(held.values()), pa.int64())], schema=schema)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held[""] += 1
            held.update(tokens(words(text)))
        if len(held) > 400_000:
            yield out()
            held.clear()
    yield out()


class Order(NamedTuple):
    """A total order of the tokens, from the rarest on: rare ones by the class of their cell and their hash, then the common
    ones. Any order finds the same pairs; the nearer to the counts it is, the fewer texts meet in a token."""

    common: list[str]  # from the rarest on
    counts: list[int]
    total: int  # rows
    classes: np.ndarray  # whole binary logarithms of the cells' counts


def common_words(texts: DataFrame) -> Order:
    """Bounded, see COMMON_WORD_SHARE and CELLS."""
    counts = checkpointed(texts.mapInArrow(_word_frequencies, "word string, cell int, n bigint").groupBy("word").agg(F.first("cell").alias("cell"), F.sum("n").alias("n")))
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    least = max(3, COMMON_WORD_SHARE * total)
    kept = sorted((r["n"], r["word"]) for r in counts.where(f"word <> '' AND n >= {least}").toLocalIterator(True))
    cells = counts.where(f"word <> '' AND n < {least}").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    cells = cells.select("cell", F.floor(F.log2("n")).cast("tinyint").alias("class")).toArrow()
    classes = np.zeros(CELLS, np.uint8)
    classes[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return Order([w for _, w in kept], [n for n, _ in kept], total, classes)


def pack(symbols: np.ndarray) -> bytes:
    """An ordered sequence: rare words as 4 bytes, common ones as 2 (or 3, in a larger vocabulary)."""
    rare = symbols[symbols >= _RARE]
    common = symbols[symbols < _RARE]
    wide = len(common) > 0 and int(common[-1]) > 0xFFFF
    body = common.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() if wide else common.astype("<u2").tobytes()
    return bytes([3 if wide else 2]) + len(rare).to_bytes(4, "little") + rare.astype("<u4").tobytes() + body


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[1:5], "little")
    rare = np.frombuffer(data, "<u4", n, 5)
    rest = data[5 + 4 * n :]
    if data[0] == 2:
        common = np.frombuffer(rest, "<u2").astype(np.uint32)
    else:
        common = np.pad(np.frombuffer(rest, np.uint8).reshape(-1, 3), ((0, 0), (0, 1))).copy().view("<u4").ravel()
    return np.concatenate([rare, common])


def bags(df: DataFrame, words_of: Order) -> DataFrame:
    """(source_record_index, site_id, variant, bag, n, lone, seq): digests of a text and of its bag of words, its size, its
    tokens in order and how many of them, the first, no other text has."""
    ranks = df.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words_of.common)})
    cells = df.sparkSession.sparkContext.broadcast(words_of.classes)
    schema = pa.schema([("source_record_index", pa.int64()), ("site_id", pa.string()), ("variant", pa.binary()), ("bag", pa.binary()), ("n", pa.int32()), ("lone", pa.int32()), ("seq", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, classes = ranks.value.get, cells.value
        known: dict[str, int] = {}
        for batch in batches:
            variant, bag, n, lone, seq = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = words(text)
                symbols = []
                for w in tokens(found):
                    s = get(w)
                    if s is None and (s := known.get(w)) is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        s = known[w] = rare_symbol(w)
                    symbols.append(s)
                # rare words first (they have the high bit), then common ones from the rarest on
                own = np.array(symbols, np.uint64)
                order = np.where(own >= _RARE, classes[own % np.uint64(CELLS)], 255).astype(np.uint64)
                ordered = np.sort(order << np.uint64(32) | own).astype(np.uint32)
                lone.append(int((order == 0).sum()))
                variant.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                bag.append(hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=16).digest())
                n.append(len(found))
                seq.append(pack(ordered))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(variant, pa.binary()), pa.array(bag, pa.binary()), pa.array(n, pa.int32()), pa.array(lone, pa.int32()), pa.array(seq, pa.binary())], schema=schema)

    return df.select("source_record_index", "site_id", "text").mapInArrow(run, "source_record_index bigint, site_id string, variant binary, bag binary, n int, lone int, seq binary")


def least_shared(x, y):
    """Tokens that texts of x and y tokens share at least at 80 %."""
    return -(-SHARED * (x + y) // (SHARED + OF))


def _parities_before(symbols: np.ndarray, owner: np.ndarray, place: np.ndarray, n: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Of each kept token, the parity bitmap of its text up to it; the first tokens are kept, but for some at the start."""
    first = np.flatnonzero(place <= n[owner] - -(-SHARED * n[owner] // OF))
    bit = _mix(symbols[first].astype(np.uint64)) % np.uint64(64 * LANES)
    one = np.zeros((len(first), LANES), np.uint64)
    # as np.packbits: the first bit of a byte is its highest
    one[np.arange(len(first)), bit // np.uint64(64)] = np.uint64(1) << ((bit % np.uint64(64)) ^ np.uint64(7))
    sums = np.bitwise_xor.accumulate(one, axis=0)
    begins = np.flatnonzero(place[first] == 0)
    before = sums[begins] ^ one[begins]  # of the texts before
    return (sums ^ np.repeat(before, np.diff(begins, append=len(first)), axis=0))[kept[first]].view(np.int64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each indexed token of a text that another may have: its place, the text's size and the parity bitmap of the
    tokens behind it."""
    names = ["key", "rep", "side", "n", "place", *(f"bits{k}" for k in range(LANES))]
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            seqs = [unpack(data) for data in part.column(2).to_pylist()]
            n = np.array([len(x) for x in seqs], np.int64)
            owner, symbols = np.repeat(np.arange(len(seqs)), n), np.concatenate(seqs)
            width = 64 * LANES
            parity = np.bincount(owner * width + (_mix(symbols.astype(np.uint64)) % np.uint64(width)).astype(np.int64), minlength=len(seqs) * width) & 1
            bits = np.packbits(parity.astype(np.uint8).reshape(len(seqs), width), axis=1).view(np.int64)
            place = np.arange(len(symbols)) - np.repeat(np.cumsum(n) - n, n)
            kept = (place <= n[owner] - -(-SHARED * n[owner] // OF)) & (place >= part.column(3).to_numpy()[owner])
            of = owner[kept]
            bits = bits[of] ^ _parities_before(symbols, owner, place, n, kept)
            rows = part.take(pa.array(of))
            columns = [pa.array(symbols[kept].astype(np.int64)), rows.column(0), rows.column(1), pa.array(n[of].astype(np.int32)), pa.array(place[kept].astype(np.int32)), *(pa.array(bits[:, k]) for k in range(LANES))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each token in a partition: (key, n)."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])

    for batch in batches:
        for data, lone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            seq = unpack(data)
            held.update(seq[lone : len(seq) + 1 - -(-SHARED * len(seq) // OF)].tolist())
        if len(held) > 400_000:
            yield out()
            held.clear()
    yield out()


_POSTED = "key bigint, rep bigint, side tinyint, n int, place int, " + ", ".join(f"bits{k} bigint" for k in range(LANES))


def posted(reps: DataFrame) -> DataFrame:
    """Index rows of the texts; a token of more than HOT_KEY texts is cut into cells, in which each two blocks of its texts meet."""
    plain = reps.select("rep", "side", "seq", "lone")
    rows = plain.mapInArrow(_postings, _POSTED)
    counts = plain.mapInArrow(_count_keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    hot = checkpointed(counts.where(F.col("n") > HOT_KEY).select("key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("blocks")))
    if hot.isEmpty():
        return rows
    own, other = F.pmod(F.xxhash64("rep"), "blocks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    hot = bounded_broadcast(hot)
    cells = rows.join(hot, "key").select("*", own.alias("own"), other).withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return rows.join(hot, "key", "left_anti").unionByName(cells.select(*rows.columns))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Words two sequences have in common, with repeats, pair by pair."""
    out = np.zeros(len(a), np.int64)
    step = 4000
    for lo in range(0, len(a), step):
        sides = []
        for part in (a[lo : lo + step], b[lo : lo + step]):
            sizes = np.array([len(x) for x in part])
            owner = np.repeat(np.arange(len(part), dtype=np.int64), sizes)
            value = np.concatenate(part) if len(part) else np.zeros(0, np.uint32)
            first = np.ones(len(value), bool)
            first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))
            nth = np.arange(len(value)) - run  # repeats are told apart by their number
            with np.errstate(over="ignore"):
                sides.append((owner, (owner.astype(np.uint64) << np.uint64(50)) ^ (_mix(value.astype(np.uint64) + (nth.astype(np.uint64) << np.uint64(32))) >> np.uint64(14))))
        both = np.concatenate([sides[0][1], sides[1][1]])
        both.sort()
        same = both[1:][both[1:] == both[:-1]]
        out[lo : lo + step] += np.bincount((same >> np.uint64(50)).astype(np.int64), minlength=len(a[lo : lo + step]))
    return out


def candidates(key: np.ndarray, rep: np.ndarray, side: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """(2, pairs): texts with a common token that can share 80 %; rows are sorted by key and n.

    If the token is a pair's first common one, neither text has more tokens before it than it may have beside the shared
    ones, and the shorter text of at least as many as 8/9 of its own tokens has the fewer.
    """
    number = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]) - 1
    dense = (np.bincount(number) >= DENSE_KEY)[number] if len(key) else np.zeros(0, bool)
    pairs = [np.zeros((2, 0), np.int64)]
    for some, each in ((np.flatnonzero(~dense), _all_pairs), (np.flatnonzero(dense), _by_parts)):
        if len(some):
            pairs += each(number[some], rep[some], side[some], n[some], place[some], [b[some] for b in bits])
    return np.unique(np.concatenate(pairs, axis=1), axis=1)


def _near(x: np.ndarray, y: np.ndarray, rep: np.ndarray, side: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """(2, pairs): of the pairs (x, y) those within the bounds."""
    shared = least_shared(n[x], n[y])
    left_x, left_y = n[x] - shared - place[x], n[y] - shared - place[y]
    good = (left_x >= 0) & (left_y >= 0)
    x, y, left = x[good], y[good], (left_x + left_y)[good]
    across = ((side[x] & 1) & (side[y] >> 1)) | ((side[x] >> 1) & (side[y] & 1))
    good = (across > 0) & (rep[x] != rep[y])
    x, y, left = x[good], y[good], left[good]
    differ = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in bits)  # at most the tokens behind in one text only
    good = differ <= left
    x, y = rep[x[good]], rep[y[good]]
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)


def _all_pairs(number: np.ndarray, rep: np.ndarray, side: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Of each key, the pairs of its rows."""
    first = number.astype(np.int64) << 32
    low = np.searchsorted(first + n, first + -(-SHARED * n // OF))
    shorter = np.flatnonzero(place <= n - least_shared(n, n))
    begin, end = np.searchsorted(shorter, low), np.searchsorted(shorter, np.arange(len(n)))
    for which, at in _spread_out(begin, end):
        yield _near(which, shorter[at], rep, side, n, place, bits)


def _spread_out(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """spread, of about CANDIDATES at once."""
    volume = np.cumsum(end - begin)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(volume, (volume[lo - 1] if lo else 0) + CANDIDATES, "right")))
        which, at = spread(begin[lo:hi], end[lo:hi])
        yield which + lo, at
        lo = hi


def _by_parts(number: np.ndarray, rep: np.ndarray, side: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Of each key, the pairs of its rows that agree in a part of their parities.

    What may differ behind the token is at most n / 9 - place of one text and of the other, so if the bits are cut into more
    parts than that, one part is the same in both. Texts with too many differences left for that meet one by one.
    """
    bounds = np.array([*LEFT, 1 << 40])
    level = np.searchsorted(bounds, n / (SHARED + OF) - place, "right")  # the class whose differences are below bounds[level]
    rows = [np.flatnonzero(level == k) for k in range(len(bounds))]
    key = _mix(number.astype(np.uint64) + np.uint64(1))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[: i + 1]):
            parts = int(bounds[i] + bounds[j])
            if not parts or not len(a) or not len(b):
                continue
            if parts > PARTS:  # by key alone
                parts, masks = 1, [[0] * LANES]
            else:
                width = 64 * LANES
                cuts = [width * k // parts for k in range(parts + 1)]
                masks = [[(((1 << hi) - (1 << lo)) >> 64 * k) & (1 << 64) - 1 for k in range(LANES)] for lo, hi in zip(cuts, cuts[1:])]
            for mask in masks:
                codes = []
                for own in (a,) if i == j else (a, b):
                    code = key[own]
                    for lane, m in zip(bits, mask):
                        if m:
                            code = _mix(code ^ (lane[own] & np.uint64(m)))
                    codes.append(code)
                order = np.argsort(codes[-1])
                sorted_ = codes[-1][order]
                wanted = sorted_ if i == j else codes[0]
                begin = np.arange(1, len(a) + 1) if i == j else np.searchsorted(sorted_, wanted)
                end = np.searchsorted(sorted_, wanted, "right")
                mine, others = (a[order] if i == j else a), b[order]
                some = np.flatnonzero(end > begin)
                for which, at in _spread_out(begin[some], end[some]):
                    yield _near(mine[some[which]], others[at], rep, side, n, place, bits)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a partition sorted by key and n; a key's rows are taken together."""
    held: list[list[np.ndarray]] = []

    def out(upto: int | None) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        held[:] = [[c[upto:] for c in columns]] if upto is not None else []
        key, rep, side, n, place, *bits = [c[:upto] for c in columns]
        found = candidates(key, rep, side.astype(np.int64), n.astype(np.int64), place.astype(np.int64), [b.view(np.uint64) for b in bits])
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["rep_a", "rep_b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(h[0]) for h in held) > 100_000:
            keys = np.concatenate([h[0] for h in held])
            ends = np.flatnonzero(keys[1:] != keys[:-1])
            if len(ends):
                yield out(int(ends[-1]) + 1)
    if held:
        yield out(None)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (rep_a, rep_b, seq_a, seq_b) that share 80 %."""
    for batch in batches:
        a, b = ([unpack(data) for data in batch.column(k).to_pylist()] for k in (2, 3))
        common = overlaps(a, b)
        union = np.array([len(x) for x in a], np.int64) + np.array([len(x) for x in b], np.int64) - common
        yield batch.select([0, 1]).filter(pa.array(OF * common >= SHARED * union))


def near_classes(reps: DataFrame) -> DataFrame:
    """(rep_a, rep_b): distinct bags that share 80 % of their words, one of a training and one of an evaluation text.

    reps: rep, side, seq, lone.
    """
    met = posted(reps).repartition("key").sortWithinPartitions("key", "n").mapInArrow(_meet, "rep_a bigint, rep_b bigint").distinct()
    seqs = lambda x: reps.select(F.col("rep").alias(f"rep_{x}"), F.col("seq").alias(f"seq_{x}"))
    pairs = met.join(seqs("a"), "rep_a").join(seqs("b"), "rep_b").select("rep_a", "rep_b", "seq_a", "seq_b")
    return pairs.mapInArrow(_shared, "rep_a bigint, rep_b bigint")


def cross_split(records_: DataFrame, manifests: DataFrame) -> DataFrame:
    """(manifest_id, index_a, index_b): records that share at least 80 % of their words, with repeats and in any order,
    one of a member site and one of a nonmember site of the manifest.

    records_: source_record_index, site_id, text. Null texts and texts without words overlap with nothing. Only of
    more than ALL_PAIRS_UP_TO identical texts one record a site stands in all links to other texts; each other record has
    the links to the first record of its bag on the other side of a manifest and to the first that the one standing for it
    is linked to, so it is in a pair of every manifest in which it overlaps. Different texts give all pairs.
    """
    side = lambda name, member: manifests.where("manifest_id IS NOT NULL").select("manifest_id", F.explode(name).alias("site_id"), F.lit(member).alias("member"))
    roles = checkpointed(side(MEMBER, True).unionByName(side(NONMEMBER, False)).where("site_id IS NOT NULL").distinct())
    sides = roles.groupBy("site_id").agg(F.bit_or(F.when(F.col("member"), 2).otherwise(1)).cast("tinyint").alias("side"), F.count("*").alias("plans"))
    texts = records_.where("source_record_index IS NOT NULL AND text IS NOT NULL").join(bounded_broadcast(sides), "site_id")
    words_of = common_words(texts.select("text"))
    all_bags = bags(texts, words_of).where("n > 0")
    rows = checkpointed(all_bags.join(bounded_broadcast(sides), "site_id").select("source_record_index", "site_id", "variant", "bag", "side", "plans", "lone", "seq"))
    reps = rows.groupBy("bag").agg(F.min("source_record_index").alias("rep"), F.bit_or("side").alias("side"), F.max("seq").alias("seq"), F.max("lone").alias("lone"), F.count("*").alias("rows"), F.max("source_record_index").alias("last"))
    reps = reps.withColumn("copies", F.when(F.col("rep") == F.col("last"), 1).otherwise(F.col("rows")))  # a repeated row is no copy
    reps = checkpointed(reps)
    near = near_classes(reps.select("rep", "side", "seq", "lone"))
    members = rows.select("source_record_index", "site_id", "variant", "bag", "plans").distinct()
    classes = reps.select("bag", "rep")
    linked = near.select("rep_a", "rep_b").unionByName(reps.where("copies > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")))
    linked = checkpointed(linked)
    used = linked.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
    held = members.join(classes.join(used, "rep"), "bag").select("rep", "variant", "source_record_index", "site_id", "plans")
    copies = held.groupBy("rep", "variant").agg((F.count("*") > ALL_PAIRS_UP_TO).alias("large"))
    held = checkpointed(held.join(copies, ["rep", "variant"]))
    small, big = held.where("NOT large"), held.where("large")
    # of many identical texts one record a site stands for its copies in links to other texts
    stands = small.unionByName(big.groupBy("rep", "variant", "large", "site_id", "plans").agg(F.min("source_record_index").alias("source_record_index")).select(*small.columns))
    a = stands.select(F.col("rep").alias("rep_a"), F.col("source_record_index").alias("xa"), F.col("site_id").alias("sa"), F.col("plans").alias("pa"), F.col("variant").alias("va"), F.col("large").alias("la"))
    b = stands.select(F.col("rep").alias("rep_b"), F.col("source_record_index").alias("xb"), F.col("site_id").alias("sb"), F.col("plans").alias("pb"), F.col("variant").alias("vb"))
    pairs = linked.join(a, "rep_a").join(b, "rep_b").where("xa <> xb AND (rep_a <> rep_b OR (xa < xb AND NOT (la AND va = vb)))")
    # the site of fewer manifests leads, so that a site of all manifests multiplies nothing
    lead = F.col("pa") <= F.col("pb")
    ordered = pairs.select(F.least("xa", "xb").alias("index_a"), F.greatest("xa", "xb").alias("index_b"), F.when(lead, F.col("sa")).otherwise(F.col("sb")).alias("site_id"), F.when(lead, F.col("sb")).otherwise(F.col("sa")).alias("other"))
    other = roles.select("manifest_id", F.col("site_id").alias("other"), F.col("member").alias("other_member"))
    found = ordered.join(roles, "site_id").join(other, ["manifest_id", "other"]).where("member <> other_member").select("manifest_id", "index_a", "index_b")
    if big.isEmpty():
        return found.distinct()
    found = checkpointed(found)
    # many identical texts: each record with the first of its bag on the other side of the manifest
    placed = held.join(big.select("rep").distinct(), "rep", "left_semi").join(roles, "site_id").select("rep", "large", "manifest_id", "member", "source_record_index")
    firsts = placed.groupBy("rep", "manifest_id", "member").agg(F.min("source_record_index").alias("first")).withColumn("member", ~F.col("member"))
    star = placed.where("large").join(firsts, ["rep", "manifest_id", "member"]).where("first <> source_record_index")
    star = star.select("manifest_id", F.least("first", "source_record_index").alias("index_a"), F.greatest("first", "source_record_index").alias("index_b"))
    # and with the first record that the one which stands for it is linked to
    heads = big.groupBy("rep", "variant", "site_id").agg(F.min("source_record_index").alias("head"))
    ends = found.select("manifest_id", F.explode(F.array(F.struct(F.col("index_a").alias("head"), F.col("index_b").alias("other")), F.struct(F.col("index_b").alias("head"), F.col("index_a").alias("other")))).alias("x")).select("manifest_id", "x.*")
    partners = ends.join(heads, "head").groupBy("manifest_id", "rep", "variant", "site_id").agg(F.min("other").alias("other"))
    copies = big.select("rep", "variant", "site_id", "source_record_index").join(partners, ["rep", "variant", "site_id"])
    copies = copies.select("manifest_id", F.least("other", "source_record_index").alias("index_a"), F.greatest("other", "source_record_index").alias("index_b"))
    return found.unionByName(star).unionByName(copies).distinct()


def identical_members(records_: DataFrame) -> DataFrame:
    """(source_record_index, class_index): every record with a text and the smallest record of the identical text. From it
    and the pairs of cross_split all pairs of exact copies follow."""
    members = checkpointed(records_.where("source_record_index IS NOT NULL AND text IS NOT NULL").select("source_record_index", digest("text").alias("variant")).distinct())
    return members.join(members.groupBy("variant").agg(F.min("source_record_index").alias("class_index")), "variant").select("source_record_index", "class_index")


def split_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found."""
    return cross_split(records(spark, folder, "site_id", "text"), table(spark, folder, "manifests"))


def identical_classes(spark: SparkSession, folder: str) -> DataFrame:
    """p5_members: every record with the smallest record of the identical text."""
    return identical_members(records(spark, folder, "text"))


def overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    """p5_report: overlaps by manifest and site: (manifest_id, site_id, pairs, records)."""
    rows = records(spark, folder, "site_id", "text")
    ends = split_overlaps(spark, folder).select("manifest_id", F.explode(F.array("index_a", "index_b")).alias("source_record_index"))
    sites = rows.where("site_id IS NOT NULL").groupBy("source_record_index").agg(F.min("site_id").alias("site_id"))
    return ends.join(sites, "source_record_index").groupBy("manifest_id", "site_id").agg(F.count("*").alias("pairs"), F.countDistinct("source_record_index").alias("records"))

"""Problem 9: evaluation texts inside training text.

Method: size-partitioned MinHash containment search, verified by exact containment. A leak is a run of at least RUN words,
so both sides are taken apart into windows of RUN words, and the MinHash of a window is the least hash of its five-word
shingles: a window that stands in both sides has the same MinHash on both, so the search loses nothing. The windows of an
item are its sketch; items are indexed in partitions by the size of their sketch, and in each partition a document is a
candidate of an item from the containment on that one window gives there (the least a run can give). Candidates are
verified by digests of the windows' whole words. Both sides are taken apart in tasks. A small index filters the documents'
windows before they leave the task; a larger one, checked at run time, is joined by shuffled windows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.textform import words
from veilmark.session import checkpointed, table

RUN, SHINGLE = 12, 5
#: Windows of all items up to which the index is broadcast (8 bytes a window to Python, about 60 to the join).
BROADCAST_WINDOWS = 1_000_000
#: Words a task remembers the hashes of at a time.
KNOWN_WORDS = 500_000


def word_hashes(found: list[str], known: dict[str, int]) -> list[int]:
    """64-bit hashes of words, never 0."""
    out = []
    for w in found:
        h = known.get(w)
        if h is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            h = known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") or 1
        out.append(h)
    return out


def window_minhash(ids: np.ndarray) -> np.ndarray:
    """MinHash of each window of RUN words, 0 where the window holds a border (0)."""
    n = len(ids) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        m = len(ids) - SHINGLE + 1
        h = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    least = h
    width, count = 1, RUN - SHINGLE + 1
    while width < count:  # sliding minimum by doubling
        step = min(width, count - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    borders = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.where(borders[RUN:] == borders[:-RUN], np.maximum(least[:n], np.uint64(1)), np.uint64(0))


class Filter:
    """The MinHashes of the index by size partition."""

    def __init__(self, parts: dict[int, np.ndarray]):
        self.parts = {size: np.sort(p) for size, p in sorted(parts.items())}
        self.low = np.zeros(1 << 16, bool)  # a first look by the low bits
        for p in self.parts.values():
            self.low[(p & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(size, places) of the windows that stand in each partition."""
        near = np.flatnonzero(self.low[(least & np.uint64(0xFFFF)).astype(np.int64)] & (least > 0))
        for size, p in self.parts.items():
            yield size, near[p[np.minimum(np.searchsorted(p, least[near]), len(p) - 1)] == least[near]]


_WINDOWS = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("minhash", pa.int64()), ("digest", pa.binary())])
_WINDOWS_DDL = "id bigint, size int, minhash bigint, digest binary"


def _windows(filtered: Filter | None, sized: bool):
    """A task that gives the windows of (id, text) rows: of items with their size, of documents those the filter lets by
    (all, without one; their size is 0 then)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = filtered.value if filtered is not None else None
        known: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                owners, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                flat: list[str] = []
                hashes: list[int] = []
                starts = []
                for text in texts:
                    starts.append(len(flat))
                    found = words(text) if text else []
                    flat += [*found, ""]
                    hashes += [*word_hashes(found, known), 0]
                least = window_minhash(np.array(hashes, np.uint64))
                hits = index.hits(least) if index else [(0, np.flatnonzero(least))]
                rows = set()
                for size, places in hits:
                    for k, row in zip(places.tolist(), (np.searchsorted(starts, places, "right") - 1).tolist()):
                        rows.add((owners[row], size, int(least[k].astype(np.int64)), hashlib.blake2b(" ".join(flat[k : k + RUN]).encode(), digest_size=16).digest()))
                rows = sorted(rows)
                if sized:
                    count: dict[int, int] = {}
                    for r in rows:
                        count[r[0]] = count.get(r[0], 0) + 1
                    rows = [(r[0], count[r[0]].bit_length(), *r[2:]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_WINDOWS)], schema=_WINDOWS)

    return run


def item_index(items: DataFrame) -> DataFrame:
    """(item_id, size, minhash, digest): the windows of every item; size is the bit length of their number."""
    rows = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()  # held-out texts
    return rows.mapInArrow(_windows(None, True), _WINDOWS_DDL).withColumnRenamed("id", "item_id")


def containments(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, windows): documents that hold a run of at least 12 consecutive words of the item, how many
    of the item's distinct windows they hold and how many it has.

    documents: doc_id, text; items: item_id, text. Null and empty texts, null ids and items under 12 words leak nothing.
    The documents are read once; their windows leave a task only where the index has their MinHash.
    """
    index = checkpointed(item_index(items))
    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    on = ["minhash", "digest"]
    if index.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        sketch = index.select("size", "minhash").distinct().toArrow()  # bounded above
        size, least = (sketch.column(k).to_numpy() for k in range(2))
        known = documents.sparkSession.sparkContext.broadcast(Filter({int(n): least[size == n].view(np.uint64) for n in np.unique(size)}))
        found = rows.mapInArrow(_windows(known, False), _WINDOWS_DDL).withColumnRenamed("id", "doc_id")
        pairs = found.join(F.broadcast(index), ["size", *on])
    else:
        found = rows.mapInArrow(_windows(None, False), _WINDOWS_DDL).withColumnRenamed("id", "doc_id").drop("size")
        pairs = found.join(index, on)
    sizes = index.groupBy("item_id").agg(F.countDistinct("digest").alias("windows"))
    shared = pairs.groupBy("doc_id", "item_id", "size").agg(F.countDistinct("digest").alias("shared")).join(sizes, "item_id")
    # the least containment of a run in the partition: one window of the most its items have
    return shared.where("shared / windows >= 1 / (shiftleft(1L, size) - 1)").groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.max("windows").alias("windows"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds a run of at least 12 consecutive words of the item."""
    return containments(documents, items).select("doc_id", "item_id")


def leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """p9_found: documents with the items they leak."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def leak_report(spark: SparkSession, folder: str) -> DataFrame:
    """p9_report: (item_id, documents, whole, most): documents that leak an item, those that hold all of it, and the
    greatest share of its windows in one."""
    found = containments(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("shared") == F.col("windows"), 1).otherwise(0)).alias("whole"), F.max(F.round(F.col("shared") / F.col("windows"), 6)).alias("most"))

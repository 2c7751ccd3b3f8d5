"""Problem 8: encoding of the whole corpus with a public tokenizer.

Method: monoid tree reduction. A text is halved down to leaves, and each leaf is encoded on its own. Two neighbours are
joined by encoding a window around their border again, from the last pre-token of the left that cannot move, growing to
the right until a new pre-token ends where one of the right neighbour ends. From there on both encode the same text from
the same place and merges never look across a pre-token, so all tokens outside the window provably stay and are taken
over as they are. The join is associative and an empty stretch is its unit; decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veilmark.session import table

TOKENIZERS = "/opt/tokenizers"
LEAF_CHARS = 256
FIRST_WINDOW = 64
#: Distinct pre-tokens whose ids a task remembers at a time.
KNOWN_PRETOKENS = 300_000
#: The public pre-token pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = regex.compile(PATTERN)


def rank_file(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> bytes:
    """The rank file of a tokenizer as the driver reads it; it is sent to the tasks, which need no folder."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return lines.read()


@lru_cache(2)
def from_ranks(ranks: bytes, name: str = "byte_bpe_50k"):
    """The encoder of a rank file's contents, without special tokens."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    return from_ranks(rank_file(folder, name), name)


class Encoder:
    """Encodes single pre-tokens, each distinct one once while it is remembered."""

    def __init__(self, enc):
        self.enc, self.known = enc, {}

    def __call__(self, pretoken: str) -> tuple[int, ...]:
        ids = self.known.get(pretoken)
        if ids is None:
            if len(self.known) >= KNOWN_PRETOKENS:
                self.known.clear()
            ids = self.known[pretoken] = tuple(self.enc.encode_ordinary(pretoken))
        return ids


class Piece:
    """A stretch of text, encoded as if the text began and ended here: the ends of its pre-tokens and the ids of each."""

    __slots__ = ("start", "stop", "ends", "ids")

    def __init__(self, start: int, stop: int, ends: list[int], ids: list[tuple[int, ...]]):
        self.start, self.stop, self.ends, self.ids = start, stop, ends, ids


def leaf(text: str, start: int, stop: int, ids_of: Encoder) -> Piece:
    """text[start:stop] on its own; look-ahead ends at ``stop``."""
    found = _CUT.findall(text, start, stop)
    ends, at = [], start
    for token in found:
        at += len(token)
        ends.append(at)
    return Piece(start, stop, ends, [ids_of(t) for t in found])


def join(text: str, left: Piece, right: Piece, ids_of: Encoder) -> Piece:
    """The encoding of both stretches as one.

    All pre-tokens of a stretch but its last two hold whatever follows: the longest look-ahead is one character and the
    longest pre-token that more text can glue together from two is a contraction. From the last that holds, the window is
    encoded again; where it ends a pre-token together with the right one, the search ends.
    """
    if left.start == left.stop:
        return right
    if right.start == right.stop:
        return left
    kept = max(0, len(left.ends) - 2)
    at = left.ends[kept - 1] if kept else left.start
    place, width = 0, FIRST_WINDOW
    there = right.ends
    while True:
        stop = min(right.stop, right.start + width)
        window = leaf(text, at, stop, ids_of)
        sure = len(window.ends) if stop == right.stop else max(0, len(window.ends) - 2)
        for k in range(sure):
            end = window.ends[k]
            while place < len(there) and there[place] < end:
                place += 1
            if place < len(there) and there[place] == end:
                return Piece(left.start, right.stop, left.ends[:kept] + window.ends[: k + 1] + there[place + 1 :], left.ids[:kept] + window.ids[: k + 1] + right.ids[place + 1 :])
        if stop == right.stop:
            return Piece(left.start, right.stop, left.ends[:kept] + window.ends, left.ids[:kept] + window.ids)
        place, width = 0, width * 2


def tree(text: str, ids_of: Encoder, start: int = 0, stop: int | None = None, leaf_chars: int | None = None) -> Piece:
    """text[start:stop] by halving and joining."""
    stop = len(text) if stop is None else stop
    leaf_chars = leaf_chars or LEAF_CHARS
    if stop - start <= leaf_chars:
        return leaf(text, start, stop, ids_of)
    middle = (start + stop) // 2
    return join(text, tree(text, ids_of, start, middle, leaf_chars), tree(text, ids_of, middle, stop, leaf_chars), ids_of)


def encode(text: str | None, ids_of: Encoder, leaf_chars: int | None = None) -> list[int]:
    """Ids of a text; an empty list for null and for the empty text. Every text goes through the tree."""
    return [i for ids in tree(text, ids_of, leaf_chars=leaf_chars).ids for i in ids] if text else []


def decoded_bytes(ids: list[int], enc) -> bytes:
    """The bytes of ids: halves are decoded apart and concatenated."""
    if len(ids) <= LEAF_CHARS:
        return enc.decode_bytes(ids)
    middle = len(ids) // 2
    return decoded_bytes(ids[:middle], enc) + decoded_bytes(ids[middle:], enc)


def decode(ids: list[int] | None, enc) -> str | None:
    """The text of ids; null for null. A character may lie across tokens, so only the whole is read as UTF-8."""
    return None if ids is None else decoded_bytes(list(ids), enc).decode("utf-8", "replace")


def encoded(df: DataFrame, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text); no shuffle. Null and empty texts give an empty list. The rank file
    (0.8 MB for 50,000 tokens) is broadcast from the driver."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(tokenizers, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Encoder(from_ranks(ranks.value, name))
        for batch in batches:
            ids = [encode(t, ids_of) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(df: DataFrame, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, text) of each row of (doc_id, ids); an empty list gives the empty text, null gives null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(tokenizers, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = from_ranks(ranks.value, name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x, enc) for x in batch.column(1).to_pylist()], pa.string())], schema=schema)

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """p8_ids: (doc_id, ids) of every document by byte_bpe_50k."""
    return encoded(table(spark, folder, "documents"))


def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """p8_texts: (doc_id, text) of every document, decoded from its ids; a null text comes back empty."""
    return decoded(token_ids(spark, folder))

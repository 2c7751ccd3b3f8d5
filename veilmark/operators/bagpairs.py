"""Pairs of adjacent symbols in packed bags of units, after rounds of merges. The bags stay as they are: a pass rewrites the
units of a bag in the task that reads it, so that no words and no pairs of words are written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilmark.operators import unitbags
from veilmark.operators.flat import GAP, _firsts

#: A merge's product is the symbol MADE + its number, a letter its code point.
MADE = 0x110000
#: Symbols that a task holds before it counts their pairs.
HELD_SYMBOLS = 2_000_000


class Symbols:
    """Numbers of the symbols that rounds of merges make of letters, and the merges by them."""

    def __init__(self, rounds: list[list[tuple[str, str]]]) -> None:
        self.made: dict[str, int] = {}
        for merges in rounds:
            for a, b in merges:
                self.made.setdefault(a + b, MADE + len(self.made))
        self.names = list(self.made)
        self.rounds = []
        for merges in rounds:
            table = {self.code(a, b): self.made[a + b] for a, b in merges}
            keys = np.array(sorted(table), np.int64)
            self.rounds.append((keys, np.array([table[k] for k in keys.tolist()], np.int64)))

    def number(self, symbol: str) -> int:
        return ord(symbol) if len(symbol) == 1 else self.made[symbol]

    def code(self, left: str, right: str) -> int:
        return self.number(left) << 32 | self.number(right)

    def name(self, number: int) -> str:
        return chr(number) if number < MADE else self.names[number - MADE]

    def read(self, bag: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a bag's units with gaps around each unit, and the unit's count at each place."""
        names, counts = unitbags.opened(bag)
        symbols = np.frombuffer(f"\n{names}\n".encode("utf-32-le"), "<i4").astype(np.int64)
        symbols[symbols == 10] = GAP
        weights = np.concatenate([[0], counts, [0]])[np.cumsum(symbols == GAP)] if len(counts) else np.zeros(len(symbols), np.int64)
        for keys, made in self.rounds:
            at = np.searchsorted(keys, code := codes(symbols))
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == code) if len(keys) else np.zeros(0, np.int64)
            if len(hit):
                kept = _firsts(hit, hit[:-1] + 1 == hit[1:])
                symbols[kept] = made[at[kept]]
                live = np.ones(len(symbols), bool)
                live[kept + 1] = False
                symbols, weights = symbols[live], weights[live]
        return symbols, weights


def codes(symbols: np.ndarray) -> np.ndarray:
    """Of each place but the last the pair that begins there; negative at a gap."""
    return np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] << 32 | symbols[1:] & 0xFFFFFFFF, -1)


def letters(bags: DataFrame) -> list[str]:
    """The characters of all units in the order of their code points. An alphabet is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                held |= set(unitbags.opened(bag)[0])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(held - {"\n"}), pa.string())], names=["token"])

    return sorted(r[0] for r in bags.select("bag").mapInArrow(run, "token string").distinct().collect())


def pair_counts(bags: DataFrame, rounds: list[list[tuple[str, str]]]) -> DataFrame:
    """(left, right, cnt) over all bags, in parts that are to be summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols(rounds)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            code, cnt = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            u, inverse = np.unique(code, return_inverse=True)
            out = np.zeros(len(u), np.int64)
            np.add.at(out, inverse, cnt)
            return u, out

        for batch in batches:
            for bag in batch.column(0).to_pylist():
                symbols, weights = known.read(bag)
                code = codes(symbols)
                some = code >= 0
                parts.append((code[some], weights[:-1][some]))
                size += len(code)
                if size > HELD_SYMBOLS:
                    parts = [total()]
                    size = len(parts[0][0])
        if parts:
            code, cnt = total()
            left, right = ([known.name(k) for k in x.tolist()] for x in (code >> 32, code & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(cnt, pa.int64())], names=["left", "right", "cnt"])

    return bags.select("bag").mapInArrow(run, "left string, right string, cnt bigint")


def vectors(bags: DataFrame, rounds: list[list[tuple[str, str]]], pairs: list[tuple[str, str]], norms: bool = False) -> DataFrame:
    """(site_id, coord, value) of the pairs in each bag, with zeros; norms: (site_id, norm), their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols(rounds)
        wanted = np.array([known.code(a, b) for a, b in pairs], np.int64)
        order = np.argsort(wanted)
        keys = wanted[order]
        for batch in batches:
            sites = batch.column(0).to_pylist()
            values = np.zeros((len(sites), len(pairs)), np.int64)
            for row, bag in zip(values, batch.column(1).to_pylist()):
                symbols, weights = known.read(bag)
                code = codes(symbols)
                at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                hit = keys[at] == code
                np.add.at(row, order[at[hit]], weights[:-1][hit])
            if norms:
                yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(values.sum(1))], names=["site_id", "norm"])
            else:
                coords = np.tile(np.arange(len(pairs), dtype=np.int32), len(sites))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(sites, object), len(pairs)), pa.string()), pa.array(coords), pa.array(values.ravel())], names=["site_id", "coord", "value"])

    return bags.select("site_id", "bag").mapInArrow(run, "site_id string, norm bigint" if norms else "site_id string, coord int, value bigint")

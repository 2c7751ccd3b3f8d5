"""Units as flat arrays of symbols: byte-pair merges are learned and applied to all units of a set at once."""

from __future__ import annotations

import heapq

import numpy as np

from veilmark.operators.bpe import Tokenizer
from veilmark.operators.tokens import SPECIAL_TOKENS

#: A place between two units; a place whose symbol was merged into the one before it.
GAP, DEAD = -1, -2
#: Letters up to which pairs are counted in a table of all pairs.
TABLE_LETTERS = 1500
#: Places a merge has in the mean (of the last ones, about) below which the merges are made place by place.
FEW_PLACES = 60


def flat(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the units' code points with a gap before each unit and behind the last one; where the units begin."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    starts = np.cumsum(sizes + 1) - sizes
    codes = np.full(int(sizes.sum()) + len(units) + 1, GAP, np.int32)
    letter = np.ones(len(codes), bool)
    letter[starts - 1] = letter[-1] = False
    codes[letter] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<i4")
    return codes, starts


def chosen(codes: np.ndarray, starts: np.ndarray, some: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, weights) of the units of flat with these numbers, each place with the count of its unit."""
    sizes = np.diff(starts, append=len(codes))[some]  # with the gap behind
    own = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts[some] - own, sizes)
    return np.concatenate([codes[:1], codes[at]]), own + 1, np.concatenate([[0.0], np.repeat(cnt.astype(float), sizes)])


def _firsts(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in runs (follows: the next one begins at this one's second place), every other one."""
    begins = np.concatenate([[True], ~follows])
    k = np.arange(len(at))
    return at[(k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0]


class Pairs:
    """Symbols in places with links to the neighbours, and the number of the pair that begins at each place."""

    def __init__(self, codes: np.ndarray) -> None:
        inside = codes >= 0
        present = np.zeros(int(codes.max(initial=0)) + 1, bool)
        present[codes[inside]] = True
        letters = np.flatnonzero(present)
        number = np.cumsum(present) - 1
        self.names = [chr(c) for c in letters.tolist()]
        self.symbol = np.where(inside, number[np.where(inside, codes, 0)] if len(number) else 0, GAP).astype(np.int32)
        self.before, self.after = np.arange(-1, len(codes) - 1, dtype=np.int32), np.arange(1, len(codes) + 1, dtype=np.int32)

    def merge(self, at: np.ndarray, same: bool, made: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges the pairs that begin at the places: (at, second, left): the places that were merged, their second places, and
        the places before them that stay, without gaps. same: both symbols are one, so that pairs may overlap."""
        if same and len(at) > 1 and (follows := self.after[at[:-1]] == at[1:]).any():
            at = _firsts(at, follows)
        second = self.after[at]
        left, right = self.before[at], self.after[second]
        self.symbol[at] = made
        self.symbol[second] = DEAD
        self.after[at] = right
        self.before[right] = at  # a gap is behind every unit
        left = left[self.symbol[left] >= 0]
        return at, second, left


def learn(codes: np.ndarray, weights: np.ndarray, vocab_size: int, min_pairs: int = 2, special: tuple[str, ...] = SPECIAL_TOKENS) -> tuple[Tokenizer, np.ndarray | None]:
    """As bpe.learn_merges: merges by pair count, ties by left, then right. codes, weights: as chosen; sums below 2^53.

    Also the places at which a symbol begins in the end: of these units, encoded by the tokenizer, its tokens. None if that
    does not hold, as a pair came up again after it was merged.
    """
    p = Pairs(codes)
    names = p.names
    vocab = {t: k for k, t in enumerate([*special, *names])}
    if len(vocab) >= vocab_size:
        return Tokenizer(vocab, []), p.symbol >= 0
    number = {t: k for k, t in enumerate(names)}
    letters = len(names)
    symbol = p.symbol
    first, second = symbol[:-1], symbol[1:]
    places = np.flatnonzero((first >= 0) & (second >= 0))
    code = first[places].astype(np.int64) * letters + second[places]
    if letters <= TABLE_LETTERS:
        held = np.bincount(code, minlength=0) > 0
        distinct, inverse = np.flatnonzero(held), (np.cumsum(held) - 1)[code]
    else:
        distinct, inverse = np.unique(code, return_inverse=True)
    pairs = [(c // letters, c % letters) for c in distinct.tolist()]
    known = {c: k for k, c in enumerate(pairs)}
    pair = np.full(len(symbol), -1, np.int32)
    pair[places] = inverse
    counts = np.zeros(2 * len(pairs) + 4096)
    counts[: len(pairs)] = np.bincount(inverse, weights[places], len(pairs))
    order, ends = places[np.argsort(inverse, kind="stable")], np.cumsum(np.bincount(inverse, minlength=len(pairs)))
    of_made: dict[int, list[np.ndarray]] = {}  # by symbol: places of the pairs that came up when it was made
    merges: list[tuple[str, str]] = []
    merged, again = np.zeros(len(counts), bool), False
    mean = 4.0 * FEW_PLACES
    while len(vocab) < vocab_size and pairs:
        if mean < FEW_PLACES:
            again = _learn_rest(p, weights, pair, pairs, known, counts, merged, number, vocab, merges, vocab_size, min_pairs) or again
            break
        used = counts[: len(pairs)]
        best = int(used.argmax())
        most = used[best]
        if most < min_pairs or most <= 0:
            break
        ties = np.flatnonzero(used == most)
        if len(ties) > 1:
            best = min(ties.tolist(), key=lambda k: (names[pairs[k][0]], names[pairs[k][1]]))
        a, b = pairs[best]
        merges.append((names[a], names[b]))
        product = names[a] + names[b]
        vocab.setdefault(product, len(vocab))
        made = number.setdefault(product, len(names))
        if made == len(names):
            names.append(product)
        chunks = [*of_made.get(a, ()), *(of_made.get(b, ()) if a != b else ())]
        if a < letters and b < letters:
            chunks.append(order[ends[best - 1] if best else 0 : ends[best]])
        at = chunks[0] if len(chunks) == 1 else np.concatenate(chunks)
        at = at[pair[at] == best]
        at, gone, left = p.merge(at if len(chunks) == 1 else np.unique(at), a == b, made)
        mean += (len(at) - mean) / 16
        weight, n = weights[at], len(pairs)
        old = np.concatenate([pair[left], pair[gone]])
        some = old >= 0
        counts[:n] -= np.bincount(old[some], np.concatenate([weights[left], weight])[some], n)
        counts[best] = 0
        merged[best] = True
        pair[gone] = -1
        right = symbol[p.after[at]]
        inner = right >= 0
        now = np.concatenate([left, at[inner]])
        others = np.concatenate([symbol[left], right[inner] + len(names)])  # of a left one its symbol, of a right one beyond
        flags = np.zeros(2 * len(names), bool)
        flags[others] = True
        ids = []
        for c in np.flatnonzero(flags).tolist():
            key = (c, made) if c < len(names) else (made, c - len(names))
            k = known.get(key)
            if k is None:
                k = known[key] = len(pairs)
                pairs.append(key)
            ids.append(k)
        if len(pairs) > len(counts):
            counts, merged = np.concatenate([counts, np.zeros(len(pairs))]), np.concatenate([merged, np.zeros(len(pairs), bool)])
        new = np.array(ids, np.int32)[(np.cumsum(flags) - 1)[others]] if ids else np.zeros(0, np.int32)
        again = again or bool(merged[new].any())
        pair[at] = -1
        pair[now] = new
        n = len(pairs)
        counts[:n] += np.bincount(new, weights[now], n)
        of_made.setdefault(made, []).append(np.sort(now))
    return Tokenizer(vocab, merges), None if again else symbol >= 0


def _learn_rest(
    p: Pairs, weights: np.ndarray, pair: np.ndarray, pairs: list[tuple[int, int]], known: dict[tuple[int, int], int], count: np.ndarray, merged: np.ndarray,
    number: dict[str, int], vocab: dict[str, int], merges: list[tuple[str, str]], vocab_size: int, min_pairs: int,
) -> bool:
    """The merges of learn from here on, whose arguments it changes: of many merges each with few places, so nothing is done for
    all pairs at a merge. Whether a pair came up again after it was merged."""
    names = p.names
    places = np.flatnonzero(pair >= 0)
    order = places[np.argsort(pair[places], kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(pair[places], minlength=len(pairs)))]).tolist()
    first = len(pairs)
    counts, done = count[:first].tolist(), set(np.flatnonzero(merged[:first]).tolist())
    came: dict[int, list[int]] = {}  # by pair: places at which it came up since
    symbol, before, after, pair_at, weight = (memoryview(x) for x in (p.symbol, p.before, p.after, pair, weights))
    least = max(min_pairs, 1)
    heap = [(-n, names[pairs[k][0]], names[pairs[k][1]], k) for k, n in enumerate(counts) if n >= least]
    heapq.heapify(heap)
    again = False
    while heap and len(vocab) < vocab_size:
        most, left, right, best = heapq.heappop(heap)
        if (n := counts[best]) != -most:
            if least <= n < -most:  # a count that rose has its own entry
                heapq.heappush(heap, (-n, left, right, best))
            continue
        merges.append((left, right))
        product = left + right
        vocab.setdefault(product, len(vocab))
        made = number.setdefault(product, len(names))
        if made == len(names):
            names.append(product)
        at = came.pop(best, [])
        if best < first:
            at += order[ends[best] : ends[best + 1]].tolist()
        new: dict[int, float] = {}
        for x in sorted(set(at)):
            if pair_at[x] != best:
                continue
            y, w = after[x], weight[x]
            u, v = before[x], after[y]
            symbol[x], symbol[y] = made, DEAD
            after[x], before[v] = v, x
            if (k := pair_at[y]) >= 0:
                counts[k] -= w
                if k in new:
                    new[k] -= w
                pair_at[y] = -1
            pair_at[x] = -1
            for z, key in ((u, (symbol[u], made)), (x, (made, symbol[v]))):
                if key[0] < 0 or key[1] < 0:
                    continue
                if (k := pair_at[z]) >= 0:
                    counts[k] -= w
                    if k in new:
                        new[k] -= w
                k = known.get(key)
                if k is None:
                    k = known[key] = len(pairs)
                    pairs.append(key)
                    counts.append(0.0)
                pair_at[z] = k
                counts[k] += w
                new[k] = new.get(k, 0.0) + w
                came.setdefault(k, []).append(z)
        counts[best] = 0.0
        done.add(best)
        for k, n in new.items():
            again = again or (n > 0 and k in done)
            if n > 0 and counts[k] >= least:
                heapq.heappush(heap, (-counts[k], names[pairs[k][0]], names[pairs[k][1]], k))
    return again


def encoded(codes: np.ndarray, starts: np.ndarray, t: Tokenizer) -> np.ndarray:
    """The places at which a token begins when each unit is encoded as by Tokenizer.encode_unit."""
    p = Pairs(codes)
    number = {c: k for k, c in enumerate(p.names)}
    for a, b in t.merges:
        for c in (a, b, a + b):
            number.setdefault(c, len(number))
    n = len(number)
    none = len(t.merges)
    ranks = {(number[a], number[b]): k for (a, b), k in t.ranks.items()}
    made = {k: number[a + b] for (a, b), k in t.ranks.items()}
    pairs = {k: x for x, k in ranks.items()}
    least: dict[int, int] = {}
    for (a, b), k in ranks.items():
        for c in (a, b):
            least[c] = min(least.get(c, none), k)
    keys = np.array([a * n + b for a, b in ranks] or [-1], np.int64)
    order = np.argsort(keys)
    keys, of_key = keys[order], np.array(list(ranks.values()) or [none], np.int64)[order]

    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * n + right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, of_key[at], none)

    symbol = p.symbol
    letters = len(p.names)
    first, second = symbol[:-1], symbol[1:]
    places = np.flatnonzero((first >= 0) & (second >= 0))
    if letters <= TABLE_LETTERS:
        table = np.full((letters, letters), none, np.int64)
        for (a, b), k in ranks.items():
            if a < letters and b < letters:
                table[a, b] = k
        found = table[first[places], second[places]] if letters else np.zeros(0, np.int64)
    else:
        found = ranked(first[places], second[places])
    rank = np.full(len(symbol), none, np.int64)
    rank[places] = found
    waiting: dict[int, list[np.ndarray]] = {}

    def wait(at: np.ndarray, found: np.ndarray) -> None:
        some = found < none
        at, found = at[some], found[some]
        if not len(at):
            return
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        for k, part in zip(found[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if k not in waiting:
                heapq.heappush(heap, k)
            waiting.setdefault(k, []).append(part)

    heap: list[int] = []
    wait(places, found)
    while heap:
        k = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(k)))
        at = at[rank[at] == k]
        if not len(at):
            continue
        (a, b), c = pairs[k], made[k]
        if least.get(c, none) <= k and len(at) > 1:  # what it makes may come first: the leftmost of each unit alone
            _, one = np.unique(np.searchsorted(starts, at, "right"), return_index=True)
            if len(one) < len(at):
                rest = np.delete(at, one)
                at = at[one]
                wait(rest, np.full(len(rest), k))
        at, gone, left = p.merge(at, a == b, c)
        rank[gone] = none
        rank[at] = none
        if c in least:
            right = symbol[p.after[at]]
            inner = at[right >= 0]
            now = np.concatenate([left, inner])
            own = np.full(len(now), c)
            own[: len(left)] = symbol[left]
            found = ranked(own, np.concatenate([np.full(len(left), c), right[right >= 0]]))
            rank[now] = found
            wait(now, found)
        else:
            rank[left] = none
    return symbol >= 0


def sizes_of(begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens of each unit."""
    total = np.concatenate([[0], np.cumsum(begins)])
    ends = np.append(starts[1:] - 1, len(begins) - 1)
    return total[ends] - total[starts]

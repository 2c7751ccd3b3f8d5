"""The five attacks on a manifest inside the task that holds its bin; as operators.attacks, whose names are followed."""

from __future__ import annotations

import numpy as np

from veilmark.operators import attacks, flat
from veilmark.operators.bpe import Tokenizer
from veilmark.operators.gathered import POOL, Bin, Encoder
from veilmark.operators.tokens import SPECIAL_TOKENS
from veilmark.operators.unitbags import TARGET, UNNUMBERED


class Matches:
    """The tokens that occur in each unit of some of a bin, once a unit."""

    def __init__(self, own: Bin, some: np.ndarray, tokens: list[str]) -> None:
        self.size = len(tokens)
        alphabet = {c: k for k, c in enumerate(sorted({c for t in tokens for c in t}), 1)}
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, t in enumerate(tokens):
            at = 0
            for c in t:
                after = nodes[at].get(alphabet[c])
                if after is None:
                    after = nodes[at][alphabet[c]] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = after
            if t:
                ends[at] = k
        step = np.zeros((len(nodes), len(alphabet) + 1), np.int32)
        for k, x in enumerate(nodes):
            if x:
                step[k, list(x)] = list(x.values())
        end = np.array(ends, np.int64)
        codes, _, _ = own.flat(some, some)
        table = np.zeros(max(int(codes.max(initial=0)), *(ord(c) for c in alphabet), 0) + 2, np.int32)
        table[[ord(c) for c in alphabet]] = list(alphabet.values())
        letter = np.where(codes >= 0, table[codes], 0)
        unit = np.cumsum(codes == flat.GAP) - 1
        at = np.flatnonzero(letter)
        node = step[0, letter[at]]
        keys, length = [], 0
        while len(at):
            live = node > 0
            at, node = at[live], node[live]
            length += 1
            whole = end[node] >= 0
            keys.append(np.unique(unit[at[whole]] * self.size + end[node[whole]]))  # tokens of one length
            node = step[node, letter[np.minimum(at + length, len(letter) - 1)]]
        found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.token = (found % self.size).astype(np.int32) if self.size else found
        count = np.zeros(len(own.place) + 1, np.int64)
        if self.size:
            count[some + 1] = np.bincount(found // self.size, minlength=len(some))
        self.first = np.cumsum(count)

    def counts(self, bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of each token in a bag, a token once for every occurrence of a unit that holds it."""
        at, counts = bag
        sizes = self.first[at + 1] - self.first[at]
        begins = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) + np.repeat(self.first[at] - begins, sizes)
        return np.bincount(self.token[places], np.repeat(counts, sizes), self.size).astype(np.int64)


def overlap(target: Tokenizer | None, shadows: dict[int, Tokenizer], inside: list[set[int]]) -> list[float | None]:
    """attacks.overlap_scores; None: a site without shadows on both sides."""
    ids = sorted(k for k in shadows if k != UNNUMBERED)
    place = {t: k for k, t in enumerate({t: 0 for x in (*([target] if target else []), *(shadows[i] for i in ids)) for t in x.vocab})}
    holds = np.zeros((len(place), len(ids)))
    for k, i in enumerate(ids):
        holds[[place[t] for t in shadows[i].vocab], k] = 1
    is_target = np.zeros(len(place), bool)
    is_target[[place[t] for t in target.vocab] if target else []] = True
    out: list[float | None] = []
    known: dict[tuple, float | None] = {}
    for site in inside:
        within = tuple(i in site for i in ids)
        if within not in known:
            w = np.array(within, float)
            own, others = w.sum(), len(ids) - w.sum()
            known[within] = None
            if own and others:
                # a token held on both sides of a site's shadows is left out for the site
                kept = ((holds @ w == 0) | (holds @ (1 - w) == 0)).astype(float)
                common = holds[is_target].T @ kept[is_target]
                union = kept[is_target].sum() + holds[~is_target].T @ kept[~is_target]
                share = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
                known[within] = float(((share * w).sum() / own - (share * (1 - w)).sum() / others + 1) / 2)
        out.append(known[within])
    return out


def merge_similarity(target: Tokenizer | None, shadows: dict[int, Tokenizer], inside: list[set[int]]) -> list[float | None]:
    """attacks.rank_correlations and merge_similarity_scores; None: a site without shadows on both sides."""
    r = {}
    for i, x in shadows.items():
        shared = [(k, target.vocab[t]) for t, k in x.vocab.items() if t in target.vocab] if target else []
        a, b = np.array(shared, float).reshape(-1, 2).T + 1
        a, b = (a - a.mean(), b - b.mean()) if len(a) > 1 else (a[:0], b[:0])
        scale = float(np.sqrt((a * a).sum() * (b * b).sum()))
        r[i] = float((a * b).sum()) / scale if scale > 0 else 0.0
    out: list[float | None] = []
    for site in inside:
        own = [x for i, x in r.items() if i in site and i != UNNUMBERED]
        others = [x for i, x in r.items() if i not in site or i == UNNUMBERED]
        out.append((sum(own) / len(own) - sum(others) / len(others) + 2) / 4 if own and others else None)
    return out


def rarity(vocab_size: int, alpha: float, xmin: int) -> np.ndarray:
    """attacks.zipf_rarity of the ranks from 1 on; not a number up to xmin."""
    rank, a = np.arange(1, vocab_size + 1, dtype=float), max(alpha, 0.0)
    mass = (np.arange(xmin + 1, max(vocab_size, xmin + 1) + 1, dtype=float) ** -a).sum()
    return np.where(rank >= xmin + 1, np.log(np.maximum(rank**a * mass, 1e-300)), np.nan)


def scores(own: Bin, manifest: int | None, target_size: int, shadow_size: int, groups: int, top_k: int) -> list[tuple]:
    """(attack, site_id, score) of a manifest's pool sites; for compression_rate the tokens instead of the score."""
    parts = own.parts[manifest]
    sites = parts.get(POOL, [])
    if not sites:
        return []
    encoder = Encoder.of(own, parts.get(TARGET, []), target_size)
    target = encoder.tokenizer if parts.get(TARGET) else None
    shadows = {i: own.trained(x, shadow_size) for i, x in parts.items() if i not in (TARGET, POOL)}
    out = [("compression_rate", s, float(n)) for s, n in zip(sites, encoder.site_tokens(sites))]
    trained_on = {i: set(x) for i, x in parts.items() if i in shadows and i != UNNUMBERED}
    inside = [{i for i, x in trained_on.items() if s in x} for s in sites]
    for name, values in (("vocabulary_overlap", overlap(target, shadows, inside)), ("merge_similarity", merge_similarity(target, shadows, inside))):
        out += [(name, s, x) for s, x in zip(sites, values) if x is not None]
    involved = set().union(*(x for i, x in trained_on.items() if i < groups))
    first = shadows.get(0)
    vocab = list(target.vocab) if target else []  # in the order of the ids from 0
    tokens = [*vocab, *(t for t in (first.vocab if first else ()) if not target or t not in target.vocab)]
    wanted = np.zeros(len(own.place), bool)
    for s in {*sites, *involved, *trained_on.get(0, ())}:
        wanted[own.bags[s][0]] = True
    matches = Matches(own, np.flatnonzero(wanted), tokens)
    counted = {s: matches.counts(own.bags[s]) for s in {*sites, *involved, *trained_on.get(0, ())}}
    none = np.zeros(len(tokens), np.int64)
    background = sum((counted[s] for s in involved), none)[: len(vocab)]
    rare = np.full(len(vocab), np.nan)
    if first:
        number = {t: k for k, t in enumerate(tokens)}
        weight = sum((counted[s] for s in trained_on[0]), none)
        points = [(k + 1, weight[number[t]]) for t, k in first.vocab.items() if len(t) > 1 and t not in SPECIAL_TOKENS and weight[number[t]] > 0]
        alpha, xmin = attacks.tail_fit(*np.array(sorted(points), float).T)[:2] if points else (attacks.FEW_POINTS_ALPHA, 1)
        rare = rarity(len(vocab), alpha, xmin)
    high = np.arange(len(vocab)) >= len(vocab) - top_k
    for s in sites:
        n = counted[s][: len(vocab)]
        denominator = background if s in involved else background + n
        some = (n > 0) & (background > 0) & ~np.isnan(rare)
        out.append(("frequency_estimation", s, float((n[some] / denominator[some] * rare[some]).max()) if some.any() else 0.0))
        some = (n > 0) & high
        p = n[some] / denominator[some]
        out.append(("naive_bayes", s, attacks.SATURATED if (p >= 1).any() else float(-np.log1p(-p).sum())))
    return out

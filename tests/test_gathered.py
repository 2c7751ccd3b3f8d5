"""Tokenizers trained and used in bins of manifests, against the functions that copy unit rows to every manifest."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmark import catalog
from veilmark.operators import bagpairs, bpe, flat, gathered, private_bpe, tokens, unitbags
from veilmark.plans import experiment, matrix

UNITS = st.dictionaries(st.text("abcd", min_size=1, max_size=9), st.integers(1, 9), min_size=1, max_size=20)


@given(UNITS, st.integers(4, 40), st.lists(st.text("abcdé", min_size=1, max_size=9), max_size=9), st.randoms())
@settings(max_examples=300, deadline=None)
def test_flat_merges_and_tokens_equal_plain_ones(units, size, others, rng):
    expected = bpe.learn_merges(units, size)
    codes, starts = flat.flat(list(units))
    codes, starts, weights = flat.chosen(codes, starts, np.arange(len(units)), np.array(list(units.values())))
    got, begins = flat.learn(codes, weights, size)
    assert got.merges == expected.merges and got.vocab == expected.vocab
    if begins is not None:
        assert flat.sizes_of(begins, starts).tolist() == [len(expected.encode_unit(u)) for u in units]
    merges = list(expected.merges)
    rng.shuffle(merges)
    for t in (expected, bpe.Tokenizer(expected.vocab, merges)):
        codes, starts = flat.flat(others)
        assert flat.sizes_of(flat.encoded(codes, starts, t), starts).tolist() == [len(t.encode_unit(u)) for u in others]


@pytest.fixture(scope="module")
def given_tables(spark):
    """Texts, roles and shadow training; site s0 is in all manifests, s9 has no texts, manifest 3 has no members."""
    words = "the then thin there hat heat this that aab aaab café naïve banana bandana".split()
    texts = [(n, f"s{n % 7}", " ".join(words[(n * k + k) % len(words)] for k in range(1, 9)) + (". No, a b!" if n % 3 else "")) for n in range(60)] + [(99, "s1", " "), (100, "s2", "!!! zzz")]
    roles = []
    for m in range(1, 4):
        inside = ["s0", f"s{m}", "s9"] if m < 3 else []
        roles += [(m, "target_member", x) for x in inside] + [(m, "target_nonmember", f"s{k}") for k in (m + 1, m + 3)]
        roles += [(m, "target_pool", x) for x in {*inside, f"s{m + 1}", f"s{m + 3}"}]
    training = [(m, k, f"s{(m + k + j) % 7}") for m in range(1, 4) for k in range(3) for j in range(3)]
    return (
        spark.createDataFrame(texts, "idx bigint, site_id string, text string"),
        spark.createDataFrame(roles, "manifest_id bigint, role string, site_id string"),
        spark.createDataFrame(training, "manifest_id bigint, shadow_id int, site_id string"),
    )


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("limit", [10**6, 30])
def test_trained_in_bins_as_by_key(spark, given_tables, monkeypatch, limit):
    texts, roles, training = given_tables
    bags = unitbags.site_bags(texts)
    units = unitbags.unit_rows(bags.select("site_id", "bag"))
    expected = _rows(bpe.train_target(units, roles, 40)), _rows(bpe.train_shadows(units, training, 30))
    monkeypatch.setattr(bpe, "LOCAL_UNITS", limit)  # 30: some manifests go the way of large ones
    trained = gathered.train(bags, gathered.members(roles).unionByName(gathered.shadows(training)), 40, 30)
    assert _rows(gathered.targets(trained)) == expected[0]
    assert _rows(trained.where("NOT target").drop("target")) == expected[1]

@pytest.mark.parametrize("limit", [10**6, 30])
def test_tokens_of_sites_as_by_joins(spark, given_tables, monkeypatch, limit):
    texts, roles, _ = given_tables
    bags = unitbags.site_bags(texts)
    units = unitbags.unit_rows(bags.select("site_id", "bag"))
    own = units.join(roles.where("role = 'target_pool'").select("manifest_id", "site_id"), "site_id")
    encoded = bpe.encode_each(own, bpe.train_target(units, roles, 40), "manifest_id")
    expected = _rows(bpe.tokens_by(own, encoded, "manifest_id", "site_id"))
    monkeypatch.setattr(bpe, "LOCAL_UNITS", limit)
    assert _rows(gathered.site_tokens(bags, gathered.members(roles).unionByName(gathered.pool(roles)), 40)) == expected


def _unused(*_, **__):
    raise AssertionError("unit rows are copied to every manifest")


@pytest.mark.parametrize("name", ["bpe_train", "bpe_shadows", "bpe_derived", "bpe_encode", "tokenizer_utility", "attack_results"])
def test_queries_copy_no_unit_rows(spark, small, monkeypatch, name):
    monkeypatch.setattr(bpe, "train_each", _unused)
    monkeypatch.setattr(bpe, "encode_each", _unused)
    assert catalog.queries()[name](spark, small).count() > 0


@pytest.mark.parametrize("limit", [10**6, 30])
def test_utility_as_by_joins(spark, given_tables, monkeypatch, limit):
    texts, roles, _ = given_tables
    bags = unitbags.site_bags(texts)
    units = unitbags.unit_rows(bags.select("site_id", "bag"))
    t = bpe.train_target(units, roles, 40)
    held = texts.join(roles.where("role = 'target_nonmember'").select("manifest_id", "site_id"), "site_id")
    expected = bpe.utility(held, lambda x: bpe.encode_each(x, t, "manifest_id"), "manifest_id")
    order = expected.columns
    expected = _rows(expected)
    monkeypatch.setattr(bpe, "LOCAL_UNITS", limit)
    got = gathered.utility(texts, bags, gathered.members(roles).unionByName(gathered.pool(roles, "target_nonmember")), 40)
    assert got.columns == order and _rows(got) == expected


def test_pairs_of_bags_equal_pairs_of_words(spark):
    rows = [(f"s{k % 3}", u, 1 + k) for k, u in enumerate("abab aaab abcab cabba bab aaaaa é éab".split())]
    units = spark.createDataFrame([*rows, ("s9", None, 3)], "site_id string, unit string, cnt bigint")
    bags = unitbags.bags_of_units(units)
    rounds = [[("a", "b"), ("c", "a")], [("ab", "a"), ("a", "a")], [("ab", "ab")]]
    words = tokens.words_of(units.where("unit IS NOT NULL"), "site_id").select("site_id", "symbols", "freq")
    for k in range(len(rounds) + 1):
        by_site = tokens.symbol_pairs(words, "site_id").collect()
        expected = Counter()
        for r in by_site:
            expected[r.left, r.right] += r.cnt
        got = Counter()
        for r in bagpairs.pair_counts(bags, rounds[:k]).collect():
            got[r.left, r.right] += r.cnt
        assert got == expected
        pairs = sorted(expected, reverse=True)
        values = {(r.site_id, pairs[r.coord]): r.value for r in bagpairs.vectors(bags, rounds[:k], pairs).collect()}
        assert values == {(s, p): 0 for s in ("s0", "s1", "s2", "s9") for p in pairs} | {(r.site_id, (r.left, r.right)): r.cnt for r in by_site}
        norms = {r.site_id: r.norm for r in bagpairs.vectors(bags, rounds[:k], pairs, norms=True).collect()}
        assert norms == {s: sum(n for (x, _), n in values.items() if x == s) for s in ("s0", "s1", "s2", "s9")}
        if k < len(rounds):
            words = private_bpe.apply_merges(words, rounds[k])
    assert bagpairs.letters(bags) == ["a", "b", "c", "é"]


def test_private_training_writes_no_words(spark, small, monkeypatch):
    monkeypatch.setattr(tokens, "words_of", _unused)
    assert catalog.queries()["private_training"](spark, small).count() > 0


@pytest.mark.parametrize("limit", [10**6, 30])
def test_attacks_in_bins_as_by_joins(spark, given_tables, monkeypatch, limit):
    texts, roles, training = given_tables
    texts = texts.where("trim(text) <> ''").select("site_id", "text")
    bags = unitbags.site_bags(texts)
    units = unitbags.unit_rows(bags.select("site_id", "bag"))
    rounded = lambda df: sorted((r.run_id, r.manifest_id, r.attack, r.site_id, r.is_member, float(f"{r.score:.9g}")) for r in df.collect())
    expected = rounded(experiment.five_attacks(units, texts, roles, training, 40, 30, 2, 12))
    assert {r[2] for r in expected} == {*matrix.ATTACKS}
    monkeypatch.setattr(bpe, "LOCAL_UNITS", limit)
    assert rounded(experiment.packed_attacks(bags, texts, roles, training, 40, 30, 2, 12)) == expected


def test_attack_results_does_the_whole_job(spark, small, monkeypatch):
    """As the reference's main configuration: no smaller tokenizers, background or list of scored tokens."""
    used = []
    monkeypatch.setattr(catalog, "packed_attacks", lambda *x: used.append(x[4:]) or experiment.packed_attacks(*x))
    assert catalog.queries()["attack_results"](spark, small).count() > 0
    assert used == [(16_000, 16_000, 10, 20_000)]


@pytest.mark.parametrize("few", [0, 6, 10**9])
def test_merges_place_by_place_equal_plain_ones(monkeypatch, few):
    monkeypatch.setattr(flat, "FEW_PLACES", few)
    rng = random.Random(few)
    for _ in range(400):
        units = {"".join(rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(1, 12))): rng.randint(1, 9) for _ in range(rng.randint(1, 25))}
        expected = bpe.learn_merges(units, size := rng.randint(4, 60))
        codes, starts, weights = flat.chosen(*flat.flat(list(units)), np.arange(len(units)), np.array(list(units.values())))
        got, begins = flat.learn(codes, weights, size)
        assert got.merges == expected.merges and got.vocab == expected.vocab
        assert begins is None or flat.sizes_of(begins, starts).tolist() == [len(expected.encode_unit(u)) for u in units]

"""Properties of the engine's operators on small fixtures."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.operators import attacks, bpe, classifier, corpus, metrics, paillier, privacy, private_bpe, reporting, roles, tokens, unitbags


# ---- text and corpus


@pytest.mark.parametrize("url, host", [
    ("https://WWW.Foo.Example./x", "foo.example"), (" http://user:pw@a.b.test:80/", "a.b.test"), ("https://bücher.example/", "xn--bcher-kva.example"), ("mailto:x", None), ("https:///96", None),
    ("not a url", None), ("http://localhost/", None), ("http://" + "a." * 130 + "test/", None), (None, None), ("", None), ("//c.test/p", "c.test"),
])
def test_normal_host(spark, url, host):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(T.normal_host(F.col("url"))).first()[0] == host


def test_normalized_text(spark):
    df = spark.createDataFrame([("  A\tB \n c",), ("ＡＢ  ß İ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.normalized(F.col("t"))).collect()] == ["a b c", "ab ss i̇", None, ""]


def test_reasons_in_order(spark):
    good = "the letters of a text " * 12
    rows = [None, " ", "short", "x" * 50_001, "1 2 3 " * 60, good, "д" * 300, good[:199].strip() + "\0" + good]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = [r[0] for r in df.select(corpus.reject_reason(F.col("text"))).collect()]
    assert got == ["empty_text", "empty_text", "too_short", "too_long", "language_anomaly", None, "language_anomaly", "encoding_anomaly"]


@pytest.mark.parametrize("seed", range(4))
def test_sequential_retention(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"s{rng.randrange(4)}", f"h{rng.randrange(25)}") for k in range(60)]
    df = spark.createDataFrame(rows, "idx bigint, site_id string, norm_hash string")
    expected = corpus.sequential_reference(pd.DataFrame(rows, columns=["idx", "site_id", "norm_hash"]), 3)
    assert sorted(r.idx for r in corpus.retained_sequential(df, 3).collect()) == sorted(expected["idx"])


def test_scan_limit(spark):
    rows = [(k, f"s{k % 12}") for k in range(36)]
    df = spark.createDataFrame(rows, "idx bigint, site_id string")
    assert corpus.scan_limit(df, 3, 8, 3, 4).first()["scan_limit"] == 36
    assert corpus.scan_limit(df, 4, 8, 3, 4).first()["scan_limit"] is None


def test_probes_are_balanced(spark):
    sites = spark.createDataFrame([(f"s{k}",) for k in range(31)], "site_id string")
    for shadows in (8, 32, 96):
        held = Counter()
        for r in roles.balanced_probes(sites, shadows, 5).collect():
            for p in [x for x in roles.SHADOW_PREFIXES if x <= shadows]:
                held[r.site_id, p] += r.shadow_id < p
        assert all(2 * n == p for (_, p), n in held.items())
    parity = roles.balanced_probes_parity([f"s{k}" for k in range(31)], 96, 5)
    assert all(sum(f"s{k}" in parity[s] for s in range(p)) * 2 == p for k in range(31) for p in roles.SHADOW_PREFIXES)


# ---- tokens and vocabularies


@given(st.lists(st.sampled_from("ab"), max_size=12))
@settings(max_examples=100, deadline=None)
def test_merge_rewrite_keeps_the_word(symbols):
    merged = bpe.merge_pair(symbols, {("a", "b"): "ab", ("b", "b"): "bb"})
    assert "".join(merged) == "".join(symbols)


def test_learned_merges_follow_a_full_recount():
    units = {"abab": 5, "abc": 3, "bcbc": 2, "cab": 4}
    t = bpe.learn_merges(units, 5 + 3 + 4)
    words = {u: list(u) for u in units}
    for pair in t.merges:
        counts = Counter()
        for u, s in words.items():
            for p in zip(s, s[1:]):
                counts[p] += units[u]
        assert pair == min(counts, key=lambda p: (-counts[p], p))
        words = {u: bpe.merge_pair(s, {pair: "".join(pair)}) for u, s in words.items()}
    assert t.encode_unit("abc") == words["abc"] and t.encode_unit("xab")[0] == "[UNK]"


@given(st.dictionaries(st.text("abcd", min_size=1, max_size=7), st.integers(1, 9), min_size=2, max_size=25))
@settings(max_examples=200, deadline=None)
def test_sure_merges_are_the_next_ones(units):
    merges = bpe.learn_merges(units, 40).merges
    counts = Counter()
    for u, n in units.items():
        for p in zip(u, u[1:]):
            counts[p] += n
    top = sorted((-n, *p) for p, n in counts.items() if n >= 2)
    if top:
        k = bpe.sure_prefix([(-n, a, b) for n, a, b in top])
        assert k >= 1 and [tuple(p) for _, *p in top[:k]] == merges[:k]


def test_rounds_learn_the_same_merges(spark):
    units = {"abab": 9, "abcd": 6, "cdcd": 5, "dab": 4, "aab": 1}
    expected = bpe.learn_merges(units, 13)
    got = bpe.train(spark.createDataFrame(list(units.items()), "unit string, cnt bigint"), 13, local_units=3)
    assert got.merges == expected.merges and got.vocab == expected.vocab


def test_tokenizers_by_key(spark, tmp_path, monkeypatch):
    rows = [(m, u, n + m) for m in (1, 2) for u, n in (("abab", 5), ("abc", 3), ("cab", 4 * m))] + [(1, None, 3)]
    df = spark.createDataFrame(rows, "m int, unit string, cnt bigint")
    found = {m: bpe.learn_merges({u: n for k, u, n in rows if k == m and u}, 12) for m in (1, 2)}
    table = bpe.train_each(df, 12, "m")
    got = {(r.m, r.n): (r.left, r.right) for r in table.where("kind = 'merge'").collect()}
    assert got == {(m, k): p for m, t in found.items() for k, p in enumerate(t.merges)}
    monkeypatch.setattr(bpe, "LOCAL_UNITS", 2)
    large = bpe.train_each(df.where("m = 1"), 10, "m").where("kind = 'merge'").orderBy("n").collect()
    assert [(r.left, r.right) for r in large] == bpe.learn_merges({u: n for k, u, n in rows if k == 1 and u}, 10).merges
    encoded = {(r.m, r.unit): list(r.tokens) for r in bpe.encode_each(df.where("unit IS NOT NULL"), table, "m", blocks=2).collect()}
    assert encoded == {(m, u): found[m].encode_unit(u) for m, u, _ in rows if u}
    vocab = bpe.vocabularies(table, "m")
    small = bpe.derive_each(table, tokens.truncated_vocab(vocab, 9, "m"), "m")
    for m, t in found.items():
        cut = bpe.truncate(t, 9)
        assert {r.token: r.n for r in small.where(f"m = {m} AND kind = 'token'").collect()} == cut.vocab
        assert [(r.left, r.right) for r in small.where(f"m = {m} AND kind = 'merge'").orderBy("n").collect()] == cut.merges
    metadata = bpe.publish(found[1], str(tmp_path / "t"), "plain", 12, manifest_sha256="x")
    again, loaded = bpe.load(str(tmp_path / "t"), manifest_sha256="x")
    assert again.merges == found[1].merges and loaded == metadata
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "t"), manifest_sha256="y")
    with pytest.raises(FileExistsError):
        bpe.publish(found[1], str(tmp_path / "t"), "plain", 12)


def test_thresholds_share_one_count(spark):
    vocab = spark.createDataFrame([("a", 0), ("[UNK]", 1), ("b", 2)], "token string, id int")
    counts = spark.createDataFrame([("a", 3), ("b", 9)], "token string, cnt bigint")
    got = {(r.least, r.token): r.id for r in tokens.min_count_vocab(vocab, counts, [1, 5, 50]).collect()}
    assert got == {(1, "a"): 0, (1, "[UNK]"): 1, (1, "b"): 2, (5, "[UNK]"): 0, (5, "b"): 1, (50, "[UNK]"): 0}
    assert [r.token for r in tokens.min_count_vocab(vocab.where("token <> '[UNK]'"), counts, 5).orderBy("id").collect()] == ["[UNK]", "b"]


def test_truncation_and_min_count():
    t = bpe.learn_merges({"abab": 5, "abc": 3, "cab": 4}, 20)
    small = bpe.truncate(t, 9)
    assert len(small.vocab) == 9 and set(small.vocab.values()) == set(range(9)) and all(a + b in small.vocab for a, b in small.merges)
    kept = bpe.min_count(t, {"ab": 9}, 5)
    assert "ab" in kept.vocab and "[UNK]" in kept.vocab and "c" not in kept.vocab and kept.merges == []


def test_substrings_by_automaton_and_expansion(spark, monkeypatch):
    units = spark.createDataFrame([("abcab", 2), ("x" * 70 + "ab" + "y" * 30, 1), ("", 1), ("no", 1)], "unit string, cnt bigint")
    vocab = spark.createDataFrame([("ab",), ("b",), ("xx",), ("zz",), ("y" * 30,), ("",)], "token string")
    long = "x" * 70 + "ab" + "y" * 30
    expected = {("abcab", "ab"), ("abcab", "b"), (long, "ab"), (long, "b"), (long, "xx"), (long, "y" * 30)}
    assert {tuple(r) for r in tokens.substring_tokens(units, vocab).collect()} == expected
    assert tokens.substring_tokens(units, vocab.limit(0)).count() == 0
    monkeypatch.setattr(tokens, "AUTOMATON_TOKENS", 2)
    assert {tuple(r) for r in tokens.substring_tokens(units, vocab).collect()} == expected


def test_fixed_length(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([9, 99],), ([],)], "ids array<int>")
    got = [r[0] for r in tokens.fixed_length(df, 5, 100, 101, 0, 7, 50).collect()]
    assert got == [[100, 1, 2, 3, 101], [100, 9, 7, 101, 0], [100, 101, 0, 0, 0]]


# ---- scores and metrics


@pytest.mark.parametrize("count", [5, 96])
def test_overlap_scores_follow_the_definition(spark, count):
    rng = random.Random(3)
    names = [f"t{k}" for k in range(60)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    target, shadows, training = {}, {}, {}
    for m in (1, 2):
        target[m] = set(rng.sample(names, 25))
        shadows[m] = {s: set(rng.sample(names, 22)) for s in range(count)}
        training[m] = {s: set(rng.sample("abcdef", 3)) for s in shadows[m]}
    got = {(r.m, r.site_id): r.score for r in attacks.overlap_scores(
        frame([(m, t, 0) for m in target for t in target[m]], "m int, token string, id int"), frame([(m, s, t, 0) for m in shadows for s, v in shadows[m].items() for t in v], "m int, shadow_id int, token string, id int"),
        frame([(m, s, x) for m in training for s, v in training[m].items() for x in v], "m int, shadow_id int, site_id string"), frame([(m, x) for m in target for x in "abcdefg"], "m int, site_id string"), "m",
    ).collect()}
    for m in target:
        for site in "abcdef":
            inside, outside = ([shadows[m][s] for s in shadows[m] if (site in training[m][s]) == w] for w in (True, False))
            if not inside or not outside:
                assert (m, site) not in got
                continue
            out = set.union(*inside) & set.union(*outside)
            j = lambda v: len((v - out) & (target[m] - out)) / max(1, len((v - out) | (target[m] - out)))  # noqa: B023, E731
            assert got[m, site] == pytest.approx((np.mean([j(v) for v in inside]) - np.mean([j(v) for v in outside]) + 1) / 2)


def test_metric_edges(spark):
    cases = {"perfect": [(1, 2.0), (1, 1.5), (0, 1.0)], "reversed": [(0, 2.0), (1, 1.0)], "constant": [(1, 1.0), (0, 1.0), (0, 1.0)], "one class": [(1, 1.0)]}
    df = spark.createDataFrame([(k, f"s{n}", y, s) for k, v in cases.items() for n, (y, s) in enumerate(v)], "run string, site_id string, label int, score double")
    got = {r.run: r.roc_auc for r in metrics.scalar_metrics(df, "run").collect()}
    assert got == {"perfect": 1.0, "reversed": 0.0, "constant": 0.5}


@pytest.mark.parametrize("seed", range(3))
def test_metrics_on_tied_scores(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 12, 80).astype(float)
    df = spark.createDataFrame([(0, f"s{k}", int(a), float(b)) for k, (a, b) in enumerate(zip(y, s))], "run int, site_id string, label int, score double")
    row = metrics.scalar_metrics(df, "run").first().asDict()
    for name, (value,) in metrics.weighted_metrics(y, s, np.ones((1, len(y)), int)).items():
        assert row[name] == pytest.approx(value, abs=1e-12)
    wins = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert row["roc_auc"] == pytest.approx(wins)


def test_intervals_hold_their_value_and_repeat(spark):
    df = spark.createDataFrame([("r", f"s{k}", k % 2, float(k % 7 + k % 2)) for k in range(60)], "run string, site_id string, label int, score double")
    first = {r.metric: (r.lower, r.upper) for r in metrics.bootstrap_intervals(df, "run", 100).collect()}
    point = metrics.scalar_metrics(df, "run").first().asDict()
    assert all(a <= point[m] <= b for m, (a, b) in first.items())
    assert first == {r.metric: (r.lower, r.upper) for r in metrics.bootstrap_intervals(df.repartition(7), "run", 100).collect()}


def test_unpaired_sites_are_an_error(spark):
    a = spark.createDataFrame([("x", 1, 0.5)], "site_id string, label int, score double")
    with pytest.raises(Exception, match="unpaired"):
        metrics.paired_rows(a, a.withColumn("label", F.lit(0))).collect()


def test_zipf_fit_finds_the_exponent(spark):
    rows = [(m, f"tok{k}", k, int(1e7 * (k + 1) ** -a)) for m, a in ((1, 1.7), (2, 2.5)) for k in range(400)] + [(3, "[UNK]", 0, 5)]
    fits = attacks.fit_zipf(spark.createDataFrame([r[:3] for r in rows], "m int, token string, id int"), spark.createDataFrame([(m, t, n) for m, t, _, n in rows], "m int, token string, cnt bigint"), "m")
    f = {r.m: r for r in fits.collect()}
    assert 1.5 < f[1].alpha < 2.0 and f[1].ks < 0.1 and 2.2 < f[2].alpha < 2.8 and (f[3].alpha, f[3].xmin, f[3].points) == (2.0, 1, 0)
    assert attacks.hurwitz_zeta(2.0, 1.0) == pytest.approx(np.pi**2 / 6)


def test_zipf_fit_is_the_likeliest():
    rng = np.random.default_rng(4)
    rank = np.sort(rng.choice(2000, 150, False)) + 1.0
    weight = np.ceil(1e6 * rank**-1.4 * rng.uniform(0.5, 2, 150))
    alpha, xmin, _, _ = attacks.tail_fit(rank, weight)
    tail = rank >= xmin
    cost = lambda a: a * (weight[tail] @ np.log(rank[tail])) + weight[tail].sum() * np.log(attacks.hurwitz_zeta(a, xmin))
    assert cost(alpha) <= min(cost(alpha - 1e-3), cost(alpha + 1e-3))


# ---- privacy and encryption


@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(1, 60))
@settings(max_examples=10, deadline=None)
def test_clipping(spark, values, bound):
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "site_id string, coord int, value bigint")
    got = {r.coord: r.value for r in privacy.l1_clip(df, bound).collect()}
    norm = sum(values)
    assert sum(got.values()) == min(norm, bound) and all(0 <= got[k] <= v for k, v in enumerate(values))


def test_clipping_of_large_values(spark):
    df = spark.createDataFrame([("s", k, str(v)) for k, v in enumerate((2**70, 7, 5, 3))], "site_id string, coord int, value string")
    got = [r.value for r in privacy.l1_clip(df, 17).orderBy("coord").collect()]
    assert sum(got) == 17 and got[0] == 17
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate((9, 7, 5, 3))], "site_id string, coord int, value bigint")
    assert [r.value for r in privacy.l1_clip(df, 17).orderBy("coord").collect()] == [6, 5, 4, 2]


def test_noise_and_accounting():
    draw = privacy.two_sided_geometric(1.0, 1, 20_000, np.random.default_rng(0))
    assert abs(np.mean(draw)) < 0.05 and abs(np.var(draw) - 2 * np.exp(-1) / (1 - np.exp(-1)) ** 2) < 0.1
    assert privacy.composed([0.1] * 10)["epsilon"] == 1.0 and privacy.round_budget(8.0, 4) == 2.0
    with pytest.raises(ValueError):
        privacy.two_sided_geometric(0.0, 1, 1, np.random.default_rng(0))


@given(st.lists(st.tuples(st.sampled_from(["a", "b", "ab", "c"]), st.sampled_from(["a", "b", "c"]), st.integers(-3, 5)), min_size=1, max_size=15), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_compatible_choice(rows, batch):
    pairs, values = [(a, b) for a, b, _ in rows], [v for _, _, v in rows]
    chosen = privacy.compatible_top(values, pairs, batch)
    assert len(chosen) <= batch and chosen == sorted(chosen, key=lambda k: (-values[k], k))
    lefts, rights = {pairs[k][0] for k in chosen}, {pairs[k][1] for k in chosen}
    assert len({"".join(pairs[k]) for k in chosen}) == len(chosen)
    assert all(not (pairs[i][0] == pairs[j][1]) for n, i in enumerate(chosen) for j in chosen[:n]) and lefts and rights


def test_encrypted_sums_equal_plain_sums(spark):
    key = paillier.generate_keys(1024)
    rows = [(s, c, v) for s in range(3) for c, v in enumerate((0, 2**48, -5, 7 * s))]
    df = spark.createDataFrame(rows, "site int, coord int, value bigint")
    sums = paillier.encrypted_sums(paillier.encrypted(df, key.public), key.public)
    noise = spark.createDataFrame([(c, -c) for c in range(4)], "coord int, value bigint")
    assert paillier.decrypted(paillier.add_encrypted_noise(sums, noise, key.public), key) == [0, 3 * 2**48 - 1, -17, 21 - 3]
    with pytest.raises(ValueError):
        paillier.generate_keys(512)


def test_packed_sums_equal_plain_sums(spark):
    key = paillier.generate_keys(1024)
    rows = [(m, f"s{k}", c, (c - 20) * (k + m) * 10**6) for m in (1, 2) for k in range(3) for c in range(40)]
    df = spark.createDataFrame(rows, "m int, site_id string, coord int, value bigint")
    sums = paillier.encrypted_sums(paillier.encrypted_packed(df, key.public, "m"), key.public, "m")
    got = {(m, c): v for m, c, v in paillier.unpacked(paillier.decrypted(sums, key, "m"), 40, key.public)}
    assert got == {(m, c): (c - 20) * (3 + 3 * m) * 10**6 for m in (1, 2) for c in range(40)} and sums.count() == 6


def _sites(spark, names):
    rows = [(s, u, n) for k, s in enumerate(names) for u, n in (("abab", 3 + k), ("abc", 2), ("cabba", 1 + k))]
    return spark.createDataFrame(rows, "site_id string, unit string, cnt bigint")


def test_private_training_modes(spark):
    public, private = _sites(spark, ["p1", "p2"]), _sites(spark, ["s1", "s2"])
    make = lambda **x: private_bpe.PrivateTraining(public, private, vocab_size=12, pool=8, batch=2, **x)
    plain = make().run()
    assert 10 <= len(plain.vocab) <= 12
    key = paillier.generate_keys(1024)
    assert make(mode="he_only", keys=key).run().merges == plain.merges
    clear, cipher = make(mode="sa_dp", epsilon=4.0), make(mode="sa_dp", epsilon=4.0, keys=key)
    assert clear.run().merges == cipher.run().merges and sum(clear.budgets) <= 4.0 + 1e-9
    for options in ({}, {"mode": "local_dp", "epsilon": 9.0}):
        straight, first = make(**options), make(**options)
        first.advance()
        assert make(**options, **first.state()).run().merges == straight.run().merges
    with pytest.raises(ValueError):
        private_bpe.PrivateTraining(public, public, vocab_size=12)


def test_incremental_words_equal_retokenised_ones(spark):
    words = tokens.words_of(_sites(spark, ["a", "b"]), "site_id")
    merges = [("a", "b"), ("c", "a")]
    got = {(r.site_id, "|".join(r.symbols), r.freq) for r in private_bpe.apply_merges(words.select("site_id", "symbols", "freq"), merges).collect()}
    table = {m: "".join(m) for m in merges}
    assert got == {(r.site_id, "|".join(bpe.merge_pair(list(r.unit), table)), r.cnt) for r in _sites(spark, ["a", "b"]).collect()}


# ---- reports


def test_scaling_model_of_exact_costs(spark):
    cells = spark.createDataFrame([(c, k, 0.5 + 0.01 * k + 0.002 * c * k) for c in (2, 4, 8, 16) for k in (128, 512, 1024)], "clients int, k int, seconds double")
    rows = {r.model: r for r in reporting.scaling_models(cells, "seconds").collect()}
    assert rows["M4"].chosen and rows["M4"].r2 > 0.999999
    point, low, high = reporting.predicted_interval(cells, "seconds", "M4", 32.0, 2048.0, 50)
    assert low <= point <= high and point == pytest.approx(0.5 + 20.48 + 0.002 * 32 * 2048, rel=1e-6)


def test_linear_extrapolation(spark):
    df = spark.createDataFrame([("shadow", 4.0, 2), ("shadow", 5.0, 3), ("target", 0.0, 3)], "role string, elapsed_seconds double, artifact_bytes bigint")
    assert tuple(reporting.resource_extrapolation(df, 1, 12).first()) == (108.0, 63)


def test_classifier(spark):
    rng = random.Random(0)
    rows = [(k % 2, [rng.choice("abc" if k % 2 else "xyz") for _ in range(8)]) for k in range(120)]
    df = classifier.features(spark.createDataFrame(rows, "label int, tokens array<string>"), "tokens", 64)
    _, score = classifier.trained(df.limit(80), df, (0.01,), 10)
    assert score > 0.95


def test_packed_sums_equal_unit_rows(spark):
    rows = [(f"s{k % 4}", " ".join(f"w{k * j % 7}" for j in range(1, 9)) + " w1w") for k in range(12)] + [("s9", "of no group"), ("s1", None), ("s2", "")]
    texts = spark.createDataFrame(rows, "site_id string, text string")
    members = spark.createDataFrame([(1, "s0"), (1, "s1"), (2, "s2"), (None, "s3")], "manifest_id bigint, site_id string")
    plans = [(1, 0, "s1"), (1, 0, "s2"), (1, None, "s3"), (2, 1, "s0"), (2, 1, "s9"), (2, 2, "absent")]
    training = spark.createDataFrame(plans, "manifest_id bigint, shadow_id int, site_id string")
    bags = unitbags.site_bags(texts)
    units = tokens.unit_counts(texts, "site_id")
    order = lambda df: sorted(map(repr, df.collect()))
    assert bags.count() == 5 and order(unitbags.unit_rows(bags)) == order(units)
    lists = unitbags.top_units(bags, members, training, 6, 4)
    assert order(unitbags.target_rows(lists)) == order(tokens.top_units_as_vocab(units.join(members, "site_id"), 6, "manifest_id"))
    assert order(unitbags.shadow_rows(lists)) == order(tokens.top_units_as_vocab(units.join(training, "site_id"), 4, "manifest_id", "shadow_id"))
    vocab = unitbags.target_rows(lists).where("manifest_id IS NOT NULL")
    involved = training.select("manifest_id", "site_id").distinct()
    counts = tokens.token_counts(units, tokens.substring_tokens(units, vocab), "site_id")
    own = counts.join(members.unionByName(involved).distinct(), "site_id").join(vocab.select("manifest_id", "token"), ["manifest_id", "token"], "left_semi")
    background = unitbags.background(bags, vocab, involved, "manifest_id")
    expected = tokens.background_counts(own, involved, "manifest_id")
    assert order(background.select("manifest_id", "token", "cnt")) == order(expected.select("manifest_id", "token", "cnt"))
    law = spark.createDataFrame([(1, 1.2, 2), (2, 1.2, 2)], "manifest_id bigint, alpha double, xmin int")
    sites = members.where("manifest_id IS NOT NULL")
    got = unitbags.frequency_scores(bags, background, attacks.zipf_rarity(vocab, law, "manifest_id"), involved, sites, "manifest_id")
    assert order(got) == order(attacks.frequency_scores(own.join(sites, ["manifest_id", "site_id"]), expected, involved, vocab, sites, law, "manifest_id"))

"""Problems 5, 7, 9 and 10 against brute force and on edge cases."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmark.llm import leakage, overlap, splits, subjects
from veilmark.llm.textform import words


def brute(rows, manifests):
    bags = {k: Counter(words(t)) for k, (_, t) in rows.items() if t and words(t)}
    out = set()
    for a, b in combinations(sorted(bags), 2):
        common = sum((bags[a] & bags[b]).values())
        if 5 * common >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - common):
            for m, (members, others) in manifests.items():
                sa, sb = rows[a][0], rows[b][0]
                if sa in members and sb in others or sb in members and sa in others:
                    out.add((m, a, b))
    return out


def texts_of(rng):
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 8, 20, 60, 140)))] for _ in range(60)]
    rows = {}
    for k in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, max(1, len(w) // 20), len(w) // 10, len(w) // 4))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            rng.shuffle(w)
        rows[k] = (f"s{rng.randrange(12)}", " ".join(w) if rng.random() < 0.5 else ", ".join(w).upper() + ".")
    return rows


def test_cross_split_against_brute_force(spark):
    rng = random.Random(5)
    rows = texts_of(rng)
    rows |= {900: ("s0", None), 901: ("s1", ""), 902: ("s1", " ! "), 903: (None, rows[0][1])}
    manifests = {1: ({"s0", "s1", "s2"}, {"s3", "s4", "s5"}), 2: ({"s3", "s6"}, {"s0", "s7", "s6"}), 3: (set(), {"s1"})}
    df = spark.createDataFrame([(k, s, t, 1) for k, (s, t) in rows.items()] + [(0, *rows[0], 1)], "source_record_index bigint, site_id string, text string, side int")
    plans = spark.createDataFrame([(m, [*a, None, *a], list(b)) for m, (a, b) in manifests.items()] * 2, f"manifest_id bigint, {overlap.MEMBER} array<string>, {overlap.NONMEMBER} array<string>")
    got = {tuple(r) for r in overlap.cross_split(df, plans).collect()}
    expected = brute(rows, manifests)
    assert expected and got == expected


def test_cross_split_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ALL_PAIRS_UP_TO", 10)
    text = " ".join(f"w{k}" for k in range(40))
    near = text.replace("w7 ", "v7 ")
    rows = [(k, f"s{k % 4}", text) for k in range(40)] + [(100, "s1", near)]
    df = spark.createDataFrame(rows, "source_record_index bigint, site_id string, text string")
    plans = spark.createDataFrame([(1, ["s0"], ["s1"])], f"manifest_id bigint, {overlap.MEMBER} array<string>, {overlap.NONMEMBER} array<string>")
    got = {(a, b) for _, a, b in overlap.cross_split(df, plans).collect()}
    assert {x for p in got for x in p} == {k for k in range(40) if k % 4 < 2} | {100}
    assert len(got) < 60


def test_cross_split_of_different_texts_with_equal_bags(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ALL_PAIRS_UP_TO", 10)
    text = [f"w{k}" for k in range(40)]
    rows = {k: (f"s{k % 2}", " ".join(text[k // 2 :] + text[: k // 2])) for k in range(40)}
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "source_record_index bigint, site_id string, text string")
    plans = spark.createDataFrame([(1, ["s0"], ["s1"])], f"manifest_id bigint, {overlap.MEMBER} array<string>, {overlap.NONMEMBER} array<string>")
    expected = brute(rows, {1: ({"s0"}, {"s1"})})
    assert len(expected) == 400 and {tuple(r) for r in overlap.cross_split(df, plans).collect()} == expected


def test_copies_beyond_the_limit_keep_their_links_to_other_texts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ALL_PAIRS_UP_TO", 5)
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"s{k % 2}", text, None) for k in range(10)] + [(50, "s2", text.replace("w7 ", "v7 "), None), (51, "s3", text, None)]
    df = spark.createDataFrame(rows, "source_record_index bigint, site_id string, text string, variant string")
    plans = spark.createDataFrame([(1, ["s0", "s1"], ["s2"]), (2, ["s0"], ["s1", "s3"])], f"manifest_id bigint, {overlap.MEMBER} array<string>, {overlap.NONMEMBER} array<string>")
    got = {tuple(r) for r in overlap.cross_split(df, plans).collect()}
    assert {p for p in got if p[0] == 1} == {(1, k, 50) for k in range(10)}
    assert {x for m, *p in got if m == 2 for x in p} == {*range(10), 51}
    classes = {tuple(r) for r in overlap.identical_members(df).collect()}
    assert classes == {(k, 0) for k in [*range(10), 51]} | {(50, 50)}


def test_cross_split_empty(spark):
    df = spark.createDataFrame([], "source_record_index bigint, site_id string, text string")
    plans = spark.createDataFrame([], f"manifest_id bigint, {overlap.MEMBER} array<string>, {overlap.NONMEMBER} array<string>")
    assert overlap.cross_split(df, plans).count() == 0


def test_hot_keys_are_refined(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_KEY", 5)
    rng = random.Random(6)
    rows = {k: (f"s{k % 2}", " ".join(["rare"] + [f"w{rng.randrange(50)}" for _ in range(30)])) for k in range(60)}
    rows |= {k + 100: ("s1", rows[k][1] + " more") for k in range(0, 60, 2)}
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "source_record_index bigint, site_id string, text string")
    plans = spark.createDataFrame([(1, ["s0"], ["s1"])], f"manifest_id bigint, {overlap.MEMBER} array<string>, {overlap.NONMEMBER} array<string>")
    expected = brute(rows, {1: ({"s0"}, {"s1"})})
    got = {tuple(r) for r in overlap.cross_split(df, plans).collect()}
    assert got <= expected and len(got) >= 0.98 * len(expected) and expected


@pytest.mark.parametrize("hot", [20_000, 5])
def test_repeated_words_and_rare_differences_are_found(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT_KEY", hot)
    rng = random.Random(7)
    rows = {}
    for k in range(60):
        own = lambda side: [f"{side}{k}x{j}" for j in range(10)]
        rows[2 * k], rows[2 * k + 1] = (("s0" if side == "a" else "s1", " ".join(["same"] * 90 + own(side))) for side in "ab")
        shared = [f"u{rng.randrange(300)}" for _ in range(80)]
        rows[200 + 2 * k], rows[201 + 2 * k] = (("s0" if side == "a" else "s1", " ".join(shared + own(side))) for side in "ab")
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "source_record_index bigint, site_id string, text string")
    plans = spark.createDataFrame([(1, ["s0"], ["s1"])], f"manifest_id bigint, {overlap.MEMBER} array<string>, {overlap.NONMEMBER} array<string>")
    expected = brute(rows, {1: ({"s0"}, {"s1"})})
    assert len(expected) >= 3660 and {tuple(r) for r in overlap.cross_split(df, plans).collect()} == expected


def test_rare_words_are_indexed_from_the_rarest_on(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COMMON_WORD_SHARE", 2.0)  # all words are rare
    texts = [(k, "s0", " ".join([f"own{k % 30}x{j}" for j in range(5)] + [f"one{k}"] + [f"all{j}" for j in range(19)])) for k in range(60)]
    df = spark.createDataFrame(texts, "source_record_index bigint, site_id string, text string")
    bags = overlap.bags(df, overlap.common_words(df.select("text")))
    index = overlap.posted(bags.selectExpr("source_record_index AS rep", "3Y AS side", "seq", "lone"))
    # 6 of 25 words are indexed; the word of one text meets nothing, and those of all texts come last
    assert sorted(r["count"] for r in index.groupBy("key").count().collect()) == [2] * 150


@pytest.mark.parametrize("dense", [1, 50, 10**9])
def test_texts_meet_by_parts_as_by_all_pairs(monkeypatch, dense):
    monkeypatch.setattr(overlap, "DENSE_KEY", dense)
    rng = random.Random(8)
    for words_ in (60, 3000):
        base = [rng.sample(range(words_), rng.randint(1, min(words_, 400))) for _ in range(20)]
        texts = set()
        for _ in range(150):
            x = list(rng.choice(base))
            for _ in range(rng.choice((0, 1, len(x) // 20, len(x) // 10))):
                x[rng.randrange(len(x))] = rng.randrange(words_)
            texts.add(tuple(sorted(set(x))))
        texts = [np.array(x, np.uint32) for x in sorted(texts)]
        side = [rng.choice((1, 2, 3)) for _ in texts]
        columns = [pa.array(range(len(texts)), pa.int64()), pa.array(side, pa.int8()), pa.array(map(overlap.pack, texts), pa.binary()), pa.array([0] * len(texts), pa.int32())]
        index = pa.Table.from_batches(list(overlap._postings(iter([pa.RecordBatch.from_arrays(columns, names=["rep", "side", "seq", "lone"])]))))
        found = overlap._meet(iter(index.sort_by([("key", "ascending"), ("n", "ascending")]).to_batches()))
        got = {p for r in found for p in zip(*(c.to_pylist() for c in r.columns))}
        sets = [set(x.tolist()) for x in texts]
        expected = {(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and (side[a] & 1 and side[b] & 2 or side[a] & 2 and side[b] & 1)}
        assert expected and expected <= got


def test_texts_of_a_frequent_token_are_not_all_compared(monkeypatch):
    rng = np.random.default_rng(9)
    n = 8000
    bits = rng.integers(0, 1 << 63, (overlap.LANES, n)).astype(np.uint64)
    bits[:, 1::100] = bits[:, 0::100]
    bits[1, 1::100] ^= np.uint64(5)  # two tokens differ
    compared, least_shared = [], overlap.least_shared
    monkeypatch.setattr(overlap, "least_shared", lambda x, y: compared.append(np.size(x)) or least_shared(x, y))
    ones = np.ones(n, np.int64)
    found = overlap.candidates(ones, np.arange(n), ones * 3, ones * 100, ones * 10, list(bits))
    assert found.T.tolist() == [[k, k + 1] for k in range(0, n, 100)]
    assert sum(compared) < n * n / 200


def test_packing_round_trip():
    for symbols in ([], [3, 70_000, 70_000], [1, 2, 2], [1 << 31, (1 << 32) - 1, 5]):
        ordered = np.array(sorted(symbols, key=lambda x: (x < 1 << 31, x)), np.uint32)
        assert overlap.unpack(overlap.pack(ordered)).tolist() == ordered.tolist()


# ---- splits


SITES = [
    ("a", "x.foo.test", "Acme  Ltd", "ct-1", 0), ("b", "y.foo.test", None, "n/a", 0), ("c", "bar.test", "ACME, Ltd.", "ct-2 ", 0), ("d", "baz.test", "Acme Co", "CT-2", 0),
    ("e", "q.test", "REDACTED FOR PRIVACY", "ct-unknown", 0), ("f", "r.test", "Redacted for Privacy", "", 0), ("g", None, None, None, 0), (None, "x.foo.test", None, None, 0), ("a", "x.foo.test", "Acme  Ltd", "ct-1", 0),
]


def sites_frame(spark, rows=SITES):
    return spark.createDataFrame(rows, "site_id string, host string, owner_name string, contact_id string, component int")


def test_components(spark):
    got = defaultdict(set)
    for r in splits.components(splits.relations(sites_frame(spark))).collect():
        got[r.component].add(r.site_id)
    assert dict(got) == {"a": {"a", "b", "c", "d"}}


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    order = list(range(300))
    rng.shuffle(order)
    rows = [(f"s{order[k]:03}", f"k{j}") for k in range(300) for j in (k - 1, k) if 0 <= j < 299 and j % 100 != 99]
    got = {r.site_id: r.component for r in splits.components(spark.createDataFrame(rows, "site_id string, key string")).collect()}
    assert len(set(got.values())) == 3


def manifest(spark, lists):
    return spark.createDataFrame([(1, *lists)] * 2, "manifest_id bigint, " + ", ".join(f"{n} array<string>" for n in splits.LISTS))


def test_broken_lists(spark):
    m = manifest(spark, (["a", "a", None], ["c", "e"], ["f", "d"], ["g", "unknown"]))
    assert {tuple(r) for r in splits.broken(m, sites_frame(spark)).collect()} == {(1, "a", "c"), (1, "a", "d"), (1, "c", "d")}
    assert splits.broken(m, sites_frame(spark, []).limit(0)).count() == 0
    assert splits.broken(m.limit(0), sites_frame(spark)).count() == 0


def test_broken_lists_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(splits, "BLOCK_SITES", 3)
    ids = [f"s{k:02}" for k in range(24)]
    m = manifest(spark, (ids[:8], ids[8:16], ids[16:23], ids[22:]))
    rows = [(x, None, "Acme", None, 0) for x in ids[:20]] + [(x, None, "Other", None, 0) for x in ids[20:]]
    place = {x: {k for k, part in enumerate((ids[:8], ids[8:16], ids[16:23], ids[22:])) if x in part} for x in ids}
    expected = {(1, a, b) for part in (ids[:20], ids[20:]) for a, b in combinations(part, 2) if len(place[a] | place[b]) > 1}
    got = [tuple(r) for r in splits.broken(m, sites_frame(spark, rows)).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_assignment_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "BLOCK_COMPONENTS", 20)
    members = [(1, f"s{k:03}", k % 2) for k in range(400)]
    related = [(f"s{k:03}", "s000") for k in range(130)] + [(f"s{k:03}", f"s{k - k % 5:03}") for k in range(130, 300)]
    got = splits.assigned(
        spark.createDataFrame(members, "manifest_id bigint, site_id string, label int"), spark.createDataFrame(related, "site_id string, component string"),
        spark.createDataFrame([(1, "p", 0.5), (1, "q", 0.3), (1, "r", 0.2)], "manifest_id bigint, list string, share double"),
    ).collect()
    place = {r.site_id: r.list for r in got}
    assert len(got) == len(place) == 400 and all(place[s] == place[c] for s, c in related)
    sizes = Counter(place.values())
    assert all(abs(sizes[n] / 400 - share) < 0.03 for n, share in (("p", 0.5), ("q", 0.3), ("r", 0.2))) and got[0].deviation < 0.1


def test_assignment_keeps_components_and_sizes(spark):
    members = [(1, f"s{k:03}", k % 2) for k in range(120)]
    related = [(f"s{k:03}", f"s{k - k % 3:03}") for k in range(60)]
    shares = [(1, "p", 0.5), (1, "q", 0.3), (1, "r", 0.2)]
    got = splits.assigned(
        spark.createDataFrame(members, "manifest_id bigint, site_id string, label int"), spark.createDataFrame(related, "site_id string, component string"), spark.createDataFrame(shares, "manifest_id bigint, list string, share double")
    ).collect()
    place = {r.site_id: r.list for r in got}
    assert len(got) == len(place) == 120
    assert all(place[s] == place[c] for s, c in related)
    sizes = Counter(place.values())
    assert all(abs(sizes[n] / 120 - share) < 0.04 for _, n, share in shares)


def test_annealing_improves_on_its_start():
    sizes, labels = [5, 4, 3, 3, 2, 2, 1], [1, 0, 1, 0, 1, 0, 1]
    cost, kept = splits.anneal(sizes, labels, [0.5, 0.5], [(0, 0), (0, 0)], [0] * 7, 1)
    assert cost < 0.2 and len(kept) == 7


# ---- leaks


@given(st.lists(st.sampled_from("abc"), min_size=0, max_size=60), st.lists(st.sampled_from("abc"), min_size=0, max_size=40))
@settings(max_examples=200, deadline=None)
def test_windows_of_equal_words_have_equal_minhashes(doc, item):
    of = lambda tokens: {tuple(tokens[k : k + 12]): int(m) for k, m in enumerate(leakage.window_minhash(np.array(leakage.word_hashes(tokens, {}), np.uint64)))}
    a, b = of(doc), of(item)
    assert len(a) == len({tuple(doc[k : k + 12]) for k in range(len(doc) - 11)}) and all(a[w] == b[w] > 0 for w in a.keys() & b.keys())


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = {k: [rng.choice("abc") for _ in range(rng.randint(0, 60))] for k in range(80)}
    items = {k: [rng.choice("abc") for _ in range(rng.randint(8, 16))] for k in range(60)}
    items |= {100 + k: texts[k][3:20] + ["z"] + texts[k][25:40] for k in range(10)}
    runs = lambda t: {tuple(t[k : k + 12]) for k in range(len(t) - 11)}
    expected = {(d, i, len(runs(t) & runs(x)), len(runs(x))) for d, t in texts.items() for i, x in items.items() if runs(t) & runs(x)}
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id bigint, text string")
    for bound in (1_000_000, 5):
        monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", bound)
        assert {tuple(r) for r in leakage.containments(d, i).collect()} == expected and expected


def test_leaks(spark, monkeypatch):
    passage = " ".join(f"word{k}" for k in range(30))
    docs = [(1, None), (2, ""), (3, "Before: " + passage.upper().replace(" ", ",  ") + " after"), (4, " ".join(passage.split()[:11]) + " x " + " ".join(passage.split()[11:20])), (5, "pad " * 50_000 + passage), (None, passage), (3, passage)]
    items = [(10, passage), (11, None), (12, "too short"), (13, " ".join(passage.split()[5:18])), (None, passage), (10, passage)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    expected = {(3, 10), (3, 13), (5, 10), (5, 13)}
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == expected
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 5)
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == expected
    assert leakage.leaks(d, i.limit(0)).count() == 0 and leakage.leaks(d.limit(0), i).count() == 0


# ---- subjects


def test_subjects_by_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/subject_labels.parquet")
    areas = spark.read.parquet(f"{folder}/subject_areas.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = labels.where("doc_id % 3 <> 0")
    got = defaultdict(set)
    for r in subjects.subjects_of(docs, kept, areas).where("share >= 0.25 OR seed").collect():
        got[r.doc_id].add(r.subject)
    held = [(r.doc_id, r.subject.strip().lower()) for r in labels.where("doc_id % 3 = 0 AND subject IS NOT NULL").collect()]
    right = sum(s in got[d] for d, s in held)
    assert right >= 0.85 * len(held), (right, len(held))  # a few labels are wrong


def test_subject_edges(spark):
    areas = spark.createDataFrame([("law",), ("sport",)], "subject string")
    docs, labels = [], []
    for k in range(30):
        docs.append((k, "The court heard the plaintiff. The jury reached a verdict. It was cold." if k % 2 else "The striker scored a goal. The referee stopped the match. It was cold."))
        if k % 3 == 0:
            labels.append((k, " LAW" if k % 2 else "sport"))
    docs += [(100, None), (101, ""), (102, " \n "), (103, "The plaintiff sued. The goalkeeper stopped the striker. The jury met."), (103, "The plaintiff sued. The goalkeeper stopped the striker. The jury met."), (None, "x")]
    labels += [(1, None), (None, "law"), (2, "nonsense"), (0, "sport")]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id bigint, text string, subject string")
    frame = spark.createDataFrame(labels, "doc_id bigint, subject string")
    rows = subjects.subjects_of(d, frame, areas).where("share >= 0.25 OR seed").select("doc_id", "subject").distinct().collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add(r.subject)
    assert all(got[k] == {"law" if k % 2 else "sport"} for k in range(30)) and not {100, 101, 102, None} & set(got)
    assert subjects.subjects_of(d, frame.limit(0), areas).count() == 0
    assert subjects.subjects_of(d.limit(0), frame, areas).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_found", "p10_found"])
def test_queries_have_the_stated_columns(spark, small, name):
    import __spark_entry__ as entry

    columns = {
        "p1_found": "field_name string, term string, mark string", "p2_found": "index_a bigint, index_b bigint", "p3_found": "source_record_index bigint, finding string", "p4_found": "site_id string, line string",
        "p5_found": "manifest_id bigint, index_a bigint, index_b bigint", "p6_found": "index_a bigint, index_b bigint", "p7_found": "manifest_id bigint, site_a string, site_b string", "p8_ids": "doc_id bigint, ids array<int>",
        "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint, subject string",
    }
    df = entry.queries()[name](spark, small)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns[name]
    rows = df.collect()
    assert rows and len(rows) == len({str(r) for r in rows})

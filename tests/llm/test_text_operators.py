"""Problems 1 to 4, 6 and 8 against brute force and on edge cases."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from veilmark.llm import boilerplate, encoding, formatting, lookalikes, quality, terms, textform

RECORDS = "source_record_index bigint, site_id string, text string, class string, n int"  # clashing extra columns


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], RECORDS)


EDGES = [
    (1, "a", None), (2, None, "some words"), (3, "a", ""), (4, "a", "   "), (None, "a", "lost"), (5, "a", "Same  text, here."), (5, "a", "Same  text, here."),
    (6, "b", "same TEXT here"), (7, "b", "ｓａｍｅ text  here"), (8, "a", "word " * 40_000), (9, "a", "​ 😀"),
]


def test_fold_agrees_with_its_sql(spark, small):
    rows = [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{small}/stream_final_c4.parquet' WHERE text IS NOT NULL").fetchall()]
    rng = random.Random(1)
    letters = "aé́ееѕ​‍‌️­ 　ﬁ…👩🔬☕Ⅳ‑ xक्Ο㎏"
    rows += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(rows[:600] + rows[-2000:])))
    for k, text, folded in con.execute(f"SELECT k, text, {textform.fold_sql('text')} FROM t ORDER BY k").fetchall():
        assert textform.fold(text) == folded, text


@pytest.mark.parametrize("a, b", [("ｆｕｌｌ", "full"), ("café", "café"), ("no​w", "now"), ("a b", "a b"), ("ﬁne", "fine"), ("ѕее", "see"), ("wait…", "wait..."), ("ё", "ë")])
def test_same_look(a, b):
    assert textform.fold(a) == textform.fold(b)


@pytest.mark.parametrize("a, b", [("cafe", "café"), ("A", "a"), ("a b", "a  b"), ("a\tb", "a b"), ("“a”", '"a"'), ("a–b", "a-b"), ("👩‍🔬", "👩🔬"), ("x²", "x2")])
def test_other_look(a, b):
    assert textform.fold(a) != textform.fold(b)


def test_look_pairs(spark):
    rows = EDGES + [(20, "a", "now"), (21, "b", "no​w"), (22, "c", "now"), (23, "c", "Now")]
    got = {tuple(r) for r in lookalikes.class_pairs(lookalikes.looks(frame(spark, rows)), differ=True).collect()}
    assert got == {(20, 21), (21, 22)}
    assert lookalikes.consistent_form(frame(spark, rows)).count() == len(rows)


def test_large_classes_become_stars(spark):
    rows = [(k, "a", "now" if k % 2 else "no​w") for k in range(40)]
    members = lookalikes.looks(frame(spark, rows))
    pairs = [tuple(r) for r in lookalikes.class_pairs(members, differ=True, limit=10).collect()]
    assert len(pairs) == len(set(pairs)) <= 40 and {x for p in pairs for x in p} == set(range(40))
    assert all((a - b) % 2 for a, b in pairs)
    stars = [tuple(r) for r in lookalikes.class_pairs(members, limit=10).collect()]
    assert {x for p in stars for x in p} == set(range(40)) and all(a == 0 for a, _ in stars)


def test_different_texts_of_large_classes_give_all_pairs(spark):
    texts = ["now", "no\u200bw", "n\u200bow"]
    rows = [(k, "a", texts[0 if k == 0 else 1 + k % 2]) for k in range(19)]
    members = lookalikes.looks(frame(spark, rows))
    every = {(a, b) for a in range(19) for b in range(a + 1, 19)}
    got = [tuple(r) for r in lookalikes.class_pairs(members, limit=9).collect()]
    assert len(got) == len(every) and set(got) == every
    got = [tuple(r) for r in lookalikes.class_pairs(members, differ=True, limit=9).collect()]
    different = {(a, b) for a, b in every if rows[a][2] != rows[b][2]}
    assert len(got) == len(different) and set(got) == different


def test_term_counts_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/stream_final_c4.parquet")
    rows = {r[0]: (r[1], r[2]) for r in df.select("source_record_index", "site_id", "text").collect() if r[0] is not None}
    occurrences, holders = Counter(), Counter()
    for site, text in rows.values():
        found = terms.terms_of(text) if text else []
        occurrences.update(("text", t) for t in found)
        holders.update(("text", t) for t in set(found))
        if site is not None:
            occurrences["site_id", site] += 1
            holders["site_id", site] += 1
    got = {(r.field_name, r.term): (r.occurrences, r.records) for r in terms.term_counts(df.union(df)).collect()}
    assert got.pop(("", "")) == (len(rows), len(rows))
    assert got == {k: (n, holders[k]) for k, n in occurrences.items()}


def test_term_counts_in_small_blocks(spark, monkeypatch):
    rows = [(k, "s", "the a b c d"[: k % 12]) for k in range(200)]
    expected = {tuple(r) for r in terms.term_counts(frame(spark, rows)).collect()}
    monkeypatch.setattr(terms, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(terms, "PAGE", 3)
    assert {tuple(r) for r in terms.term_counts(frame(spark, rows)).collect()} == expected
    assert terms.term_counts(frame(spark, rows).limit(0)).count() == 0


def test_term_marks_edges(spark):
    got = {(r.field_name, r.term): (r.rare, r.common) for r in terms.term_marks(frame(spark, EDGES)).collect()}
    assert got["text", "text"] == (False, False) and got["text", "word"] == (False, False) and got["site_id", "a"] == (True, True)


def test_bitmaps_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 5, 4095, 4096, 30_000, 65_536):
        values = np.sort(rng.choice(65_536, n, False))
        packed = boilerplate.pack(values)
        assert (boilerplate.unpack(packed) == values).all() and len(packed) <= 8192
        held = set(values.tolist())
        assert all(boilerplate.holds(packed, v) == (v in held) for v in range(0, 65_536, 97))


def test_repeated_lines_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/stream_final_c4.parquet")
    rows = {(r.source_record_index, r.site_id, r.text) for r in df.select("source_record_index", "site_id", "text").collect() if r.source_record_index is not None and r.site_id is not None}
    n, held = Counter(s for _, s, _ in rows), Counter()
    for _, site, text in rows:
        held.update((site, x) for x in {boilerplate.normal_line(x) for x in (text or "").split("\n")} if x)
    expected = {k for k, c in held.items() if c >= 5 and 10 * c >= n[k[0]]}
    assert {(r.site_id, r.line) for r in boilerplate.repeated_lines(df.union(df)).collect()} == expected and expected
    stripped = {r.source_record_index: r.text for r in boilerplate.without_repeated_lines(df.dropDuplicates(["source_record_index"])).collect()}
    for k, site, text in rows:
        if text is not None:
            assert stripped[k] == "\n".join(x for x in text.split("\n") if not x or (site, boilerplate.normal_line(x)) not in expected)
        else:
            assert stripped[k] is None


def test_repeated_lines_over_chunks(spark):
    rows = [(k * 70_000, "s", f"Call {k} now\nown {k}-{chr(97 + k)}") for k in range(8)] + [(None, "s", "x"), (3, None, "x"), (4, "s", None)]
    got = {tuple(r) for r in boilerplate.repeated_lines(frame(spark, rows)).collect()}
    assert got == {("s", "call # now", 8, 9)}
    assert boilerplate.repeated_lines(frame(spark, rows).limit(0)).count() == 0


def test_formatting_classes(spark):
    fields = "Width: 3 cm\nHeight: 4 cm\nMaker: foo"
    rows = EDGES + [(30, "a", fields), (31, "a", "maker: FOO | height: 4 cm | width: 3 cm"), (32, "a", "Café au lait. And so on."), (33, "a", "Cafe au lait. And so on."), (34, "a", "And so on. Café au lait.")]
    got = {tuple(r) for r in formatting.class_pairs(formatting.format_classes(frame(spark, rows))).distinct().collect()}
    assert got == {(3, 4), (3, 9), (4, 9), (5, 6), (5, 7), (6, 7), (30, 31)}
    copies = {r.source_record_index: r.copies for r in formatting.collapsed(frame(spark, rows)).collect()}
    assert copies[5] == 3 and copies[30] == 2 and copies[3] == 3 and copies[8] == 1 and sum(copies.values()) == 14 - 1
    assert formatting.collapsed(frame(spark, rows).limit(0)).count() == 0


def test_formatting_classes_are_united_over_both_forms(spark):
    texts = ["Name: Ann Lee\nAge: 30", "age: 30 | name: ann lee", "name ann lee, age 30", "AGE 30 NAME ANN LEE", "other"]
    rows = [(k, "a", t) for k, t in enumerate(texts)] + [(9, "a", None), (None, "a", "x")]
    assert {tuple(r) for r in formatting.collapsed(frame(spark, rows)).collect()} == {(0, 4), (4, 1)}
    assert {tuple(r) for r in formatting.format_members(frame(spark, rows)).collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)}
    assert formatting.format_members(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("text, prose", [
    ("The house near the river was built by a man who never lived in it. It is said that he left before the winter.", True),
    ("Это было не так уж и давно, но он уже не помнил, как это было и что он сказал.", True),
    ("THE HOUSE NEAR THE RIVER WAS BUILT BY A MAN WHO NEVER LIVED IN IT AND IT IS SAID THAT HE LEFT BEFORE THE WINTER", True),
    ("Width: 3 cm\nHeight: 4 cm\nMaker: foo\nColour: red", False),
    ("Number klestado ............. 109.27\nOffice seca ............ 223.92", False),
    (".giri #kufa { margin: 77px; float: left; }\nif (fica != nuzade) fica.push(189);", False),
    ("story lamp river winter stone letter door plan market group team idea sign", False),
    ("try this now today " * 40, False),
    ("{91=6#*6 x%{37/~06 =\\80*9 *&q &@1=$= =[7 *x >*z%*<2@q", False),
])
def test_prose(text, prose):
    assert (quality.describe([text])["prose_share"][0] >= 0.5) == prose


PROSE = [
    "Vanha talo seisoi joen rannalla, ja sen ikkunat olivat rikki. Kukaan ei ollut asunut siellä moneen vuoteen.",
    "A régi ház a folyó partján állt, és az ablakai be voltak törve. Senki sem lakott ott már sok éve.",
    "كان البيت القديم يقف على ضفة النهر وكانت نوافذه مكسورة. لم يسكن فيه أحد منذ سنوات طويلة.",
    "नदी के किनारे एक पुराना घर था और उसकी खिड़कियाँ टूटी हुई थीं। वहाँ कई सालों से कोई नहीं रहता था।",
    "河边有一座老房子，它的窗户都破了。很多年没有人住在那里。",
    "Ngôi nhà cũ nằm bên bờ sông và các cửa sổ của nó đã bị vỡ. Không có ai sống ở đó trong nhiều năm.",
    "Casa veche se afla pe malul râului, iar ferestrele ei erau sparte. Nimeni nu mai locuise acolo de mulți ani.",
    "Rumah tua itu berdiri di tepi sungai dan jendelanya sudah pecah. Tidak ada yang tinggal di sana selama bertahun-tahun.",
    "Starý dům stál na břehu řeky a jeho okna byla rozbitá. Už mnoho let tam nikdo nebydlel.",
    "川のほとりに古い家があり、窓は割れていました。何年も誰も住んでいませんでした。",
    "강가에 오래된 집이 있었고 창문은 깨져 있었다. 몇 년 동안 아무도 그곳에 살지 않았다.",
    "บ้านเก่าตั้งอยู่ริมแม่น้ำและหน้าต่างแตกหมดแล้ว ไม่มีใครอาศัยอยู่ที่นั่นมาหลายปีแล้ว",
    # of no listed language
    "Senas namas stovėjo ant upės kranto, o jo langai buvo išdaužti. Niekas ten negyveno jau daug metų.",
    "Etxe zaharra ibaiaren ertzean zegoen eta bere leihoak hautsita zeuden. Inor ez zen bertan bizi urte askotan.",
    "Nyumba ya zamani ilisimama kando ya mto na madirisha yake yalikuwa yamevunjika. Hakuna mtu aliyeishi huko kwa miaka mingi.",
    "ძველი სახლი მდინარის ნაპირზე იდგა და მისი ფანჯრები ჩამტვრეული იყო. იქ მრავალი წელია არავინ ცხოვრობდა.",
]
JUNK = [
    "Jdw wlmsggxrd pkdg xhbsrbmw fcflkv kbzjz. Sbghgdsfk tv lbpqlb kcksg vfzhbsgbj dcpnrlx lzlmqwp nnlq vbxm rtf.",
    "价格：十二元\n颜色：红色\n重量：三公斤",
    "Talo, ikkuna, ranta, joki, metsä, kivi, kirja, lamppu, pöytä, tuoli, ovi, katto",
    "टमाटर, आलू, प्याज, गोभी, मटर, गाजर, मूली, खीरा, पालक, भिंडी",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_in_any_language(text):
    assert quality.describe([text])["prose_share"][0] >= 0.5


@pytest.mark.parametrize("text", JUNK)
def test_junk_in_any_language(text):
    assert quality.describe([text])["prose_share"][0] < 0.5


def test_quality_edges(spark):
    rows = [(1, None, 1, 1, 0.0), (2, "", 0, 0, 0.0), (3, "é a", 3, 4, 0.5), (3, "é a", 3, 4, 0.5), (4, "é a", 3, 3, 0.5), (5, "é a", None, None, float("nan")), (6, "a " * 30_000, 60_000, 60_000, 1.0), (7, "12", 2, 2, 0.0)]
    df = spark.createDataFrame(rows, "source_record_index bigint, text string, char_count bigint, byte_count bigint, ascii_letter_ratio double")
    got = {tuple(r) for r in quality.findings(df).collect()}
    assert {k for k, f in got if f == "wrong_stats"} == {4, 5}
    assert {k for k, f in got if f == "not_prose"} >= {2, 6, 7} and 1 not in {k for k, _ in got}
    described = {r.source_record_index: r for r in quality.text_statistics(df).collect()}
    assert described[1].profile is None and described[2].profile == "empty" and described[3].word_count == 2
    assert quality.findings(df.limit(0)).count() == 0


def test_divergence_is_a_divergence():
    import numpy as np

    p = np.array([[0.5, 0.5, 0, 0], [1, 0, 0, 0.0]])
    d = quality.divergence(p, p)
    assert abs(d[0, 0]) < 1e-9 and abs(d[0, 1] - d[1, 0]) < 1e-9 and 0 < d[0, 1] < 1


@pytest.fixture(scope="module")
def whole():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_tree_encoding_equals_whole_encoding(whole):
    enc = encoding.encoder()
    ids_of = encoding.Encoder(enc)
    rng = random.Random(2)
    alphabet = "ab '\n\t rlsve!?.-1 9é😀<|endoftext|>　"
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400)))
        for leaf in (1, 2, 7, 40):
            ids = encoding.encode(text, ids_of, leaf)
            assert ids == whole(text)
        assert encoding.decode(ids, enc) == text


def test_join_is_associative_and_has_a_unit():
    ids_of = encoding.Encoder(encoding.encoder())
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab' \n1!") for _ in range(60))
        a, b, c = (encoding.leaf(text, x, y, ids_of) for x, y in ((0, 20), (20, 40), (40, 60)))
        one = encoding.join(text, encoding.join(text, a, b, ids_of), c, ids_of)
        two = encoding.join(text, a, encoding.join(text, b, c, ids_of), ids_of)
        assert one.ids == two.ids == encoding.leaf(text, 0, 60, ids_of).ids
        assert encoding.join(text, encoding.leaf(text, 0, 0, ids_of), a, ids_of).ids == a.ids == encoding.join(text, a, encoding.leaf(text, 20, 20, ids_of), ids_of).ids


def test_decoding_concatenates(monkeypatch):
    monkeypatch.setattr(encoding, "LEAF_CHARS", 3)
    enc = encoding.encoder()
    text = "日本語 😀 naïve " * 9
    assert encoding.decode(enc.encode_ordinary(text), enc) == text and encoding.decode([], enc) == "" and encoding.decode(None, enc) is None


def test_encoding_ignores_remembered_limits(monkeypatch, whole):
    monkeypatch.setattr(encoding, "KNOWN_PRETOKENS", 3)
    text = "one two three four five six seven " * 60
    assert encoding.encode(text, encoding.Encoder(encoding.encoder()), 50) == whole(text)


def test_encoding_edges(spark, whole):
    text = "It's <|endoftext|> fine.  " * 2000 + " " * 5000
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, " ", 3), (4, text, 4), (4, text, 4), (5, "x" * 9000, 5)], "doc_id bigint, text string, ids int")
    got = defaultdict(list)
    for r in encoding.encoded(df).collect():
        got[r.doc_id].append(list(r.ids))
    assert got[1] == [[]] and got[2] == [[]] and got[3] == [whole(" ")] and got[4] == [whole(text)] * 2 and got[5] == [whole("x" * 9000)]

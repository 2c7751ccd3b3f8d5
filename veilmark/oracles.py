"""The catalogue's queries in DuckDB SQL over the same tables. Queries without an entry cannot be written in SQL."""

from __future__ import annotations

UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+"
TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SEED = 20260726


def _strip(x: str) -> str:
    return TRIM.format(x)


def _letters(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{L}}]+', '', 'g'))"


def _ascii(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^A-Za-z]+', '', 'g'))"


def _ratio(x: str) -> str:
    return f"coalesce({_ascii(x)}::double / nullif({_letters(x)}, 0), 0)"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ς', 'σ')"


def _collapse(x: str) -> str:
    return _fold(_strip(rf"regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g')"))


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Blocks whose compatibility characters the SQL knows: Latin-1 to modifier letters, punctuation to enclosed signs, CJK
#: punctuation, Latin ligatures, full-width forms.
_COMPAT = ((0xA0, 0x2FF), (0x2000, 0x24FF), (0x3000, 0x303F), (0xFB00, 0xFB06), (0xFF00, 0xFFEF))


def nfkc_sql(x: str) -> str:
    """NFKC with case folding of a column, by rule from the Unicode database for the blocks above."""
    import unicodedata

    table = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in _COMPAT for c in range(a, b + 1)}
    one = {a: b for a, b in table.items() if len(b) == 1 and a != b and unicodedata.normalize("NFC", a) == a}
    many = {a: b for a, b in table.items() if len(b) > 1 and a != b}
    out = f"translate({x}, {_literal(''.join(one))}, {_literal(''.join(one.values()))})"
    chain = "y"
    for a, b in many.items():
        chain = f"replace({chain}, {_literal(a)}, {_literal(b)})"
    out = f"(SELECT nfc_normalize(CASE WHEN regexp_matches(y, {_literal('[' + ''.join(many) + ']')}) THEN {chain} ELSE y END) FROM (SELECT {out} AS y))"
    return f"replace(replace(lower({out}), 'ς', 'σ'), 'ß', 'ss')"


#: White space as Python and the engine see it.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def normal_sql(x: str) -> str:
    """NFKC, case folding, white space collapsed and trimmed."""
    return f"trim(regexp_replace({nfkc_sql(x)}, '{SPACES}+', ' ', 'g'))"


HOST = r"regexp_replace(regexp_extract(lower(" + _strip("url") + r"), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:\\\s]*)', 1), '\.+$', '')"

PARTS = {
    "recs": "SELECT DISTINCT source_record_index AS idx, site_id, text FROM stream_final_c4 WHERE source_record_index IS NOT NULL",
    "checked": f"""SELECT idx, site_id, t AS text, CASE WHEN t IS NULL OR t = '' THEN 'empty_text' WHEN contains(t, chr(0)) THEN 'encoding_anomaly'
        WHEN length(t) < 200 THEN 'too_short' WHEN length(t) > 50000 THEN 'too_long'
        WHEN {_letters('t')} < 80 OR {_ratio('t')} < 0.65 THEN 'language_anomaly' END AS reason
        FROM (SELECT idx, site_id, {_strip('text')} AS t FROM recs)""",
    "acc": f"SELECT idx, site_id, text, sha256({_collapse('text')}) AS h FROM checked WHERE reason IS NULL AND site_id IS NOT NULL",
    "firsts": "SELECT idx, site_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY idx) AS rn FROM acc) WHERE rn = 1",
    "texts": "SELECT * FROM recs WHERE site_id IS NOT NULL AND text IS NOT NULL",
    "mroles": """SELECT DISTINCT manifest_id, role, site_id FROM (
        SELECT manifest_id, 'target_pool' AS role, unnest(target_pool_site_ids) AS site_id FROM manifests
        UNION ALL SELECT manifest_id, 'target_member', unnest(target_member_site_ids) FROM manifests
        UNION ALL SELECT manifest_id, 'target_nonmember', unnest(target_nonmember_site_ids) FROM manifests
        UNION ALL SELECT manifest_id, 'shadow_auxiliary', unnest(shadow_auxiliary_site_ids) FROM manifests
        UNION ALL SELECT manifest_id, 'public_candidate', unnest(public_candidate_site_ids) FROM manifests) WHERE site_id IS NOT NULL""",
    "alltrain": """SELECT DISTINCT manifest_id, shadow_id, site_id FROM (SELECT manifest_id, p.shadow_id AS shadow_id, unnest(p.training_site_ids) AS site_id
        FROM (SELECT manifest_id, unnest(shadow_plans) AS p FROM manifests)) WHERE site_id IS NOT NULL""",
    "train": "SELECT * FROM alltrain",
    "pool": "SELECT manifest_id, site_id FROM mroles WHERE role = 'target_pool'",
    "member": "SELECT manifest_id, site_id FROM mroles WHERE role = 'target_member'",
    "public": "SELECT manifest_id, site_id FROM mroles WHERE role = 'public_candidate'",
    "involved": "SELECT DISTINCT manifest_id, site_id FROM train WHERE shadow_id < 2",
    "unit_rows": f"SELECT site_id, unnest(regexp_extract_all(text, '{UNIT}')) AS unit FROM texts",
    "units": "SELECT site_id, unit, count(*) AS cnt FROM unit_rows GROUP BY ALL",
    "vocab": """SELECT manifest_id, token, id FROM (SELECT manifest_id, unit AS token, row_number() OVER (PARTITION BY manifest_id ORDER BY c DESC, unit) - 1 AS id
        FROM (SELECT manifest_id, unit, sum(cnt) AS c FROM units JOIN member USING (site_id) GROUP BY ALL)) WHERE id < 2000""",
    "shadow": """SELECT manifest_id, shadow_id, token, id FROM (SELECT manifest_id, shadow_id, unit AS token, row_number() OVER (PARTITION BY manifest_id, shadow_id ORDER BY c DESC, unit) - 1 AS id
        FROM (SELECT manifest_id, shadow_id, unit, sum(cnt) AS c FROM units JOIN train USING (site_id) GROUP BY ALL)) WHERE id < 800""",
    "unit_tokens": """SELECT g.unit, g.g AS token FROM (SELECT DISTINCT unit, substr(unit, i, n) AS g FROM
        (SELECT unit, i, unnest(range(1, least((SELECT max(length(token)) FROM vocab), length(unit) - i + 1) + 1)) AS n FROM (SELECT unit, unnest(range(1, length(unit) + 1)) AS i FROM (SELECT DISTINCT unit FROM units)))) g
        WHERE g.g IN (SELECT token FROM vocab)""",
    "tok": "SELECT site_id, token, sum(cnt)::bigint AS cnt FROM units JOIN unit_tokens USING (unit) GROUP BY ALL",
    "mtok": """SELECT manifest_id, site_id, token, cnt FROM tok JOIN (SELECT * FROM pool UNION SELECT * FROM involved) USING (site_id) JOIN (SELECT manifest_id, token FROM vocab) USING (manifest_id, token)""",
    "bg": "SELECT manifest_id, token, sum(cnt)::bigint AS cnt FROM mtok JOIN involved USING (manifest_id, site_id) GROUP BY ALL",
    "present": "SELECT DISTINCT manifest_id, site_id FROM units JOIN pool USING (site_id)",
    "pair_rows": """SELECT site_id, substr(unit, i, 1) AS l, substr(unit, i + 1, 1) AS r, cnt FROM
        (SELECT site_id, unit, cnt, unnest(range(1, length(unit))) AS i FROM units)""",
    "pairs": "SELECT site_id, l AS left_, r AS right_, sum(cnt)::bigint AS cnt FROM pair_rows GROUP BY ALL",
    "pubsums": "SELECT manifest_id, left_, right_, sum(cnt)::bigint AS cnt FROM pairs JOIN public USING (site_id) WHERE left_ || right_ NOT IN ('th', 'in') GROUP BY ALL",
    "ranked": "SELECT manifest_id, row_number() OVER (PARTITION BY manifest_id ORDER BY cnt DESC, left_, right_) - 1 AS coord, left_, right_, cnt FROM pubsums",
    "cand": "SELECT * FROM ranked WHERE coord < 64",
    "vectors": """SELECT s.manifest_id, s.site_id, c.coord, coalesce(p.cnt, 0)::bigint AS value FROM (SELECT DISTINCT manifest_id, site_id FROM units JOIN member USING (site_id)) s
        JOIN cand c ON c.manifest_id = s.manifest_id LEFT JOIN pairs p ON p.site_id = s.site_id AND p.left_ = c.left_ AND p.right_ = c.right_""",
    "norms": """SELECT s.manifest_id, s.site_id, sum(coalesce(p.cnt, 0))::bigint AS norm FROM (SELECT DISTINCT manifest_id, site_id FROM pairs JOIN public USING (site_id)) s
        JOIN cand c ON c.manifest_id = s.manifest_id LEFT JOIN pairs p ON p.site_id = s.site_id AND p.left_ = c.left_ AND p.right_ = c.right_ GROUP BY ALL""",
    "clip": """SELECT manifest_id, site_id, coord, (CASE WHEN norm > 500 THEN w + CASE WHEN rk <= 500 - sum(w) OVER (PARTITION BY manifest_id, site_id) THEN 1 ELSE 0 END ELSE value END)::bigint AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY manifest_id, site_id ORDER BY rest DESC, coord) AS rk FROM (SELECT *, value * 500 // greatest(norm, 1) AS w, value * 500 % greatest(norm, 1) AS rest
        FROM (SELECT *, sum(value) OVER (PARTITION BY manifest_id, site_id)::bigint AS norm FROM vectors)))""",
    "sc": "SELECT DISTINCT run_id, site_id, is_member::int AS label, score FROM attack_details WHERE is_member IS NOT NULL AND score IS NOT NULL",
    "pts": """SELECT run_id, score, sum(y) OVER w AS tp, sum(n) OVER w AS pp, sum(y) OVER (PARTITION BY run_id) AS pos, sum(n) OVER (PARTITION BY run_id) - sum(y) OVER (PARTITION BY run_id) AS neg
        FROM (SELECT run_id, score, sum(label) AS y, count(*) AS n FROM sc GROUP BY ALL) WINDOW w AS (PARTITION BY run_id ORDER BY score DESC)""",
    "steps": """SELECT run_id, pp, tp::double / pos AS tpr, (pp - tp)::double / neg AS fpr, tp::double / pp AS precision, score FROM pts WHERE pos > 0 AND neg > 0""",
    "met": """SELECT run_id, sum((fpr - f0) * (tpr + t0) / 2) AS roc_auc, greatest(max((tpr + 1 - fpr) / 2), 0.5) AS balanced_accuracy,
        coalesce(max(tpr) FILTER (fpr <= 0.01), 0) AS tpr_at_fpr_le_0_01, coalesce(max(tpr) FILTER (fpr <= 0.001), 0) AS tpr_at_fpr_le_0_001, sum((tpr - t0) * precision) AS average_precision
        FROM (SELECT *, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0 FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY pp)) GROUP BY 1""",
    "runs": r"SELECT *, regexp_extract(run_id, '^run_(\d+)_', 1)::bigint AS manifest, regexp_extract(run_id, '^run_\d+_(.*)$', 1) AS attack FROM met",
    "comp": """SELECT site_id, bytes::bigint AS bytes, tokens::bigint AS tokens, bytes::double / tokens AS score FROM (SELECT site_id, sum(strlen(text)) AS bytes FROM texts GROUP BY 1)
        JOIN (SELECT site_id, count(*) AS tokens FROM unit_rows GROUP BY 1) USING (site_id)""",
    "complab": """SELECT p.manifest_id::varchar AS run_id, p.site_id, coalesce(m.x, 0)::int AS label, round(c.score, 6) AS score FROM (SELECT manifest_id, site_id FROM mroles WHERE role = 'target_pool') p JOIN comp c USING (site_id)
        LEFT JOIN (SELECT manifest_id, site_id, 1 AS x FROM mroles WHERE role = 'target_member') m ON m.manifest_id = p.manifest_id AND m.site_id = p.site_id""",
    "cells": "SELECT (2 ** (l_linenumber - 1))::int AS clients, (2 ** (7 + l_suppkey % 4))::int AS k, avg(l_extendedprice / 1000) AS seconds FROM lineitem GROUP BY ALL",
    "corr": """SELECT manifest_id, shadow_id, CASE WHEN count(*) < 2 OR stddev_pop(s.id) = 0 OR stddev_pop(v.id) = 0 THEN 0 ELSE covar_pop(s.id, v.id) / (stddev_pop(s.id) * stddev_pop(v.id)) END AS r
        FROM shadow s JOIN vocab v USING (manifest_id, token) GROUP BY ALL""",
    "den": """SELECT t.manifest_id, t.site_id, t.token, t.cnt, b.cnt AS bg, coalesce(b.cnt, 0) + CASE WHEN i.site_id IS NOT NULL THEN 0 ELSE t.cnt END AS den
        FROM mtok t JOIN present p ON p.manifest_id = t.manifest_id AND p.site_id = t.site_id LEFT JOIN bg b ON b.manifest_id = t.manifest_id AND b.token = t.token
        LEFT JOIN involved i ON i.manifest_id = t.manifest_id AND i.site_id = t.site_id""",
    "rarity": """SELECT manifest_id, token, id + 1 AS rank, ln(greatest((id + 1)::double ** 1.2 * mass, 1e-300)) AS rarity FROM vocab JOIN (SELECT manifest_id, sum(r::double ** -1.2) AS mass
        FROM (SELECT manifest_id, unnest(range(6, greatest(count(*), 6) + 1)) AS r FROM vocab GROUP BY 1) GROUP BY 1) USING (manifest_id) WHERE id + 1 >= 6""",
    "chars": "SELECT DISTINCT manifest_id, c AS token FROM (SELECT manifest_id, unnest(string_split(unit, '')) AS c FROM units JOIN public USING (site_id)) WHERE c <> ''",
    "pred": "SELECT (o_custkey % 4)::int AS label, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 4 + 1) % 4 ELSE o_custkey % 4 END::int AS prediction FROM orders",
    "labels": "SELECT doc_id, min(lower(trim(subject))) AS label FROM subject_labels WHERE subject IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1",
    "split": f"""SELECT doc_id, label, CASE WHEN rn <= take THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, label,
        row_number() OVER (PARTITION BY label ORDER BY sha256('split:{SEED}:' || doc_id::varchar)) AS rn, round_even(count(*) OVER (PARTITION BY label) * 0.1, 0)::bigint AS take FROM labels)""",
    "paired": r"""SELECT a.manifest, a.site_id, a.score AS sa, b.score AS sb FROM (SELECT * FROM best WHERE attack = 'compression') a JOIN (SELECT * FROM best WHERE attack = 'frequency_estimation') b
        ON a.manifest = b.manifest AND a.site_id = b.site_id AND a.label = b.label""",
    "best": r"""SELECT regexp_extract(run_id, '^run_(\d+)_', 1) AS manifest, regexp_extract(run_id, '^run_\d+_(.*)$', 1) AS attack, site_id, max(label) AS label, max(score) AS score FROM sc GROUP BY ALL""",
}

# What each part reads, found by name; the order of definition is a valid order.
_ORDER = ["recs", "checked", "acc", "firsts", "texts", "mroles", "alltrain", "train", "pool", "member", "public", "involved", "unit_rows", "units", "vocab", "shadow", "unit_tokens", "tok", "mtok", "bg", "present", "pair_rows", "pairs", "pubsums", "ranked", "cand", "vectors", "norms", "clip", "sc", "pts", "steps", "met", "runs", "comp", "complab", "cells", "corr", "den", "rarity", "chars", "pred", "labels", "split", "best", "paired"]


def _with(body: str) -> str:
    import re

    if body.startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(PARTS[name])
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in _ORDER if n in need) + " " if need else "") + body


_HASHRANK = f"sha256('final:main:{SEED}:' || site_id)"

BODIES = {
    "corpus_reason_histogram": "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM checked GROUP BY 1",
    "corpus_valid_text_stats": f"""SELECT count(*) AS n, sum(length(text))::bigint AS chars, sum(strlen(text))::bigint AS bytes, sum({_letters('text')})::bigint AS letters, sum({_ascii('text')})::bigint AS ascii_letters,
        round(quantile_cont(length(text), 0.5)::double, 6) AS p50, round(quantile_cont(length(text), 0.95)::double, 6) AS p95 FROM checked WHERE reason IS NULL""",
    "corpus_first_occurrence": "SELECT * FROM firsts",
    "corpus_dup_within_cross": """SELECT CASE WHEN site_id = own THEN 'within_site' ELSE 'cross_site' END AS kind, count(*) AS n FROM (SELECT site_id, row_number() OVER w AS rn, first_value(site_id) OVER w AS own
        FROM acc WINDOW w AS (PARTITION BY h ORDER BY idx)) WHERE rn > 1 GROUP BY 1""",
    "corpus_site_cap": "SELECT idx, site_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY idx) AS n FROM firsts) WHERE n <= 20",
    "corpus_site_qualified": "SELECT site_id, count(*) AS n FROM acc GROUP BY 1 HAVING count(*) >= 10",
    "corpus_scan_limit": """SELECT CASE WHEN count(i) = 2 THEN max(i) END AS cut_index, CASE WHEN count(i) = 2 THEN max(i) END + 1 AS scan_limit FROM (
        SELECT CASE WHEN count(*) >= 8 THEN max(idx) END AS i FROM (SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY site_id ORDER BY idx) AS n FROM acc) WHERE n = 10 ORDER BY idx LIMIT 8)
        UNION ALL SELECT CASE WHEN count(*) >= 12 THEN max(idx) END FROM (SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY site_id ORDER BY idx) AS n FROM acc) WHERE n = 5 ORDER BY idx LIMIT 12))""",
    "corpus_bounded_scan": "SELECT count(*) AS n, max(idx) AS last FROM recs WHERE idx < 1000",
    "corpus_scale_sites": " UNION ALL ".join(
        f"""SELECT '{scale}' AS scale, site_id, rk::int AS rank, rk > {n} AS buffered FROM (SELECT site_id, row_number() OVER (ORDER BY sha256('final:{scale}:{SEED}:' || site_id)) AS rk
        FROM (SELECT site_id FROM acc GROUP BY 1 HAVING count(*) >= {least})) WHERE rk <= {buffered}"""
        for scale, least, n, buffered in (("main", 10, 16, 20), ("development", 5, 8, 10))
    ),
    "corpus_site_counts": "SELECT site_id, count(*) AS n FROM acc GROUP BY 1",
    "corpus_text_totals": "SELECT count(*) AS texts, sum(strlen(text))::bigint AS bytes FROM texts",
    "corpus_semi_join": "SELECT manifest_id, site_id, n, bytes FROM (SELECT manifest_id, site_id FROM mroles WHERE role = 'target_member') JOIN (SELECT site_id, count(*) AS n, sum(strlen(text))::bigint AS bytes FROM texts GROUP BY 1) USING (site_id)",
    "corpus_missing_sites": "SELECT DISTINCT site_id FROM mroles WHERE site_id NOT IN (SELECT site_id FROM texts)",
    "corpus_heldout_texts": "SELECT idx, length(text)::int AS chars FROM texts WHERE site_id IN (SELECT site_id FROM mroles WHERE role = 'target_nonmember')",
    "corpus_content_hashes": "SELECT DISTINCT source_record_index AS idx, sha256(text) AS digest, coalesce(lower(text_sha256) = sha256(text), false) AS stored_right FROM stream_final_c4 WHERE source_record_index IS NOT NULL AND text IS NOT NULL",
    "corpus_letter_statistics": f"SELECT idx, length(text)::int AS chars, strlen(text)::int AS bytes, {_letters('text')}::int AS letters, round({_ratio('text')}, 6) AS ratio FROM recs WHERE text IS NOT NULL",
    "corpus_url_leaks": rf"""SELECT DISTINCT idx FROM texts JOIN (SELECT DISTINCT site_id, host FROM sites WHERE site_id IS NOT NULL AND host IS NOT NULL) USING (site_id)
        WHERE regexp_matches(text, '(?i)\b(?:https?://|www\.)\S+') OR contains({normal_sql('text')}, lower(host))""",
    "corpus_audit": r"""SELECT * FROM (UNPIVOT (SELECT sum((text IS NULL)::int)::bigint AS null_text, coalesce(sum((""" + _strip("text") + r""" = '')::int), 0)::bigint AS blank_text,
        coalesce(sum(regexp_matches(text, '(?i)\b(?:https?://|www\.)\S+')::int), 0)::bigint AS url_in_text, coalesce(sum(contains(text, site_id)::int), 0)::bigint AS site_id_in_text,
        coalesce(sum((lower(text_sha256) <> sha256(text))::int), 0)::bigint AS text_hash, coalesce(sum((char_count <> length(text))::int), 0)::bigint AS char_count,
        coalesce(sum((byte_count <> strlen(text))::int), 0)::bigint AS byte_count
        FROM (SELECT DISTINCT source_record_index, site_id, text, text_sha256, char_count, byte_count FROM stream_final_c4 WHERE source_record_index IS NOT NULL)) ON COLUMNS(*) INTO NAME "check" VALUE n)""",
    "raw_host_sites": rf"""SELECT host, n, 'site_' || substr(sha256(host), 1, 20) AS site_id FROM (SELECT host, count(*) AS n FROM (SELECT DISTINCT source_record_index, regexp_replace({HOST}, '^www\.', '') AS host FROM raw_stream)
        WHERE length(host) BETWEEN 1 AND 253 AND contains(host, '.') GROUP BY 1)""",
    "raw_rejected_hosts": rf"""SELECT CASE WHEN length(host) BETWEEN 1 AND 253 AND contains(host, '.') THEN 'host' ELSE 'invalid_url' END AS kind, count(*) AS n
        FROM (SELECT source_record_index, regexp_replace({HOST}, '^www\.', '') AS host FROM (SELECT DISTINCT source_record_index, url FROM raw_stream)) GROUP BY 1""",
    "raw_outcomes": "SELECT outcome, count(*) AS n FROM (SELECT DISTINCT source_record_index, outcome FROM raw_stream) GROUP BY 1",
    "raw_url_hashes": "SELECT DISTINCT source_record_index, sha256(url) AS url_sha256 FROM raw_stream WHERE url IS NOT NULL",
    "site_hash_rank": f"SELECT site_id, {_HASHRANK} AS key, (row_number() OVER (ORDER BY {_HASHRANK}))::int AS rank FROM (SELECT DISTINCT site_id FROM acc)",
    "site_roles": f"""SELECT site_id, role, coalesce(role = 'target' AND mr <= floor(count(*) FILTER (role = 'target') OVER () / 2), false) AS is_member FROM (
        SELECT *, CASE WHEN role = 'target' THEN row_number() OVER (PARTITION BY role ORDER BY sha256('member:{SEED}:' || site_id)) END AS mr FROM (
        SELECT site_id, CASE WHEN rk <= floor(n * 0.5) THEN 'target' WHEN rk <= floor(n * 0.75) THEN 'shadow_auxiliary' ELSE 'public_candidate' END AS role FROM (
        SELECT site_id, row_number() OVER (ORDER BY sha256('role:{SEED}:' || site_id)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT site_id FROM acc))))""",
    "role_overlap_audit": "SELECT a.manifest_id, a.role AS role_a, b.role AS role_b, count(*) AS n FROM mroles a JOIN mroles b ON a.manifest_id = b.manifest_id AND a.site_id = b.site_id AND a.role < b.role GROUP BY ALL",
    "manifest_partition_audit": """SELECT manifest_id, site_id, side FROM (SELECT coalesce(a.manifest_id, b.manifest_id) AS manifest_id, coalesce(a.site_id, b.site_id) AS site_id, CASE WHEN b.site_id IS NULL THEN 'missing' ELSE 'unexpected' END AS side,
        a.site_id IS NULL OR b.site_id IS NULL AS off FROM (SELECT manifest_id, site_id FROM mroles WHERE role = 'target_pool') a
        FULL JOIN (SELECT DISTINCT manifest_id, site_id FROM mroles WHERE role IN ('target_member', 'target_nonmember')) b ON a.manifest_id = b.manifest_id AND a.site_id = b.site_id) WHERE off""",
    "shadow_coverage_audit": """SELECT p.manifest_id, p.site_id, coalesce(i.n, 0)::bigint AS n FROM (SELECT manifest_id, site_id FROM mroles WHERE role = 'target_pool') p
        JOIN (SELECT manifest_id, count(DISTINCT shadow_id) AS s FROM alltrain GROUP BY 1) USING (manifest_id) LEFT JOIN (SELECT manifest_id, site_id, count(DISTINCT shadow_id) AS n FROM alltrain GROUP BY ALL) i
        ON i.manifest_id = p.manifest_id AND i.site_id = p.site_id WHERE coalesce(i.n, 0) IN (0, s)""",
    "balanced_probes": f"""SELECT manifest_id, site_id, sh::int AS shadow_id FROM (SELECT manifest_id, site_id, sh, seg, row_number() OVER (PARTITION BY manifest_id, site_id, seg ORDER BY sha256('probe:{SEED}:' || site_id || ':' || sh::varchar)) AS n
        FROM (SELECT manifest_id, site_id, sh, sh // 8 AS seg FROM pool CROSS JOIN (SELECT unnest(range(16)) AS sh))) WHERE n <= 4""",
    "probe_balance_audit": """SELECT manifest_id, site_id, k AS prefix, n FROM (SELECT manifest_id, site_id, k, count(*) FILTER (shadow_id < k) AS n FROM train JOIN pool USING (manifest_id, site_id)
        CROSS JOIN (VALUES (2), (4)) v(k) GROUP BY ALL) WHERE n * 2 <> k""",
    "auxiliary_groups": f"""SELECT manifest_id, g::int AS group_id, site_id FROM (SELECT manifest_id, g, site_id, row_number() OVER (PARTITION BY manifest_id, g ORDER BY sha256('aux:{SEED}:' || g::varchar || ':' || site_id)) AS n
        FROM (SELECT manifest_id, site_id FROM mroles WHERE role = 'shadow_auxiliary') CROSS JOIN (SELECT unnest(range(4)) AS g)) WHERE n <= 5""",
    "involved_sites": "SELECT DISTINCT manifest_id, site_id FROM alltrain WHERE shadow_id < 2",
    "nonmember_except": "SELECT manifest_id, site_id FROM mroles WHERE role = 'target_pool' EXCEPT SELECT manifest_id, site_id FROM mroles WHERE role = 'target_member'",
    "stratified_split": "SELECT * FROM split",
    "class_histogram": "SELECT split, label, count(*) AS n FROM split GROUP BY ALL",
    "split_priority_dedupe": f"""SELECT h, doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p, doc_id) AS n FROM (SELECT sha256({_collapse('text')}) AS h, doc_id,
        CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, least(doc_id % 10, 2) AS p FROM documents WHERE text IS NOT NULL)) WHERE n = 1""",
    "unit_frequency_topk": "SELECT unit AS token, (row_number() OVER (ORDER BY c DESC, unit) - 1)::int AS id FROM (SELECT unit, count(*) AS c FROM unit_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500)",
    "unit_counts_by_site": "SELECT site_id, count(DISTINCT unit) AS distinct_units, count(*) AS units FROM unit_rows GROUP BY 1",
    "sentence_stats": rf"""SELECT count(*) AS sentences, round(avg(length(x)), 6) AS mean_chars, round(median(length(x)), 6)::double AS median_chars FROM (SELECT unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]?')) AS x FROM texts)
        WHERE {_strip('x')} <> ''""",
    "rare_words": rf"SELECT cnt, count(*) AS words FROM (SELECT w, count(*) AS cnt FROM (SELECT {_fold('x')} AS w FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS x FROM texts)) GROUP BY 1) WHERE cnt <= 2 GROUP BY 1",
    "alphabet": """SELECT manifest_id, token, (row_number() OVER (PARTITION BY manifest_id ORDER BY token) + 4)::int AS id FROM chars UNION ALL
        SELECT manifest_id, t, k FROM (SELECT DISTINCT manifest_id FROM chars) CROSS JOIN (VALUES ('[UNK]', 0), ('[CLS]', 1), ('[SEP]', 2), ('[PAD]', 3), ('[MASK]', 4)) v(t, k)""",
    "pair_counts_two_levels": "SELECT site_id, count(*) AS pairs, sum(cnt)::bigint AS total, max(cnt)::bigint AS most FROM (SELECT site_id, left_, right_, cnt FROM pairs UNION ALL SELECT NULL, left_, right_, sum(cnt)::bigint FROM pairs GROUP BY 2, 3) GROUP BY 1",
    "pair_topk": 'SELECT manifest_id, coord::int AS coord, left_ AS "left", right_ AS "right", cnt FROM cand',
    "candidate_vectors": "SELECT manifest_id, site_id, coord::int AS coord, value FROM vectors",
    "public_site_norms": "SELECT * FROM norms",
    "public_clip_bound": "SELECT manifest_id, greatest(1, ceil(quantile_cont(norm, 0.75)))::bigint AS bound FROM norms GROUP BY 1",
    "l1_clip": "SELECT manifest_id, site_id, coord::int AS coord, value FROM clip",
    "clipped_vector_sum": "SELECT manifest_id, coord::int AS coord, sum(value)::bigint AS value FROM clip GROUP BY ALL",
    "plain_vector_sum": "SELECT manifest_id, coord::int AS coord, sum(value)::bigint AS value FROM vectors GROUP BY ALL",
    "substring_counts": "SELECT manifest_id, site_id, count(*) AS tokens, sum(cnt)::bigint AS total FROM mtok JOIN pool USING (manifest_id, site_id) GROUP BY ALL",
    "global_token_counts": "SELECT token, sum(cnt)::bigint AS cnt FROM tok GROUP BY 1",
    "background_counts": "SELECT * FROM bg",
    "vocab_truncate": "SELECT manifest_id, token, id::int AS id FROM vocab WHERE id < 300",
    "min_count_filter": """SELECT manifest_id, least, token, (row_number() OVER (PARTITION BY manifest_id, least ORDER BY id) - 1)::int AS id FROM (
        SELECT DISTINCT manifest_id, least, '[UNK]' AS token, -1 AS id FROM vocab CROSS JOIN (VALUES (10), (50), (200)) v(least)
        UNION ALL SELECT manifest_id, least, token, id FROM vocab JOIN bg USING (manifest_id, token) CROSS JOIN (VALUES (10), (50), (200)) v(least) WHERE cnt >= least)""",
    "merge_validity": """WITH known AS (SELECT manifest_id, token FROM vocab UNION SELECT manifest_id, token FROM chars)
        SELECT r.manifest_id, coord::int AS coord, left_ AS "left", right_ AS "right" FROM (SELECT * FROM ranked WHERE coord < 2000) r JOIN known a ON a.manifest_id = r.manifest_id AND a.token = left_
        JOIN known b ON b.manifest_id = r.manifest_id AND b.token = right_ JOIN known c ON c.manifest_id = r.manifest_id AND c.token = left_ || right_""",
    "vocab_jaccard": """SELECT manifest_id, shadow_id, round(coalesce(c, 0)::double / (n + m - coalesce(c, 0)), 6) AS jaccard FROM (SELECT manifest_id, shadow_id, count(*) AS n FROM shadow GROUP BY ALL)
        LEFT JOIN (SELECT manifest_id, shadow_id, count(*) AS c FROM shadow JOIN vocab USING (manifest_id, token) GROUP BY ALL) USING (manifest_id, shadow_id) JOIN (SELECT manifest_id, count(*) AS m FROM vocab GROUP BY 1) USING (manifest_id)""",
    "shadow_overlap_score": """WITH ids AS MATERIALIZED (SELECT DISTINCT manifest_id, shadow_id FROM shadow),
        side AS MATERIALIZED (SELECT p.manifest_id, p.site_id, s.shadow_id, t.site_id IS NOT NULL AS i FROM pool p JOIN ids s USING (manifest_id) LEFT JOIN train t ON t.manifest_id = p.manifest_id AND t.site_id = p.site_id AND t.shadow_id = s.shadow_id),
        tokens AS MATERIALIZED (SELECT manifest_id, token FROM vocab UNION SELECT manifest_id, token FROM shadow),
        mixed AS MATERIALIZED (SELECT manifest_id, site_id, token FROM shadow JOIN side USING (manifest_id, shadow_id) GROUP BY ALL HAVING bool_or(i) AND bool_or(NOT i)),
        kept AS MATERIALIZED (SELECT p.manifest_id, p.site_id, t.token, v.token IS NOT NULL AS tgt FROM pool p JOIN tokens t USING (manifest_id) LEFT JOIN vocab v ON v.manifest_id = t.manifest_id AND v.token = t.token
            WHERE (p.manifest_id, p.site_id, t.token) NOT IN (SELECT manifest_id, site_id, token FROM mixed)),
        target AS (SELECT manifest_id, site_id, count(*) FILTER (tgt) AS m FROM kept GROUP BY ALL),
        held AS (SELECT k.manifest_id, k.site_id, s.shadow_id, count(*) AS n, count(*) FILTER (tgt) AS c FROM kept k JOIN shadow s USING (manifest_id, token) GROUP BY ALL)
        SELECT manifest_id, site_id, round((avg(j) FILTER (i) - avg(j) FILTER (NOT i) + 1) / 2, 6) AS score FROM (SELECT d.manifest_id, d.site_id, d.i, coalesce(coalesce(c, 0)::double / nullif(coalesce(m, 0) + coalesce(n, 0) - coalesce(c, 0), 0), 0) AS j
            FROM side d LEFT JOIN held h ON h.manifest_id = d.manifest_id AND h.site_id = d.site_id AND h.shadow_id = d.shadow_id LEFT JOIN target g ON g.manifest_id = d.manifest_id AND g.site_id = d.site_id)
        GROUP BY ALL HAVING count(*) FILTER (i) > 0 AND count(*) FILTER (NOT i) > 0""",
    "rank_correlation": "SELECT manifest_id, shadow_id, round(coalesce(r, 0), 6) AS r FROM (SELECT DISTINCT manifest_id, shadow_id FROM shadow) LEFT JOIN corr USING (manifest_id, shadow_id)",
    "merge_similarity_score": """SELECT manifest_id, site_id, round((a - b + 2) / 4, 6) AS score FROM (SELECT p.manifest_id, p.site_id, avg(coalesce(r, 0)) FILTER (t.site_id IS NOT NULL) AS a, avg(coalesce(r, 0)) FILTER (t.site_id IS NULL) AS b
        FROM pool p JOIN (SELECT DISTINCT manifest_id, shadow_id FROM shadow) s USING (manifest_id) LEFT JOIN corr c ON c.manifest_id = p.manifest_id AND c.shadow_id = s.shadow_id
        LEFT JOIN train t ON t.manifest_id = p.manifest_id AND t.site_id = p.site_id AND t.shadow_id = s.shadow_id GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "zipf_rarity": "SELECT manifest_id, token, rank::int AS rank, round(rarity, 6) AS rarity FROM rarity",
    "frequency_score": """SELECT p.manifest_id, p.site_id, round(coalesce(max(d.cnt::double / d.den * r.rarity), 0), 6) AS score FROM present p LEFT JOIN (SELECT * FROM den WHERE bg IS NOT NULL AND den > 0) d USING (manifest_id, site_id)
        LEFT JOIN rarity r ON r.manifest_id = p.manifest_id AND r.token = d.token GROUP BY ALL""",
    "naive_bayes_score": """SELECT p.manifest_id, p.site_id, CASE WHEN max(coalesce(q, 0)) >= 1 THEN 1e300 ELSE round(coalesce(-sum(ln(1 - least(coalesce(q, 0), 0.9999999999999))), 0), 6) END AS score FROM present p
        LEFT JOIN (SELECT manifest_id, site_id, cnt::double / den AS q FROM den JOIN (SELECT manifest_id, token FROM (SELECT manifest_id, token, row_number() OVER (PARTITION BY manifest_id ORDER BY id DESC, token) AS n FROM vocab) WHERE n <= 500) USING (manifest_id, token)) d
        USING (manifest_id, site_id) GROUP BY ALL""",
    "site_compression_score": "SELECT site_id, bytes, tokens, round(score, 6) AS score FROM comp",
    "labelled_scores": "SELECT * FROM complab",
    "site_compression_auc": None,
    "attack_metrics": "SELECT run_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("roc_auc", "balanced_accuracy", "tpr_at_fpr_le_0_01", "tpr_at_fpr_le_0_001", "average_precision")) + " FROM met",
    "roc_curve": "SELECT run_id, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(score, 6) AS threshold FROM steps UNION ALL SELECT DISTINCT run_id, 0.0, 0.0, NULL::double FROM steps",
    "pr_curve": "SELECT run_id, round(tpr, 6) AS recall, round(precision, 6) AS precision, round(score, 6) AS threshold FROM steps UNION ALL SELECT DISTINCT run_id, 0.0, 1.0, NULL::double FROM steps",
    "paired_difference": "SELECT manifest, count(*) AS n, round(avg(sa - sb), 6) AS difference FROM paired GROUP BY 1",
    "paired_conflicts": """SELECT coalesce(a.manifest, b.manifest) AS manifest, coalesce(a.site_id, b.site_id) AS site_id, CASE WHEN a.score IS NULL THEN 'only_b' WHEN b.score IS NULL THEN 'only_a' ELSE 'label' END AS conflict
        FROM (SELECT * FROM best WHERE attack = 'compression') a FULL JOIN (SELECT * FROM best WHERE attack = 'frequency_estimation') b ON a.manifest = b.manifest AND a.site_id = b.site_id
        WHERE a.score IS NULL OR b.score IS NULL OR a.label <> b.label""",
    "method_attack_aggregate": "SELECT attack, count(roc_auc) AS n, round(avg(roc_auc), 6) AS mean, round(coalesce(stddev_samp(roc_auc), 0), 6) AS sd FROM runs GROUP BY 1",
    "direction_adapted_auc": "SELECT attack, round(avg(greatest(roc_auc, 1 - roc_auc)), 6) AS adapted, round(avg(abs(roc_auc - 0.5) * 2), 6) AS deviation FROM runs GROUP BY 1",
    "attack_matrix": "SELECT manifest, " + ", ".join(f"round(max(roc_auc) FILTER (attack = '{a}'), 6) AS {a}" for a in ("compression", "frequency_estimation", "merge_similarity", "naive_bayes")) + " FROM runs GROUP BY 1",
    "strongest_attack": "SELECT manifest, attack, round(roc_auc, 6) AS roc_auc FROM (SELECT *, row_number() OVER (PARTITION BY manifest ORDER BY round(roc_auc, 9) DESC, attack DESC) AS n FROM runs) WHERE n = 1",
    "scale_sweep": "SELECT scale_name, attack, count(roc_auc) AS n, round(avg(roc_auc), 6) AS mean, round(coalesce(stddev_samp(roc_auc), 0), 6) AS sd FROM runs JOIN (SELECT DISTINCT manifest_id AS manifest, scale_name, seed FROM manifests) USING (manifest) GROUP BY ALL",
    "numeric_registry": " UNION ALL ".join(f"SELECT run_id, '{m}' AS field, round({m}, 6) AS value FROM met" for m in ("roc_auc", "balanced_accuracy", "tpr_at_fpr_le_0_01", "tpr_at_fpr_le_0_001", "average_precision")),
    "expected_matrix_missing": """SELECT manifest, attack, 'missing' AS side FROM ((SELECT m AS manifest, a AS attack FROM (SELECT DISTINCT manifest_id AS m FROM manifests) CROSS JOIN (VALUES ('compression'), ('frequency_estimation'), ('merge_similarity'), ('naive_bayes'), ('vocabulary_overlap')) v(a))
        EXCEPT SELECT manifest, attack FROM runs) UNION ALL SELECT DISTINCT manifest, attack, 'unexpected' FROM runs WHERE manifest NOT IN (SELECT manifest_id FROM manifests)""",
    "run_balance": "SELECT run_id, count(*) AS n_rows, count(DISTINCT site_id) AS sites, count(DISTINCT site_id) FILTER (is_member) AS members, sum((score IS NULL)::int)::bigint AS null_scores, count(*) - count(DISTINCT site_id) AS repeated FROM attack_details WHERE run_id IS NOT NULL GROUP BY 1",
    "non_finite_scores": "SELECT run_id, count(*) AS n FROM attack_details WHERE score IS NULL OR isnan(score) OR isinf(score) GROUP BY 1",
    "duplicate_result_keys": "SELECT run_id, site_id, count(*) AS n FROM attack_details GROUP BY ALL HAVING count(*) > 1",
    "delivery_delays": """SELECT outcome, count(*) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS sd, round(min(x), 6) AS least, round(median(x), 6) AS median, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS most
        FROM (SELECT outcome, round((epoch_us(arrived_at) - epoch_us(fetched_at)) / 1e6, 3) AS x FROM (SELECT DISTINCT * FROM raw_stream WHERE fetched_at IS NOT NULL)) GROUP BY 1""",
    "pareto_front": """SELECT p_brand, price, size, n FROM (SELECT p_brand, round(avg(p_retailprice), 6) AS price, round(avg(p_size), 6) AS size, count(*)::double AS n FROM part GROUP BY 1) a
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_brand, round(avg(p_retailprice), 6) AS price, round(avg(p_size), 6) AS size FROM part GROUP BY 1) b WHERE b.p_brand <> a.p_brand AND b.price <= a.price AND b.size <= a.size AND (b.price < a.price OR b.size < a.size))""",
    "objective_shortlist": "SELECT p_partkey, mode, p_size, p_retailprice, n::int AS place FROM (SELECT p_partkey, p_type AS mode, p_size, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice, p_partkey) AS n FROM part) WHERE n <= 3",
    "primary_secondary": """SELECT mode, id, pick FROM (SELECT p_type AS mode, p_partkey AS id, 'primary' AS pick, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice, p_partkey) AS n FROM part) WHERE n = 1 UNION ALL
        SELECT mode, id, 'secondary' FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY p_retailprice, p_size, id) AS k FROM (SELECT p_type AS mode, p_partkey AS id, p_size, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice, p_partkey) AS n FROM part) WHERE n > 1) WHERE k = 1""",
    "utility_limits": "SELECT p_size / 100.0 <= 0.20 AND p_retailprice % 7 <= 3.0 AS admissible, count(*) AS n FROM part GROUP BY 1",
    "one_factor_grid": "SELECT * FROM (VALUES (0, '1024', '32', 'P75'), (1, '512', '32', 'P75'), (2, '2048', '32', 'P75'), (3, '1024', '16', 'P75'), (4, '1024', '64', 'P75'), (5, '1024', '32', 'P50'), (6, '1024', '32', 'P90')) t(pos, k, b, clip)",
    "configuration_ids": "SELECT p_partkey, p_type || '__eps-' || replace(p_size::varchar, '.', 'p') || '__k-' || p_partkey::varchar AS id FROM part",
    "attack_task_matrix": f"SELECT s::int AS seed, v::int AS vocab_size, m AS method_id, a AS attack FROM (VALUES ({SEED}), ({SEED + 1}), ({SEED + 2})) x(s), (VALUES (4000), (8000), (16000), (32000)) y(v), (VALUES ('plain'), ('min2'), ('sa_dp')) z(m), (VALUES ('compression_rate'), ('vocabulary_overlap'), ('merge_similarity'), ('frequency_estimation'), ('naive_bayes')) w(a)",
    "ordered_methods": "SELECT l_returnflag || '-' || l_linestatus AS method, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1",
    "class_scores": """SELECT c AS class, round(coalesce(hit::double / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(hit::double / nullif(support, 0), 0), 6) AS recall, round(2 * hit::double / (guessed + support), 6) AS f1, support::bigint AS support
        FROM (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS guessed, count(*) FILTER (label = c AND prediction = c) AS hit FROM pred CROSS JOIN (SELECT unnest(range(4))::int AS c) GROUP BY 1)""",
    "macro_f1": """SELECT round(avg(2 * hit::double / (guessed + support)), 6) AS macro_f1, count(*) AS classes, round((SELECT avg((label = prediction)::int) FROM pred), 6) AS accuracy
        FROM (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS guessed, count(*) FILTER (label = c AND prediction = c) AS hit FROM pred CROSS JOIN (SELECT unnest(range(4))::int AS c) GROUP BY 1)""",
    "best_epoch": """SELECT run, epoch, f1, p IS NULL OR f1 > p AS improved, greatest(f1, coalesce(p, f1)) AS best FROM (SELECT *, max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
        FROM (SELECT l_orderkey AS run, l_linenumber AS epoch, max(l_extendedprice) AS f1 FROM lineitem GROUP BY ALL))""",
    "epsilon_accounting": "SELECT l_returnflag, l_linestatus, count(*) AS rounds, round(min(e), 6) AS least, round(max(e), 6) AS most, round(sum(e), 6) AS epsilon FROM (SELECT l_returnflag, l_linestatus, round(l_discount + 0.01, 2) AS e FROM lineitem) GROUP BY ALL",
    "bytes_accounting": "SELECT clients, k, (clients * k * 512)::int AS upload_bytes, (k * 512)::int AS aggregate_bytes FROM cells",
    "resource_extrapolation": "SELECT round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE l_quantity * 12 END), 6) AS seconds, sum(CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_partkey * 12 END)::bigint AS bytes FROM lineitem",
    "cost_grid": "SELECT g.clients::int AS clients, g.k::int AS k, round(coalesce(seconds, g.clients * g.k / 1000.0), 6)::double AS seconds, CASE WHEN seconds IS NULL THEN 'extrapolated' ELSE 'measured' END AS data_source FROM (SELECT * FROM (VALUES (1), (2), (4), (8), (16), (32), (64), (128)) a(clients), (VALUES (128), (256), (512), (1024), (2048)) b(k)) g LEFT JOIN cells c ON c.clients = g.clients AND c.k = g.k",
    "cost_matrix": "SELECT clients, " + ", ".join(f'round(max(seconds) FILTER (k = {k}), 6) AS "{k}"' for k in (128, 256, 512, 1024)) + " FROM cells GROUP BY 1",
    "cost_unpivot": " UNION ALL ".join(f"SELECT l_returnflag, '{s}' AS stage, round(avg({c}), 6) AS seconds FROM lineitem GROUP BY 1" for s, c in (("encrypt", "l_quantity"), ("noise", "l_discount"), ("decrypt", "l_tax"))),
    "cost_regression": "SELECT round(regr_slope(seconds, clients * k), 6) AS slope, round(regr_intercept(seconds, clients * k), 6) AS intercept, round(regr_r2(seconds, clients * k), 6) AS r2 FROM cells",
    "method_labels": "SELECT CASE l_returnflag WHEN 'A' THEN 'Plain BPE' WHEN 'R' THEN 'Local DP' ELSE l_returnflag END AS method, count(*) AS n FROM lineitem GROUP BY 1",
    "encrypted_sum": "SELECT manifest_id, coord::int AS coord, sum(value)::bigint AS value FROM vectors GROUP BY ALL",
    "events_windowed": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "corpus_normalized_hash": f"SELECT idx, sha256({normal_sql('text')}) AS normalized FROM recs WHERE text IS NOT NULL",
    "corpus_sequential": """WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY idx) AS i, idx, site_id, h FROM acc),
        r AS (SELECT 0::bigint AS i, []::varchar[] AS sites, []::varchar[] AS hs, NULL::bigint AS idx, NULL::varchar AS site_id UNION ALL
        SELECT i, CASE WHEN ok THEN list_append(sites, s) ELSE sites END, CASE WHEN ok THEN list_append(hs, h) ELSE hs END, CASE WHEN ok THEN x END, CASE WHEN ok THEN s END FROM (
            SELECT o.i, r.sites, r.hs, o.idx AS x, o.site_id AS s, o.h, NOT list_contains(r.hs, o.h) AND len(list_filter(r.sites, lambda z: z = o.site_id)) < 20 AS ok FROM r JOIN o ON o.i = r.i + 1))
        SELECT idx, site_id FROM r WHERE idx IS NOT NULL""",
    "final_corpus": f"""WITH n AS (SELECT idx, site_id, text, sha256({normal_sql('text')}) AS nh FROM checked WHERE reason IS NULL AND site_id IS NOT NULL),
        f AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY idx) AS n FROM (SELECT *, row_number() OVER (PARTITION BY nh ORDER BY idx) AS c FROM n) WHERE c = 1),
        k AS MATERIALIZED (SELECT * FROM f WHERE n <= 20),
        q AS (SELECT site_id FROM k GROUP BY 1 HAVING count(*) >= 5 ORDER BY sha256('final:main:{SEED}:' || site_id) LIMIT 40)
        SELECT idx, site_id, length(text)::int AS char_count, strlen(text)::int AS byte_count FROM k JOIN q USING (site_id)""",
    "built_manifest": f"""WITH p AS MATERIALIZED (SELECT site_id, CASE WHEN rk <= floor(n * 0.5) THEN 'target' WHEN rk <= floor(n * 0.75) THEN 'shadow_auxiliary' ELSE 'public_candidate' END AS role FROM (
        SELECT site_id, row_number() OVER (ORDER BY sha256('role:{SEED}:' || site_id)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT site_id FROM acc))),
        t AS MATERIALIZED (SELECT site_id, row_number() OVER (ORDER BY sha256('member:{SEED}:' || site_id)) AS mr, count(*) OVER () AS n FROM p WHERE role = 'target')
        SELECT role, site_id, NULL::int AS shadow_id FROM p WHERE role <> 'target' UNION ALL SELECT CASE WHEN mr <= floor(n / 2) THEN 'target_member' ELSE 'target_nonmember' END, site_id, NULL FROM t
        UNION ALL SELECT 'probe', site_id, sh::int FROM (SELECT site_id, sh, row_number() OVER (PARTITION BY site_id ORDER BY sha256('probe:{SEED}:' || site_id || ':' || sh::varchar)) AS n FROM t CROSS JOIN (SELECT unnest(range(8)) AS sh)) WHERE n <= 4""",
    "mean_roc_on_grid": r"""WITH f AS MATERIALIZED (SELECT run_id, fpr, max(tpr) AS tpr FROM (SELECT run_id, fpr, tpr FROM steps UNION ALL SELECT DISTINCT run_id, 0.0, 0.0 FROM steps) GROUP BY ALL),
        g AS (SELECT r.run_id, i / 500.0::double AS x FROM (SELECT DISTINCT run_id FROM f) r CROSS JOIN (SELECT unnest(range(501)) AS i)),
        b AS (SELECT g.run_id, g.x, a.fpr AS f0, a.tpr AS t0 FROM g ASOF JOIN f a ON a.run_id = g.run_id AND a.fpr <= g.x),
        e AS (SELECT b.*, c.fpr AS f1, c.tpr AS t1 FROM b ASOF JOIN f c ON c.run_id = b.run_id AND c.fpr >= b.x),
        v AS (SELECT regexp_extract(run_id, '^run_\d+_(.*)$', 1) AS attack, x, t0 + CASE WHEN f1 > f0 THEN (t1 - t0) / (f1 - f0) ELSE 0 END * (x - f0) AS tpr FROM e),
        m AS (SELECT attack, round(x, 4) AS x, avg(tpr) AS mean, coalesce(stddev_samp(tpr), 0) AS sd FROM v GROUP BY attack, round(x, 4))
        SELECT attack, round(x, 6) AS x, round(mean, 6) AS mean, round(greatest(0, mean - sd), 6) AS low, round(least(1, mean + sd), 6) AS high FROM m""",
    "events_sessions": """SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k""",
    "site_index": "SELECT site_id, count(*) AS texts, sum(strlen(text))::bigint AS bytes FROM texts GROUP BY 1",
    "retained_audit": r"""WITH a AS MATERIALIZED (SELECT *, sha256(text) AS d FROM acc), c AS (SELECT 'digest' AS k, idx, site_id, d AS v FROM a UNION ALL SELECT 'norm', idx, site_id, h FROM a),
        l AS (SELECT k, site_id = first_value(site_id) OVER w AS own, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY k, v ORDER BY idx))
        SELECT "check", n FROM (SELECT 'empty' AS "check", 0::bigint AS n UNION ALL SELECT 'url_in_text', count(*) FILTER (regexp_matches(text, '(?i)\b(?:https?://|www\.)\S+')) FROM a
        UNION ALL SELECT 'site_id_in_text', count(*) FILTER (contains(text, site_id)) FROM a
        UNION ALL SELECT k || '_copy_' || s, count(*) FILTER (l.n > 1 AND own = (s = 'within')) FROM l CROSS JOIN (VALUES ('within'), ('across')) v(s) GROUP BY k, s)""",
    "manifest_audit": """WITH h AS (SELECT manifest_id, site_id, list(role) AS r FROM mroles GROUP BY ALL),
        p AS (SELECT DISTINCT manifest_id, sid, kind, site_id FROM (SELECT manifest_id, p.shadow_id AS sid, 'a' AS kind, unnest(p.auxiliary_site_ids) AS site_id FROM (SELECT manifest_id, unnest(shadow_plans) AS p FROM manifests)
            UNION ALL SELECT manifest_id, p.shadow_id, 'a', unnest(p.target_probe_site_ids) FROM (SELECT manifest_id, unnest(shadow_plans) AS p FROM manifests)
            UNION ALL SELECT manifest_id, p.shadow_id, 't', unnest(p.training_site_ids) FROM (SELECT manifest_id, unnest(shadow_plans) AS p FROM manifests)) WHERE site_id IS NOT NULL),
        c AS (SELECT manifest_id, list_has_all(r, ['target_member', 'target_nonmember']) AS c1, list_contains(r, 'target_pool') AND NOT list_has_any(r, ['target_member', 'target_nonmember']) AS c2,
            list_has_any(r, ['target_member', 'target_nonmember']) AND NOT list_contains(r, 'target_pool') AS c3, list_has_all(r, ['target_pool', 'shadow_auxiliary']) AS c4, list_has_all(r, ['target_pool', 'public_candidate']) AS c5,
            list_has_all(r, ['shadow_auxiliary', 'public_candidate']) AS c6 FROM h)
        SELECT manifest_id, name AS "check", sum((CASE name WHEN 'member_and_nonmember' THEN c1 WHEN 'pool_in_neither' THEN c2 WHEN 'split_outside_pool' THEN c3 WHEN 'target_and_auxiliary' THEN c4 WHEN 'target_and_public' THEN c5 ELSE c6 END)::int)::bigint AS n
        FROM c CROSS JOIN (VALUES ('member_and_nonmember'), ('pool_in_neither'), ('split_outside_pool'), ('target_and_auxiliary'), ('target_and_public'), ('auxiliary_and_public')) v(name) GROUP BY ALL
        UNION ALL SELECT manifest_id, 'training_mismatch', sum((k = 1)::int)::bigint FROM (SELECT manifest_id, sid, site_id, count(*) AS k FROM p GROUP BY ALL) GROUP BY 1""",
    "sql_views": """SELECT manifest_id, is_member, sum(cnt)::bigint AS units, count(DISTINCT site_id) AS sites FROM units JOIN (SELECT manifest_id, site_id, (manifest_id, site_id) IN (SELECT manifest_id, site_id FROM member) AS is_member FROM pool) USING (site_id) GROUP BY ALL""",
    "benchmark_summary": """WITH r AS (SELECT (2 ** (l_linenumber - 1))::int AS clients, (2 ** (7 + l_suppkey % 4))::int AS k, l_orderkey % 20 AS rep, avg(l_extendedprice) AS total, avg(l_quantity) AS encrypt, avg(l_tax) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
        a AS (SELECT clients, k, count(*) AS repetitions, round(median(total), 6) AS median, round(avg(total), 6) AS mean, round(coalesce(stddev_samp(total), 0), 6) AS sd, round(quantile_cont(total, 0.95), 6) AS p95, round(median(encrypt), 6) AS encrypt_median, round(median(s), 6) AS sum_median FROM r GROUP BY ALL)
        SELECT g.clients::int AS clients, g.k::int AS k, coalesce(repetitions, 0) AS repetitions, median, mean, sd, p95, encrypt_median, sum_median, coalesce(repetitions = 20, false) AS complete
        FROM (SELECT * FROM (VALUES (1), (2), (4), (8), (16)) x(clients), (VALUES (128), (256), (512), (1024)) y(k)) g LEFT JOIN a ON a.clients = g.clients AND a.k = g.k""",
    "grouped_report": """SELECT scale_name, attack, format('{:.3f} ± {:.3f}', round(avg(roc_auc), 6), round(coalesce(stddev_samp(roc_auc), 0), 6)) AS roc_auc, format('{:.3f} ± {:.3f}', round(avg(balanced_accuracy), 6), round(coalesce(stddev_samp(balanced_accuracy), 0), 6)) AS balanced_accuracy
        FROM runs JOIN (SELECT DISTINCT manifest_id AS manifest, scale_name FROM manifests) USING (manifest) GROUP BY ALL""",
    "parameter_sweeps": """SELECT parameter, value, attack, count(roc_auc) AS n, round(avg(roc_auc), 6) AS mean, round(coalesce(stddev_samp(roc_auc), 0), 6) AS sd FROM runs JOIN (
        SELECT DISTINCT manifest_id AS manifest, unnest(['scale_name', 'seed', 'minimum_texts_per_site', 'maximum_texts_per_site']) AS parameter, unnest([scale_name, seed::varchar, minimum_texts_per_site::varchar, maximum_texts_per_site::varchar]) AS value FROM manifests) USING (manifest) GROUP BY ALL""",
    "sigmoid_scores": "SELECT run_id, site_id, round(1 / (1 + exp(-score)), 6) AS p FROM sc",
    "fixed_length_ids": """SELECT p_partkey, list_concat([101], list_concat(list_transform(range(1, least(p_size, 14) + 1), lambda i: CASE WHEN i >= 40 THEN 100 ELSE i END), list_concat([102], list_transform(range(1, 14 - least(p_size, 14) + 1), lambda i: 0)))) AS ids FROM part""",
    "shortlist_inputs": """WITH m AS (SELECT CASE l_returnflag WHEN 'N' THEN 'plain' ELSE l_returnflag END AS method_id, avg(l_discount) AS auc, avg(l_quantity) AS t FROM lineitem GROUP BY 1)
        SELECT method_id, round(auc, 6) AS auc, round(t / (SELECT t FROM m WHERE method_id = 'plain') - 1, 6) AS token_increase FROM m""",
    "validation_means": "SELECT CASE l_returnflag WHEN 'N' THEN 'plain' ELSE l_returnflag END AS method_id, round(avg(l_tax), 6) AS macro_f1 FROM lineitem GROUP BY 1",
    "pareto_costs": """WITH m AS (SELECT CASE l_returnflag WHEN 'N' THEN 'plain' ELSE l_returnflag END AS method_id, avg(l_discount) AS auc, avg(l_quantity) AS t FROM lineitem GROUP BY 1),
        r AS (SELECT method_id, auc, t / (SELECT t FROM m WHERE method_id = 'plain') AS q FROM m)
        SELECT method_id, round(auc, 6) AS roc_auc, round(q, 6) AS time_ratio FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.method_id <> a.method_id AND b.auc <= a.auc AND b.q <= a.q AND (b.auc < a.auc OR b.q < a.q))""",
    "noisy_sums": "SELECT coord::int AS coord, (sum(value) + coord % 7 - 3)::bigint AS value, (coord % 7 - 3)::bigint AS noise FROM vectors GROUP BY coord",
    "interval_audit": "SELECT p_partkey FROM part WHERE NOT p_retailprice BETWEEN 950 AND 1500 OR p_size > 45",
    "development_sites": """WITH c AS (SELECT site_id, count(*) AS n FROM acc GROUP BY 1) SELECT site_id FROM c WHERE n BETWEEN 3 AND 6 OR n >= 10 AND site_id >= 'site_8'""",
    "search_plan": """SELECT * FROM (VALUES ('sa_dp', 0, '1024', '32', 'sa_dp__k-1024__b-32'), ('sa_dp', 1, '512', '32', 'sa_dp__k-512__b-32'), ('sa_dp', 2, '1024', '16', 'sa_dp__k-1024__b-16'), ('plain', 0, '1024', '32', 'plain__k-1024__b-32'), ('plain', 1, '1024', '64', 'plain__k-1024__b-64')) t(mode, pos, k, b, id)""",
    "merged_units": """WITH e AS (SELECT replace(replace(unit, 'th', chr(57344)), 'in', chr(57345)) AS u, cnt FROM units), c AS (SELECT unnest(string_split(u, '')) AS x, cnt FROM e)
        SELECT CASE x WHEN chr(57344) THEN 'th' WHEN chr(57345) THEN 'in' ELSE x END AS symbol, sum(cnt)::bigint AS cnt FROM c WHERE x <> '' GROUP BY 1""",
    "pair_recount": """WITH e AS (SELECT replace(replace(unit, 'th', chr(57344)), 'in', chr(57345)) AS u, sum(cnt) AS cnt FROM units GROUP BY 1), p AS (SELECT substr(u, i, 1) AS a, substr(u, i + 1, 1) AS b, cnt FROM (SELECT u, cnt, unnest(range(1, length(u))) AS i FROM e))
        SELECT replace(replace(a, chr(57344), 'th'), chr(57345), 'in') AS "left", replace(replace(b, chr(57344), 'th'), chr(57345), 'in') AS "right", sum(cnt)::bigint AS cnt FROM p GROUP BY ALL""",
}
# the same metrics over another ranking
BODIES["site_compression_auc"] = None


def queries() -> dict[str, str]:
    out = {name: _with(body) for name, body in BODIES.items() if body}
    metric = _with(BODIES["attack_metrics"]).replace(PARTS["sc"], "SELECT * FROM complab")
    head = _with("SELECT * FROM complab").removesuffix(" SELECT * FROM complab").removeprefix("WITH ")
    out["site_compression_auc"] = "WITH " + head + ", " + metric.removeprefix("WITH ")
    return out

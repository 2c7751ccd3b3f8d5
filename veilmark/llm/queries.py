"""Queries pN_... of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmark import oracles
from veilmark.llm import boilerplate, encoding, formatting, leakage, lookalikes, overlap, quality, splits, subjects, terms, textform


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": terms.marked_terms,
        "p2_found": lookalikes.same_look,
        "p3_found": quality.doubtful_texts,
        "p3_statistics": quality.statistics,
        "p4_found": boilerplate.site_lines,
        "p4_texts": boilerplate.stripped_texts,
        "p5_found": overlap.split_overlaps,
        "p5_report": overlap.overlap_report,
        "p5_members": overlap.identical_classes,
        "p6_classes": formatting.copy_counts,
        "p6_found": formatting.same_but_formatting,
        "p6_members": formatting.class_members,
        "p7_found": splits.broken_lists,
        "p7_assignment": splits.assignment,
        "p8_ids": encoding.token_ids,
        "p8_texts": encoding.round_trip,
        "p9_found": leakage.leaked_items,
        "p9_report": leakage.leak_report,
        "p10_found": subjects.subject_areas,
        "p1_counts": terms.all_terms,
        "p2_texts": lookalikes.consistent_texts,
        "p2_members": lookalikes.look_members,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a result. The others are held against brute force, round trips or held-out labels in tests."""
    nobody = ", ".join(f"'{x}'" for x in splits.NOBODY)

    def name(column: str) -> str:
        plain = rf"regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
        return f"CASE WHEN {plain} NOT IN ({nobody}) AND NOT regexp_matches(lower({column}), 'redacted|privacy|whois') THEN {plain} END"

    r = "r AS MATERIALIZED (SELECT DISTINCT source_record_index AS i, site_id, text FROM stream_final_c4 WHERE source_record_index IS NOT NULL)"
    terms_sql = rf"""{r}, t AS MATERIALIZED (SELECT i, unnest(regexp_extract_all({oracles.nfkc_sql("text")}, '[\p{{L}}\p{{N}}_]+')) AS term FROM r WHERE text IS NOT NULL),
            c AS MATERIALIZED (SELECT 'text' AS field_name, term, count(*) AS occurrences, count(DISTINCT i) AS records FROM t GROUP BY term
            UNION ALL SELECT 'site_id', site_id, count(*), count(*) FROM r WHERE site_id IS NOT NULL GROUP BY site_id)"""
    lines_sql = rf"""{r}, l AS MATERIALIZED (SELECT i, site_id, k, raw, regexp_replace({oracles.normal_sql("raw")}, '[0-9]+', '#', 'g') AS line FROM (SELECT i, site_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM r WHERE text IS NOT NULL)),
            f AS MATERIALIZED (SELECT site_id, line FROM (SELECT site_id, line, count(DISTINCT i) AS n FROM l WHERE line <> '' AND site_id IS NOT NULL GROUP BY ALL) JOIN (SELECT site_id, count(*) AS m FROM r GROUP BY 1) USING (site_id) WHERE n >= 5 AND n >= 0.1 * m)"""

    lower = textform.lower_pairs()
    caseless = f"nfc_normalize(translate(replace(replace(lower({textform.fold_sql('text')}), 'ς', 'σ'), 'ß', 'ss'), '{''.join(lower)}', '{''.join(lower.values())}'))"
    plain_words = rf"list_filter(regexp_split_to_array(regexp_replace({caseless}, '[^\p{{L}}\p{{N}}\p{{M}}\s]+', '', 'g'), '[\s\x0b\x1c-\x1f\x{{85}}]+'), lambda y: y <> '')"
    drop = r"'[^\p{L}\p{N}\p{M}]+', '', 'g'"
    # labelled fields: parts between line ends, bars and semicolons, each beginning with a label and a colon
    field = r"'^[^\p{L}\p{N}_]*[\p{L}\p{N}_][^:.!?\n]{0,40}?\s*:\s*[^\s\p{Z}]'"
    forms_sql = rf"""{r}, m AS MATERIALIZED (SELECT i, regexp_replace(z, {drop}) AS letters, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda y: regexp_matches(y, {field}))) = len(parts)
            THEN array_to_string(list_sort(list_transform(parts, lambda y: regexp_replace(y, {drop}))), chr(10)) END AS fields FROM (
            SELECT i, z, list_filter(regexp_split_to_array(z, '[\n|;]'), lambda y: regexp_replace(y, '[\s\p{{Z}}]+', '', 'g') <> '') AS parts FROM (SELECT i, {caseless} AS z FROM r WHERE text IS NOT NULL)))"""
    classes_sql = f"""RECURSIVE {forms_sql}, e AS MATERIALIZED (SELECT DISTINCT a.letters AS a, b.letters AS b FROM m a JOIN m b ON a.fields = b.fields AND a.letters <> b.letters),
            c AS (SELECT DISTINCT letters AS a, letters AS b FROM m UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), g AS MATERIALIZED (SELECT a AS letters, min(b) AS class FROM c GROUP BY 1)"""
    sides = " UNION ALL ".join(f"SELECT manifest_id, unnest({n}) AS site_id, {k} AS side FROM manifests" for k, n in enumerate((overlap.MEMBER, overlap.NONMEMBER)))
    overlap_sql = f"""{r}, s AS MATERIALIZED (SELECT DISTINCT manifest_id, site_id, side FROM ({sides}) WHERE site_id IS NOT NULL), w AS MATERIALIZED (SELECT i, {plain_words} AS w FROM r WHERE text IS NOT NULL AND site_id IN (SELECT site_id FROM s)),
            t AS MATERIALIZED (SELECT i, n, x, row_number() OVER (PARTITION BY i, x) AS k FROM (SELECT i, len(w) AS n, unnest(w) AS x FROM w)),
            q AS MATERIALIZED (SELECT a, b FROM (SELECT a.i AS a, b.i AS b, a.n AS m, b.n AS n, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.k = b.k AND a.i < b.i AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL) WHERE 5 * c >= 4 * (m + n - c)),
            o AS MATERIALIZED (SELECT DISTINCT x.manifest_id, q.a AS index_a, q.b AS index_b FROM q JOIN r y ON y.i = q.a JOIN r z ON z.i = q.b JOIN s x ON x.site_id = y.site_id JOIN s v ON v.site_id = z.site_id AND v.manifest_id = x.manifest_id AND v.side <> x.side)"""

    def windows(table: str, key: str) -> str:
        return rf"""(SELECT DISTINCT {key}, array_to_string(w[k:k + 11], ' ') AS x FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM (
            SELECT {key}, {plain_words} AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)))"""

    leak_sql = f"d AS MATERIALIZED {windows('documents', 'doc_id')}, e AS MATERIALIZED {windows('eval_items', 'item_id')}, p AS MATERIALIZED (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN e USING (x) GROUP BY ALL)"
    lists = " UNION ALL ".join(f"SELECT manifest_id, '{n}' AS list, unnest({n}) AS site_id FROM manifests" for n in splits.LISTS)
    return {
        "p1_counts": f"WITH {terms_sql} SELECT * FROM c",
        "p1_found": f"""WITH {terms_sql}, n AS (SELECT count(*) AS n FROM r) SELECT field_name, term, 'rare' AS mark FROM c WHERE CASE field_name WHEN 'text' THEN occurrences <= 2 ELSE records < 10 END
            UNION ALL SELECT field_name, term, 'common' FROM c, n WHERE CASE field_name WHEN 'text' THEN records > 0.5 * n ELSE records > 0.05 * n END""",
        "p2_members": f"""WITH {r}, f AS MATERIALIZED (SELECT i, {textform.fold_sql("text")} AS f FROM r WHERE text IS NOT NULL) SELECT i AS source_record_index, min(i) OVER (PARTITION BY f) AS class_index FROM f""",
        "p2_texts": f"""WITH {r} SELECT i AS source_record_index, {textform.fold_sql("text")} AS text FROM r""",
        "p4_found": f"WITH {lines_sql} SELECT site_id, line FROM f",
        "p4_texts": f"""WITH {lines_sql} SELECT r.i AS source_record_index, r.site_id, CASE WHEN r.text IS NOT NULL THEN coalesce(x.text, '') END AS text FROM r
            LEFT JOIN (SELECT i, string_agg(raw, chr(10) ORDER BY k) AS text FROM l LEFT JOIN (SELECT site_id AS s, line AS y FROM f) ON s = l.site_id AND y = l.line WHERE y IS NULL GROUP BY i) x ON x.i = r.i""",
        "p5_members": f"WITH {r} SELECT i AS source_record_index, min(i) OVER (PARTITION BY text) AS class_index FROM r WHERE text IS NOT NULL",
        "p5_found": f"WITH {overlap_sql} SELECT * FROM o",
        "p5_report": f"""WITH {overlap_sql} SELECT manifest_id, site_id, count(*) AS pairs, count(DISTINCT i) AS records FROM (SELECT manifest_id, unnest([index_a, index_b]) AS i FROM o) JOIN (SELECT i, min(site_id) AS site_id FROM r WHERE site_id IS NOT NULL GROUP BY 1) USING (i) GROUP BY ALL""",
        "p6_found": f"""WITH {forms_sql}, k AS MATERIALIZED (SELECT i, 'l' || letters AS f FROM m UNION ALL SELECT i, 'f' || fields FROM m WHERE fields IS NOT NULL) SELECT DISTINCT a.i AS index_a, b.i AS index_b FROM k a JOIN k b ON a.f = b.f AND a.i < b.i""",
        "p6_classes": f"WITH {classes_sql} SELECT min(i) AS source_record_index, count(*) AS copies FROM m JOIN g USING (letters) GROUP BY class",
        "p6_members": f"WITH {classes_sql} SELECT i AS source_record_index, min(i) OVER (PARTITION BY class) AS class_index FROM m JOIN g USING (letters)",
        "p9_found": f"WITH {leak_sql} SELECT doc_id, item_id FROM p",
        "p9_report": f"""WITH {leak_sql}, n AS (SELECT item_id, count(*) AS windows FROM e GROUP BY 1)
            SELECT item_id, count(*) AS documents, sum((shared = windows)::int)::bigint AS whole, max(round(shared::double / windows, 6)) AS most FROM p JOIN n USING (item_id) GROUP BY 1""",
        "p2_found": f"""WITH r AS (SELECT DISTINCT source_record_index AS i, text FROM stream_final_c4 WHERE source_record_index IS NOT NULL AND text IS NOT NULL),
            f AS MATERIALIZED (SELECT i, text AS t, {textform.fold_sql("text")} AS f FROM r)
            SELECT a.i AS index_a, b.i AS index_b FROM f a JOIN f b ON a.f = b.f AND a.i < b.i AND a.t <> b.t""",
        "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_found": rf"""WITH RECURSIVE k AS MATERIALIZED (SELECT DISTINCT site_id AS s, unnest(['o:' || {name("owner_name")}, 'c:' || {name("contact_id")},
                'h:' || nullif(regexp_extract(regexp_replace(lower(trim(host)), ':\d*$|\.+$', ''), '([^.\s]+\.[^.\s]+)$', 1), '')]) AS k FROM sites WHERE site_id IS NOT NULL),
            e AS MATERIALIZED (SELECT DISTINCT a.s AS a, b.s AS b FROM k a JOIN k b ON a.k = b.k WHERE a.k IS NOT NULL AND a.s <> b.s),
            c AS (SELECT a AS s, b AS t FROM e UNION SELECT c.s, e.b FROM c JOIN e ON c.t = e.a),
            p AS MATERIALIZED (SELECT DISTINCT manifest_id, list, site_id FROM ({lists}) WHERE site_id IS NOT NULL)
            SELECT DISTINCT x.manifest_id, x.site_id AS site_a, y.site_id AS site_b FROM p x JOIN p y ON x.manifest_id = y.manifest_id AND x.list <> y.list AND x.site_id < y.site_id
            JOIN c ON c.s = x.site_id AND c.t = y.site_id""",
    }

"""What the optimizer must make of the queries."""

import io
import re
from contextlib import redirect_stdout

import pytest

from veilmark import catalog


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(catalog.queries()["corpus_bounded_scan"](spark, small))
    assert "LessThan(source_record_index,1000)" in text
    # the row index is made by the reader, not stored
    assert [x.replace(",_tmp_metadata_row_index:bigint", "") for x in re.findall(r"ReadSchema: (.*)", text)] == ["struct<source_record_index:bigint>"]


@pytest.mark.parametrize("name, columns", [("raw_outcomes", {"source_record_index", "outcome"}), ("duplicate_result_keys", {"run_id", "site_id"}), ("class_scores", {"o_orderkey", "o_custkey"})])
def test_only_needed_columns_are_read(spark, small, name, columns):
    for schema in re.findall(r"ReadSchema: struct<(.*)>", plan(catalog.queries()[name](spark, small))):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


def test_site_cap_prunes_before_the_shuffle(spark, small):
    text = plan(catalog.queries()["corpus_site_cap"](spark, small))
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("name", ["corpus_first_occurrence", "corpus_dup_within_cross", "role_overlap_audit", "unit_counts_by_site", "l1_clip", "duplicate_result_keys"])
def test_no_cartesian_product(spark, small, name):
    assert "CartesianProduct" not in plan(catalog.queries()[name](spark, small))

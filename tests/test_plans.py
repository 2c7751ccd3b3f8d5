"""Builders and global ranks."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions.ranking import global_rank
from veilmark.operators import corpus, paillier, reporting
from veilmark.plans import build


def test_global_rank(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    assert [r.v for r in global_rank(df, "v").orderBy("rank").collect()] == sorted(values)
    assert sorted(r.rank for r in global_rank(df, F.desc("v")).collect()) == list(range(1, 501))
    assert global_rank(df.limit(0), "v").count() == 0


def test_final_corpus_rules(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(8))
    rows = [(k, f"s{k % 5}", text()) for k in range(60)] + [(100, "s0", "ALPHA  beta"), (101, "s9", None), (102, None, text())]
    rules = corpus.Validity(5, 500, 5, 0.5)
    df = spark.createDataFrame(rows, "idx bigint, site_id string, text string")
    for sequential in (False, True):
        got = build.final_corpus(df, rules, 3, 6, 4, 7, sequential).collect()
        by = {}
        for r in got:
            by.setdefault(r.site_id, []).append(r.idx)
        assert len(by) == 4 and all(3 <= len(x) <= 6 for x in by.values())
        assert len({r.norm_hash for r in got}) == len(got)


def test_manifest_is_a_partition(spark):
    rows = build.manifest(spark.createDataFrame([(f"s{k}",) for k in range(40)], "site_id string"), 3).collect()
    lists = [(r.role, r.site_id) for r in rows if r.role != "probe"]
    assert len(lists) == len({s for _, s in lists}) == 40
    assert sum(r == "target_member" for r, _ in lists) == 10 and sum(r.startswith("target") for r, _ in lists) == 20


@pytest.mark.parametrize("strict", [False, True])
def test_pilot_plans(strict):
    target, auxiliary = [f"t{k}" for k in range(8)], [f"a{k}" for k in range(8)]
    plans = build.pilot_plans(target, auxiliary, 8, 1, strict)
    for site in target:
        n = sum(site in p["training_site_ids"] for p in plans)
        assert n == 4 if strict else 0 < n < 8


def test_labelled_splits(spark):
    train = spark.createDataFrame([(k, k % 2, f"text {k}") for k in range(40)] + [(90, 0, "Same  one")], "id int, label int, text string")
    test = spark.createDataFrame([(200, 1, "same one"), (201, 0, "other")], "id int, label int, text string")
    rows = build.labelled_splits(train, test, 1).collect()
    assert len(rows) == 42 and {r.id: r.split for r in rows}[200] == "test" and 90 not in {r.id for r in rows}
    assert sum(r.split == "validation" for r in rows) in (3, 4)  # the copy may have been drawn


def test_search_plan_and_tasks(spark):
    base = {"k": "1024", "b": "32"}
    rows = build.search_plan(spark, {"sa_dp": {"k": ["512", "1024"]}, "plain": {"b": ["16"]}}, base).collect()
    assert len(rows) == 4 and "sa_dp__k-512__b-32" in {r.id for r in rows}
    a = spark.createDataFrame([("x", 0), ("y", 1)], "method_id string, pos int")
    assert build.downstream_tasks(a, spark.createDataFrame([("x", 5)], "method_id string, pos int"), [1, 2]).count() == 4


def test_benchmark_cell_and_tables(spark):
    cell = paillier.benchmark_cell(spark, 2, 4, 2, paillier.generate_keys(1024))
    assert cell["chosen"] == 2 and cell["upload_bytes"] == 2 * 4 * 256
    df = spark.createDataFrame([("a_b", 1.0, 0.4, 10.0), ("plain", 2.0, 0.7, 5.0), ("bad", 3.0, 0.9, 50.0)], "method_id string, token_count double, roc_auc double, seconds double")
    assert r"a\_b & 1.0" in reporting.latex_table(df, ["method_id"])
    assert {r.method_id for r in reporting.pareto_costs(df, "method_id", "plain", "seconds", "roc_auc").collect()} == {"a_b", "plain"}
    assert reporting.shortlist_inputs(df, df).where("method_id = 'a_b'").first()["token_increase"] == -0.5
    results = spark.createDataFrame([("m", 0.5, False), ("m", 0.7, False)], "method_id string, best_validation_macro_f1 double, test_used_for_model_selection boolean")
    assert reporting.validation_means(results).first()["macro_f1"] == pytest.approx(0.6)
    with pytest.raises(Exception, match="test set"):
        reporting.validation_means(results.withColumn("test_used_for_model_selection", F.lit(True))).collect()

"""Documents, gates, measured matrices, summaries and views."""

import time

import pytest

from veilmark import session
from veilmark.operators import artifacts, reporting


def test_hashed_documents():
    a = artifacts.hashed({"b": 1, "a": [2]})
    assert artifacts.hashed(a) == a and artifacts.hashed({"a": [2], "b": 2})["manifest_sha256"] != a["manifest_sha256"]
    assert artifacts.utc_now().endswith("+00:00")


def test_resource_gates():
    now = time.perf_counter()
    assert artifacts.check_resources(now, 60, 1 << 50, 0)["free"] > 0
    for limits, error in (((0, 1 << 50, 0), TimeoutError), ((60, 1, 0), MemoryError), ((60, 1 << 50, 1 << 60), OSError)):
        with pytest.raises(error):
            artifacts.check_resources(now - 1, *limits)


def test_benchmark_matrix_resumes(tmp_path):
    calls = []

    def run(clients, k, seed):
        calls.append((clients, k, seed))
        if len(calls) == 5:
            raise RuntimeError("stopped")
        return {"total": float(seed)}

    state = str(tmp_path / "state.json")
    with pytest.raises(RuntimeError):
        artifacts.benchmark_matrix(run, [2, 4], [8], 1, 2, state)
    rows = artifacts.benchmark_matrix(run, [2, 4], [8], 1, 2, state)
    assert [(r["clients"], r["repetition"], r["total"]) for r in rows] == [(2, 0, 1.0), (2, 1, 2.0), (4, 0, 1001.0), (4, 1, 1002.0)] and calls[5:] == [(4, 8, 1000), (4, 8, 1001), (4, 8, 1002)]
    with pytest.raises(ValueError):
        artifacts.benchmark_matrix(run, [2], [8], 1, 2, state)


def test_incomplete_cells_show(spark):
    rounds = spark.createDataFrame([(2, 8, 0, 1.0), (2, 8, 1, 3.0), (4, 8, 0, 1.0), (4, 8, 0, 1.0)], "clients int, k int, repetition int, total double")
    expected = spark.createDataFrame([(2, 8), (4, 8), (8, 8)], "clients int, k int")
    got = {r.clients: (r.repetitions, r.complete) for r in artifacts.benchmark_summary(rounds, expected, 2, ()).collect()}
    assert got == {2: (2, True), 4: (2, False), 8: (0, False)}


def test_pilot_summary_names_what_is_missing(spark):
    runs = spark.createDataFrame([("a", 0.5), ("x", 0.7)], "k string, roc_auc double")
    bounds = spark.createDataFrame([("a", "roc_auc", 0.4, 0.6)], "k string, metric string, lower double, upper double")
    expected = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: (r.state, r.roc_auc_lower) for r in artifacts.pilot_summary(runs, bounds, expected, ["k"], ("roc_auc",)).collect()}
    assert got == {"a": ("ok", 0.4), "b": ("missing", None), "x": ("unexpected", None)}


def test_audits_count_what_is_planted(spark):
    rows = [(1, "s", "one", "d1", "n1"), (2, "s", "one", "d1", "n1"), (3, "t", "One", "d2", "n1"), (4, "t", "see www.x.y", "d3", "n3"), (5, "u", " ", "d4", "n4"), (6, "u", "of u", "d5", "n5")]
    df = spark.createDataFrame(rows, "idx bigint, site_id string, text string, digest string, norm string")
    got = {r.check: r.n for r in artifacts.retained_audit(df).collect()}
    assert got == {"empty": 1, "url_in_text": 1, "site_id_in_text": 1, "digest_copy_within": 1, "digest_copy_across": 0, "norm_copy_within": 1, "norm_copy_across": 1}
    assert {r.n for r in artifacts.retained_audit(df.limit(0)).collect()} == {0}
    roles = spark.createDataFrame([(1, r, s) for s, own in {"a": "target_pool target_member", "b": "target_pool target_member target_nonmember", "c": "target_pool shadow_auxiliary", "d": "target_member"}.items() for r in own.split()], "manifest_id bigint, role string, site_id string")
    plans = spark.createDataFrame([(1, 0, "training", "a"), (1, 0, "target_probe", "a"), (1, 0, "training", "z"), (1, 0, "auxiliary", "c")], "manifest_id bigint, shadow_id int, kind string, site_id string")
    got = {r.check: r.n for r in artifacts.manifest_audit(roles, plans).collect()}
    assert got == {"member_and_nonmember": 1, "pool_in_neither": 1, "split_outside_pool": 1, "target_and_auxiliary": 1, "target_and_public": 0, "auxiliary_and_public": 0, "training_mismatch": 2}


def test_patience_ends_a_training(spark):
    df = spark.createDataFrame([("r", e, f) for e, f in enumerate((0.1, 0.3, 0.2, 0.3, 0.9), 1)], "run string, epoch int, f1 double")
    assert [r.epoch for r in reporting.best_so_far(df, "run", "epoch", "f1", 2).orderBy("epoch").collect()] == [1, 2, 3, 4]
    assert reporting.best_so_far(df, "run", "epoch", "f1", 3).count() == 5


def test_one_copy_keeps_rows_whole(spark, tmp_path, monkeypatch):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "z"), (3, None), (1, "a")]
    spark.createDataFrame(rows, "k bigint, v string").repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    for bound in (1000, 0):
        monkeypatch.setattr(session, "BROADCAST_ROWS", bound)
        assert sorted(map(tuple, session.one_copy(spark, str(tmp_path), "t", "k", "v").collect()), key=str) == [(1, "a"), (2, "b"), (3, None)]


def test_no_text_is_shuffled_to_drop_repeated_rows(spark, small, monkeypatch):
    from test_physical_plans import plan

    from veilmark import catalog

    monkeypatch.setattr(session, "spread", lambda df, used: df)  # this scan is one split
    text = plan(catalog.queries()["corpus_reason_histogram"](spark, small))
    for part in text.split("\n\n"):
        if ") Exchange" in part and "Broadcast" not in part:
            assert "text#" not in part


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://x"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))})

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpointed(type("D", (), {"sparkSession": Session})())

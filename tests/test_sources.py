"""Sources, sinks, plans and streams."""

import json

import pytest
from pyspark.sql import functions as F

from veilmark.plans import matrix
from veilmark.sources import tables
from veilmark.streaming import events


def test_jsonl_is_strict(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"site_id": "a", "text": "x"}\n\n   \n{"site_id": "b", "text": null}\n')
    assert sorted(r.site_id for r in tables.jsonl(spark, str(good)).collect()) == ["a", "b"]
    sites = spark.createDataFrame([("a",), ("a",)], "site_id string")
    assert tables.site_texts(spark, str(good), sites).count() == 1
    for bad in ('{"site_id": ', '{"ascii_letter_ratio": NaN}'):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|Malformed"):
            tables.jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_csv_and_json_tree(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿a,b\n1,x\n".encode())
    assert tables.csv(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "r" / "deep").mkdir(parents=True)
    (tmp_path / "r" / "one.json").write_text(json.dumps({"n": 1}, indent=2))
    (tmp_path / "r" / "deep" / "two.json").write_text('{"n": 2}')
    rows = tables.json_tree(spark, str(tmp_path / "r"), "n int").collect()
    assert sorted(r.n for r in rows) == [1, 2] and all(r.file_path.endswith(".json") for r in rows)


def test_nothing_is_overwritten(spark, tmp_path):
    df = spark.range(3)
    tables.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        tables.write_new(df, str(tmp_path / "out"))
    tables.write_csv(df, str(tmp_path / "csv"))
    with pytest.raises(ValueError):
        tables.write_csv(df.limit(0), str(tmp_path / "none"))
    path = tmp_path / "m.json"
    tables.publish_json(path, {"b": 1, "a": [2]})
    assert path.read_text() == '{"a":[2],"b":1}'
    with pytest.raises(FileExistsError):
        tables.publish_json(path, {})
    tables.replace_json(path, {"a": 3})
    assert tables.load_json(path) == {"a": 3}
    path.write_text('{"a": NaN}')
    with pytest.raises(ValueError):
        tables.load_json(path)
    with pytest.raises(ValueError):
        tables.canonical_json({"a": float("inf")})


def test_encoded_lengths(spark):
    df = spark.createDataFrame([([1, 2], 0), ([1], 1)], "ids array<int>, label int")
    assert tables.encoded_dataset(df.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="another length"):
        tables.encoded_dataset(df, 2).collect()
    assert tables.bounded(spark.range(9).withColumnRenamed("id", "source_record_index"), 4).count() == 4


def test_matrix_size(spark):
    assert matrix.attack_tasks(spark, [1, 2, 3], [4000, 8000], ["a", "b"]).distinct().count() == 60


def test_stream_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.stream_of(spark, str(tmp_path / "in"), batch.schema)
    counted = events.windowed_counts(events.once(stream, ["event_id"], "ts", "60 days"), "ts", "event_type", "value", late=None)
    run = counted.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    expected = {tuple(r) for r in events.windowed_counts(batch, "ts", "event_type", "value").select("start", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("windows").select("start", "event_type", "n").collect()} == expected
    assert events.windowed_counts(batch, "ts", "event_type", "value", "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_micro_corpus_repeats(spark):
    from veilmark.sources.synthetic import micro_corpus

    a, b = (micro_corpus(spark, seed=3).orderBy("idx").collect() for _ in range(2))
    assert a == b and len(a) == 96 and len({r.site_id for r in a}) == 8
    assert any("own000x" in r.text for r in a if r.site_id == "site_000")

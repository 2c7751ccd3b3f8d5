"""Sources and sinks: strict JSON lines, CSV, JSON trees, exclusive publishing."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "site_id string, text_sha256 string, normalized_text_sha256 string, url_sha256 string, source_record_index bigint, char_count bigint, byte_count bigint, ascii_letter_ratio double, text string"


def jsonl(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, malformed ones and NaN or Infinity are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}).alias("r"))
    return parsed.select("r.*")


def site_texts(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """The records of listed sites."""
    return jsonl(spark, path).join(sites.select("site_id").distinct(), "site_id", "left_semi")


def bounded(df: DataFrame, limit: int, index: str = "source_record_index") -> DataFrame:
    """Records before a position of the stream; a pushed-down filter on the stored index, never an unordered limit."""
    return df.where(F.col(index) < limit)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header first; a byte-order mark is no part of the first name. Without a schema every column is a string."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def json_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All *.json files under a folder, one file one row, with ``file_path``."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def encoded_dataset(df: DataFrame, length: int) -> DataFrame:
    """(ids, label) with every list of the one length; others are an error."""
    checked = F.when(F.size("ids") == length, F.col("ids")).otherwise(F.raise_error("ids of another length"))
    return df.select(checked.alias("ids"), "label")


def write_new(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Publishes a table; one that exists is never overwritten."""
    writer = df.write.format(fmt).mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report table as one CSV part with a header; an empty one is refused."""
    if df.limit(1).count() == 0:
        raise ValueError("refusing to write an empty table")
    df.coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def canonical_json(value: object) -> str:
    """Sorted keys, compact, no NaN or Infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def publish_json(path: str | Path, value: object) -> None:
    """Metadata, written aside, synced and linked into place; an existing file is an error and stays."""
    path = Path(path)
    partial = path.with_name(path.name + ".partial")
    with open(partial, "x", encoding="utf-8") as f:
        f.write(canonical_json(value))
        f.flush()
        os.fsync(f.fileno())
    os.link(partial, path)
    partial.unlink()


def replace_json(path: str | Path, value: object) -> None:
    """A state file, replaced atomically."""
    path = Path(path)
    aside = path.with_name(f"{path.name}.{os.getpid()}")
    aside.write_text(canonical_json(value), encoding="utf-8")
    os.replace(aside, path)


def load_json(path: str | Path) -> object:
    def refuse(token: str) -> None:
        raise ValueError(f"{token} in JSON")

    return json.loads(Path(path).read_text(encoding="utf-8"), parse_constant=refuse)

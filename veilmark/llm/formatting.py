"""Problem 6: records that differ only in white space, letter case, punctuation or field order.

Method: collapse byte-identical rows first, with counts; bring only the distinct survivors to canonical form; group again
on the full canonical text and sum the counts. A task collapses byte-identical texts before it canonicalises them, and
what leaves the task are SHA-256 digests of whole texts and whole canonical texts: no text is shuffled, and the rest of
the collapsing and grouping moves about a hundred bytes a record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import class_pairs, digest, records
from veilmark.llm.splits import components
from veilmark.llm.textform import caseless, letters
from veilmark.session import checkpointed

#: Distinct texts whose forms a task remembers at a time.
KNOWN_TEXTS = 100_000

_PARTS = re.compile(r"[\n|;]")
_FIELD = re.compile(r"\W*\w[^:.!?\n]{0,40}?\s*:\s*\S")


def canonical(text: str) -> str:
    """Letters and digits in order, without case."""
    return letters(caseless(text))


def canonical_fields(text: str) -> str | None:
    """For a text of labelled fields its fields in sorted order, else null."""
    if ":" not in text and "：" not in text:
        return None
    parts = [p for p in _PARTS.split(caseless(text)) if p.strip()]
    if len(parts) < 2 or not all(map(_FIELD.match, parts)):
        return None
    return "\n".join(sorted(map(letters, parts)))


def canonical_members(df: DataFrame) -> DataFrame:
    """(source_record_index, variant, letters, fields), distinct: digests of a record's text, of its letters and digits
    in order, and of its sorted fields (null where it has none). Null texts and rows without an index are left out.
    """
    schema = pa.schema([("source_record_index", pa.int64()), ("variant", pa.binary()), ("letters", pa.binary()), ("fields", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[bytes, bytes | None]] = {}
        for batch in batches:
            out = []
            for text, variant in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (form := known.get(variant)) is None:
                    if len(known) >= KNOWN_TEXTS:
                        known.clear()
                    fields = canonical_fields(text)
                    form = known[variant] = (hashlib.sha256(canonical(text).encode()).digest(), None if fields is None else hashlib.sha256(fields.encode()).digest())
                out.append(form)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f[k] for f in out], pa.binary()) for k in (0, 1))], schema=schema)

    rows = df.where("source_record_index IS NOT NULL AND text IS NOT NULL").select("source_record_index", "text", digest("text").alias("variant"))
    return rows.mapInArrow(run, "source_record_index bigint, variant binary, letters binary, fields binary").distinct()


def format_classes(df: DataFrame) -> DataFrame:
    """(class, variant, source_record_index) under both forms of each text; a record can stand in two classes."""
    keys = F.explode(F.array(F.concat(F.lit(b"l"), "letters"), F.concat(F.lit(b"f"), "fields"))).alias("class")
    return canonical_members(df).select(keys, "variant", "source_record_index").where("class IS NOT NULL")


def united(members: DataFrame) -> DataFrame:
    """members with ``class``: one class for all texts linked through equal letters or equal fields, directly or through
    other texts. members: letters, fields, more columns. Only fields that differ in their letters are linked by rounds."""
    pairs = members.where("fields IS NOT NULL").select(F.hex("letters").alias("site_id"), F.hex("fields").alias("key")).distinct()
    shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    parts = components(pairs.join(shared, "key")).select(F.unhex("site_id").alias("letters"), F.unhex("component").alias("component"))
    return members.join(parts, "letters", "left").withColumn("class", F.coalesce("component", "letters")).drop("component")


def collapsed(df: DataFrame) -> DataFrame:
    """One record of each formatting class with its number of copies: (source_record_index, copies).

    Null texts and rows without an index are left out; texts without letters and digits are one class (their canonical text is empty).
    """
    once = canonical_members(df).groupBy("variant").agg(F.count("*").alias("n"), F.min("source_record_index").alias("rep"), F.first("letters").alias("letters"), F.first("fields").alias("fields"))
    return united(checkpointed(once)).groupBy("class").agg(F.min("rep").alias("source_record_index"), F.sum("n").alias("copies")).drop("class")


def format_members(df: DataFrame) -> DataFrame:
    """(source_record_index, class_index): every record with a text and the smallest record of its formatting class."""
    members = united(checkpointed(canonical_members(df)))
    smallest = members.groupBy("class").agg(F.min("source_record_index").alias("class_index"))
    return members.join(smallest, "class").select("source_record_index", "class_index")


def same_but_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """p6_found: pairs of records equal but for formatting; equal texts are a case."""
    return class_pairs(checkpointed(format_classes(records(spark, folder, "text")))).distinct()


def copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    """p6_classes: one record of each class with its number of copies."""
    return collapsed(records(spark, folder, "text"))


def class_members(spark: SparkSession, folder: str) -> DataFrame:
    """p6_members: every record with the smallest record of its class."""
    return format_members(records(spark, folder, "text"))

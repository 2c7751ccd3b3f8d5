"""Problem 2: texts a reader sees as the same, stored with different characters.

Method: DuckDB runs inside the Arrow partitions; the mapping of compatibility forms, invisible characters and
look-alikes is one embedded SQL expression with nfc_normalize, translate and regular expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import class_pairs, digest, records, whole_records
from veilmark.llm.textform import fold_sql
from veilmark.session import checkpointed


def _folded(df: DataFrame) -> DataFrame:
    """df with ``text`` in its consistent form; other columns stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        columns = ", ".join(f"{fold_sql('text')} AS text" if n == "text" else f'"{n}"' for n in schema.names)
        for batch in batches:
            con.register("rows", pa.Table.from_batches([batch]))
            yield from con.sql(f"SELECT {columns} FROM rows").to_arrow_table().cast(schema).to_batches()
            con.unregister("rows")

    return df.mapInArrow(run, df.schema)


def consistent_form(df: DataFrame) -> DataFrame:
    """(source_record_index, text) with every text in its consistent form.

    Null stays null and empty stays empty; each input row gives one row. Texts that look the same come out equal.
    """
    return _folded(df.select("source_record_index", "text"))


def looks(df: DataFrame) -> DataFrame:
    """(class, variant, source_record_index), distinct: digests of the consistent form and of the stored text; null texts
    left out. What leaves a task are the digests, not the texts."""
    rows = df.where("source_record_index IS NOT NULL AND text IS NOT NULL").select("source_record_index", digest("text").alias("variant"), "text")
    plain = F.length("text") == F.octet_length("text")  # ASCII is its own form and needs no Python
    own = rows.where(plain).select(F.col("variant").alias("class"), "variant", "source_record_index")
    folded = _folded(rows.where(~plain)).select(digest("text").alias("class"), "variant", "source_record_index")
    return own.unionByName(folded).distinct()


def same_look(spark: SparkSession, folder: str) -> DataFrame:
    """p2_found: pairs of records whose texts are different strings but look the same."""
    return class_pairs(checkpointed(looks(records(spark, folder, "text"))), differ=True)


def look_members(spark: SparkSession, folder: str) -> DataFrame:
    """p2_members: (source_record_index, class_index): every record with a text and the smallest record that looks the same."""
    members = checkpointed(looks(records(spark, folder, "text")))
    smallest = members.groupBy("class").agg(F.min("source_record_index").alias("class_index"))
    return members.join(smallest, "class").select("source_record_index", "class_index")


def consistent_texts(spark: SparkSession, folder: str) -> DataFrame:
    """p2_texts: every record's text in its consistent form."""
    return consistent_form(whole_records(spark, folder, "text"))

"""What several of the operators need: record tables, Arrow helpers, pairs inside classes of equal records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.session import one_copy, table

#: Identical texts of up to so many records give every pair; of more identical ones, the first record stands in the pairs
#: and each other is linked to it or to another record of its class, from which all pairs follow. Different texts of a
#: class give every pair, whatever its size. Keeps the output linear when one group of copies holds a third of all rows.
ALL_PAIRS_UP_TO = 2000


def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Rows of stream_final_c4 with a record index; a record repeated as identical rows is still repeated here."""
    return table(spark, folder, "stream_final_c4").select("source_record_index", *columns).where("source_record_index IS NOT NULL")


def whole_records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row a record; the texts are not shuffled for it."""
    return one_copy(spark, folder, "stream_final_c4", "source_record_index", *columns)


def digest(column: Column | str) -> Column:
    """SHA-256 as 32 bytes; stands for the text in joins."""
    return F.unhex(F.sha2(F.col(column) if isinstance(column, str) else column, 256))


def map_columns(df: DataFrame, function: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with whole batches as Python lists: ``function(**columns)`` returns the output columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(**{n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, row) of all rows of all intervals."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner]


def class_pairs(members: DataFrame, differ: bool = False, limit: int = ALL_PAIRS_UP_TO) -> DataFrame:
    """Pairs (index_a < index_b) of records in the same class.

    members: class, variant, source_record_index, distinct. differ: only pairs of different variants.
    Of a variant of more than ``limit`` records (exact copies) the first stands in the pairs; each other is linked to the
    smallest record of the class (with differ, and if that is its own copy, to the smallest of another variant).
    """
    copies = members.groupBy("class", "variant").agg(F.count("*").alias("c"), F.min("source_record_index").alias("first"))
    sizes = copies.groupBy("class").agg(
        F.sum("c").alias("n"), F.min("variant").alias("v0"), F.max("variant").alias("v1"), F.min("first").alias("rep"), F.min_by("variant", "first").alias("rep_variant"),
        F.collect_list(F.when(F.col("c") > limit, F.struct("variant", "first"))).alias("large"),
    )
    sizes = sizes.where("n > 1 AND v0 <> v1" if differ else "n > 1")
    rows = members.join(sizes, "class")
    copy = F.exists("large", lambda x: (x["variant"] == F.col("variant")) & (x["first"] != F.col("source_record_index")))
    small = rows.where(~copy).withColumn("blocks", F.ceil(F.col("n") / limit).cast("int"))
    # the records of a large class meet in blocks
    a = small.select("class", F.col("variant").alias("va"), F.col("source_record_index").alias("index_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = small.select("class", F.col("variant").alias("vb"), F.col("source_record_index").alias("index_b"), F.pmod(F.xxhash64("source_record_index"), "blocks").cast("int").alias("block"))
    on = (a["class"] == b["class"]) & (a["block"] == b["block"]) & (F.col("index_a") < F.col("index_b"))
    pairs = a.join(b, on & (F.col("va") != F.col("vb")) if differ else on).select("index_a", "index_b")
    big = rows.where(copy)
    star = big.where("variant <> rep_variant" if differ else "true").select(F.col("rep").alias("x"), F.col("source_record_index").alias("y"))
    if differ:
        fellows = big.where("variant = rep_variant")
        other = rows.where("size(large) > 0 AND variant <> rep_variant").groupBy("class").agg(F.min("source_record_index").alias("other"))
        star = star.unionByName(fellows.join(other, "class").select(F.col("other").alias("x"), F.col("source_record_index").alias("y")))
    return pairs.unionByName(star.select(F.least("x", "y").alias("index_a"), F.greatest("x", "y").alias("index_b")))

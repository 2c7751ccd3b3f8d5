"""A small deterministic corpus for smoke runs; made by expressions, so it scales to any size without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def micro_corpus(spark: SparkSession, sites: int = 8, texts: int = 12, words: int = 24, seed: int = 0) -> DataFrame:
    """(idx, site_id, text): every site has words of its own among common ones."""
    rows = spark.range(sites * texts).select(F.col("id").alias("idx"), F.format_string("site_%03d", F.col("id") % sites).alias("site_id"))

    def word(k):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col("idx"), k), F.lit(40))
        return F.when(draw < 8, F.concat(F.lit("own"), F.substring("site_id", 6, 3), F.lit("x"), draw.cast("string"))).otherwise(F.concat(F.lit("word"), draw.cast("string")))

    return rows.select("idx", "site_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ").alias("text"))

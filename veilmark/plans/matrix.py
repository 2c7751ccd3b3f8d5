"""Task matrices as tables: what is run is data, so completeness is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACKS = ("compression_rate", "vocabulary_overlap", "merge_similarity", "frequency_estimation", "naive_bayes")  # fixed values


def product(spark: SparkSession, **dimensions: list) -> DataFrame:
    """Every combination of small lists, one column a dimension."""
    row = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in dimensions.items()])
    for name in dimensions:
        row = row.withColumn(name, F.explode(name))
    return row


def configuration_id(mode: Column, *values: tuple[str, Column]) -> Column:
    """``mode__name-value__...`` with dots as ``p``."""
    return F.concat_ws("__", mode, *[F.concat(F.lit(f"{n}-"), F.replace(v.cast("string"), F.lit("."), F.lit("p"))) for n, v in values])


def attack_tasks(spark: SparkSession, seeds: list[int], sizes: list[int], methods: list[str]) -> DataFrame:
    """(seed, vocab_size, method_id, attack) of an experiment."""
    return product(spark, seed=seeds, vocab_size=sizes, method_id=methods, attack=list(ATTACKS))


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """Keys in the order of their first place."""
    return df.groupBy(key).agg(F.min(position).alias(position))

"""Text classifier for downstream utility: hashed n-grams of token ids and multinomial logistic regression.

A declared substitute for a neural classifier (no such library here); split, early stopping on validation macro-F1 and
the metrics keep their meaning.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.reporting import macro_scores


def features(df: DataFrame, tokens: str, size: int = 1 << 14) -> DataFrame:
    pairs = NGram(n=2, inputCol=tokens, outputCol="_pairs").transform(df)
    both = pairs.withColumn("_grams", F.concat(F.col(tokens), F.col("_pairs")))
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=size).transform(both).drop("_pairs", "_grams")


def trained(train: DataFrame, validation: DataFrame, strengths: tuple[float, ...] = (0.001, 0.01, 0.1), iterations: int = 30):
    """(model, validation macro-F1) of the best regularisation; a later one wins only by strict improvement."""
    best, score = None, -1.0
    for r in strengths:
        model = LogisticRegression(maxIter=iterations, regParam=r, labelCol="label", featuresCol="features").fit(train)
        now = macro_scores(model.transform(validation)).first()["macro_f1"] or 0.0  # an empty validation split scores nothing
        if now > score:
            best, score = model, now
    return best, score

"""Calibrated fraud probabilities: boosted trees and isotonic regression per fold, averaged."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.expressions import ranked
from riskgraph.functions.params import Model
from riskgraph.operators import trees
from riskgraph.operators.features import FEATURES


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with ``train``: the first ``share`` of each class by a seeded hash of the key. Keys are dealt to 4096 ranges of the hash, so no task ranks a whole class."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    placed = ranked(df, F.shiftright(h, 52), [h, key], [label])
    return placed.withColumn("train", F.col("__rank") < F.lit(share) * F.greatest(F.col("__n") - 1, F.lit(1))).select(*df.columns, "train")


def folds(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n)).cast("int"))


class FraudModel:
    """Trees and calibrators, one pair per fold."""

    def __init__(self, pairs, p: Model):
        self.pairs, self.p = pairs, p

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``: the folds' mean to four decimals; missing features are 0."""
        out = df.withColumn("_p", trees.probabilities([boosted for boosted, _ in self.pairs], _given()))
        columns = []
        for i, (_, calibrator) in enumerate(self.pairs):
            out = calibrator.setFeaturesCol(f"_s{i}").setPredictionCol(f"_c{i}").transform(out.withColumn(f"_s{i}", F.col("_p")[i]))
            columns.append(F.col(f"_c{i}"))
        mean = sum(columns[1:], columns[0]) / len(columns)
        return out.withColumn("probability", F.round(mean, 4)).select(*df.columns, "probability")


def _given() -> list:
    """The features as doubles, 0 where they are missing."""
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in FEATURES]


def train(df: DataFrame, key: str, label: str = "y", p: Model = Model()) -> FraudModel:
    """Each fold's trees are fitted on the other folds and calibrated on the fold itself.

    Every level of a round's trees is one job for all folds over cached blocks of about ``p.rows_per_task`` rows, or larger ones where these
    would be more than a few for each core.
    """
    spark = df.sparkSession
    parts = max(1, min(-(-df.count() // p.rows_per_task), trees.WAVES * spark.sparkContext.defaultParallelism))
    given = [c.alias(name) for name, c in zip(FEATURES, _given())]
    rows = folds(df, key, p.folds, p.seed).select(key, label, "fold", *given).repartition(parts, key).sortWithinPartitions(key).cache()
    models = trees.boost(rows, list(FEATURES), label, "fold", p.folds, p.depth, p.rounds, p.step, p.min_leaf)

    def fit(i: int):
        held = rows.where(F.col("fold") == i).select(label, trees.probabilities([models[i]], list(FEATURES))[0].alias("_s"))
        return models[i], IsotonicRegression(featuresCol="_s", labelCol=label, predictionCol="_c").fit(held)

    with ThreadPool(p.folds) as pool:
        pairs = pool.map(inheritable_thread_target(spark)(fit), range(p.folds))
    rows.unpersist()
    return FraudModel(pairs, p)

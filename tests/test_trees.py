"""Boosted trees over blocks: those of Spark's classifier, several training sets at once, and what comes back of a block."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from riskgraph.operators import trees

NAMES = ["a", "b", "c", "d"]


def table(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 40, n) / 4, rng.integers(0, 2, n).astype(float)
    y = ((a + b / 5 + c * np.sin(3 * a) + rng.normal(size=n) / 2) > 1.2).astype(int)
    rows = [(int(i), *map(float, r), int(v), int(i) % 3) for i, (*r, v) in enumerate(zip(a, b, c, np.zeros(n), y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, fold int")


@pytest.mark.parametrize("parts", [1, 4])
def test_each_set_has_the_trees_of_sparks_classifier(spark, parts):
    """All rows are of fold 2, so the first two sets have all of them: limits come from the rows of all folds, Spark's from those of its set."""
    rows = table(spark).selectExpr("id", *NAMES, "y", "2 AS fold").repartition(parts, "id").cache()
    models = trees.boost(rows, NAMES, "y", "fold", 3, 3, 12, 0.1, 20)
    x = VectorAssembler(inputCols=NAMES, outputCol="x").transform(rows)
    spark_trees = GBTClassifier(featuresCol="x", labelCol="y", maxDepth=3, maxIter=12, stepSize=0.1, minInstancesPerNode=20).fit(x)
    got = spark_trees.transform(x).select(vector_to_array("probability")[1].alias("p"), trees.probabilities(models[:2], NAMES).alias("q")).toPandas()
    q = np.stack(got.q.to_list())
    assert np.abs(q - got.p.to_numpy()[:, None]).max() < 1e-9 and got.p.std() > 0.1


def test_a_set_leaves_its_fold_out(spark):
    df = table(spark)
    models = trees.boost(df, NAMES, "y", "fold", 3, 3, 11, 0.1, 20)
    changed = df.selectExpr("id", *NAMES, "CASE WHEN fold = 1 THEN 1 - y ELSE y END AS y", "fold")
    others = trees.boost(changed, NAMES, "y", "fold", 3, 3, 11, 0.1, 20)
    same = [all(np.array_equal(p, q) for s, t in zip(m.trees, o.trees) for p, q in zip(s, t)) for m, o in zip(models, others)]
    assert same == [False, True, False] and all(len(m.trees) == 11 for m in models)


def test_what_a_task_sends_does_not_grow_with_its_rows():
    rng = np.random.default_rng(1)
    sizes = set()
    for n in (50, 50_000):
        y = rng.choice([-1.0, 1.0], n)
        block = {"bins": rng.integers(0, 32, (4, n)).astype(np.uint8), "y": y, "parts": [(0, n // 2), (n // 2, n)], "margin": np.zeros((2, n)), "rounds": 0}
        found = trees._sums(block, [(None, None)] * 2, 0, [[0], [0]])
        assert found[0, 0, 0].sum(1).tolist() == [n - n // 2] * 4 and np.allclose(found[1, 1, 0].sum(1), y[: n // 2].sum())
        sizes.add(found.nbytes)
        assert max(len(v) for v, _ in trees._values([rng.normal(size=n)])) <= trees.HELD + 1
    assert len(sizes) == 1


def test_thinned_values_keep_extremes_counts_and_shares():
    x = np.random.default_rng(2).normal(size=30_000)
    (v, n), = trees._values([x])
    assert n.sum() == len(x) and v[0] == x.min() and v[-1] == x.max() and len(v) <= trees.HELD + 1
    limits = trees._limits([(v, n)])
    shares = np.diff(np.searchsorted(np.sort(x), limits), prepend=0) / len(x)
    assert len(limits) == 31 and np.abs(shares - 1 / 32).max() < 0.002

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import boosting


def test_expression_equals_the_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (400, 5)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 3] > 6)).astype(float)
    trees = boosting.fit(x, y, trees=12, depth=3)
    want = boosting.predict(trees, x)
    assert ((want > 0) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, f array<double>")
    got = {r.i: r.s for r in df.select("i", boosting.expression(trees, F.col("f")).alias("s")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)
    assert boosting.threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 1]), 0.99) == 1.5
    assert boosting.threshold(np.array([3.0]), np.array([0]), 0.5) == float("inf")

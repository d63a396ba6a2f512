import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.distance import FARTHEST, distance, distance_to, distances
from vecloom.types import Metric

INF, NAN = float("inf"), float("nan")
CASES = [
    (Metric.COSINE, [1, 0, 0, 0], [1, 0, 0, 0], 0), (Metric.COSINE, [1, 0, 0, 0], [0, 1, 0, 0], 1), (Metric.COSINE, [1, 0, 0, 0], [-1, 0, 0, 0], 2),
    (Metric.COSINE, [0, 0], [1, 2], 1), (Metric.COSINE, [0, 0], [0, 0], 1), (Metric.COSINE, [NAN, 1], [1, 1], 2), (Metric.COSINE, [INF, 1], [1, 1], 2), (Metric.COSINE, [-INF, 1], [1, 1], 2),
    (Metric.COSINE, [1, 2, 3], [2, 4, 6], 0), (Metric.EUCLIDEAN, [0, 0], [3, 4], 5), (Metric.EUCLIDEAN, [1, 2], [1, 2], 0), (Metric.EUCLIDEAN, [NAN, 0], [0, 0], FARTHEST),
    (Metric.EUCLIDEAN, [INF, 0], [0, 0], FARTHEST), (Metric.EUCLIDEAN, [3e38, 3e38], [-3e38, 0], FARTHEST), (Metric.DOT, [1, 2, 3], [4, 5, 6], -32), (Metric.DOT, [1, 0], [0, 1], 0),
    (Metric.DOT, [NAN, 1], [1, 1], FARTHEST), (Metric.DOT, [INF, 1], [1, 1], FARTHEST), (Metric.DOT, [1, -1], [1, 1], 0),
]


def test_goldens(spark):
    rows = [(i, [float(x) for x in a], [float(x) for x in b]) for i, (_, a, b, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    for metric in Metric:
        for r in df.withColumn("d", distance(metric, F.col("a"), F.col("b"))).collect():
            if CASES[r.i][0] is metric:
                assert math.isclose(r.d, CASES[r.i][3], abs_tol=1e-3), CASES[r.i]


@pytest.mark.parametrize("case", [0, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 16, 17])
def test_to_one_vector(spark, case):
    metric, a, b, want = CASES[case]
    for x, y in ((a, b), (b, a)):
        got = spark.createDataFrame([([float(v) for v in x],)], "a array<float>").select(distance_to(metric, F.col("a"), y)).first()[0]
        assert math.isclose(got, want, abs_tol=1e-3)


def test_matrices_agree():
    for metric, a, b, want in CASES:
        got = distances(metric, np.array([a], np.float32).astype(float), np.array([b], np.float32).astype(float))[0, 0]
        assert math.isclose(got, want, abs_tol=1e-3), (metric, a, b)


@pytest.mark.parametrize("metric", list(Metric))
def test_empty_and_unequal(spark, metric):
    df = spark.createDataFrame([([], [])], "a array<float>, b array<float>")
    assert df.select(distance(metric, F.col("a"), F.col("b"))).first()[0] == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], df.schema).select(distance(metric, F.col("a"), F.col("b"))).collect()


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        distance("cosine", F.lit(1), F.lit(1))

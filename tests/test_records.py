import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vecloom.functions.distance import pair_distances
from vecloom.operators import records, search
from vecloom.operators.scalar import ScalarQuery
from vecloom.operators.search import knn_batch
from vecloom.types import Direction, Metric


def test_upsert_refuses_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id long, k string, v int")
    new = spark.createDataFrame([(0, "a", 5), (1, "b", 6)], "pos long, k string, v int")
    assert sorted((r.id, r.k, r.v) for r in records.upserted(df, new, "k", 10).collect()) == [(2, None, 2), (10, "a", 5), (11, "b", 6)]
    with pytest.raises(Exception, match="has no k"):
        records.upserted(df, new.unionByName(spark.createDataFrame([(2, None, 7)], "pos long, k string, v int")), "k", 10).collect()


def test_all_rows_without_a_limit(spark):
    df = spark.range(1000).selectExpr("id", "named_struct('n', id % 7) AS metadata")
    plan = lambda q: q.to_df()._jdf.queryExecution().executedPlan().toString()
    q = ScalarQuery(df).top_k(None)
    assert q.to_df().count() == 1000 and "Limit" not in plan(q) and "Sort" not in plan(q)
    assert [r.id for r in ScalarQuery(df).top_k(None).order_by("n", Direction.DESC).to_list()][:3] == [6, 13, 20]
    with pytest.raises(ValueError):
        q.to_page()


@pytest.mark.parametrize("metric", list(Metric))
def test_many_queries_give_the_same_as_few(spark, monkeypatch, metric):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(r.integers(-3, 4, (200, 5)))], "id long, vector array<float>")
    asked = df.selectExpr("id AS query_id", "vector").where("id % 3 = 0").union(spark.createDataFrame([(999, None)], "id long, vector array<float>"))
    rows = lambda: sorted((x.query_id, x["rank"], x.id, round(x.distance, 9)) for x in knn_batch(df, asked, 7, metric).collect())
    few = rows()
    monkeypatch.setattr(search, "QUERIES", 20), monkeypatch.setattr(search, "NUMBERS", 150)
    assert rows() == few and len(few) == 67 * 7


@pytest.mark.parametrize("few", [True, False])
def test_equal_vectors_tie_by_id(spark, monkeypatch, few):
    """Each vector thrice, at odd places of blocks of odd sizes: the three are as near, whatever matrix products say."""
    x = np.random.default_rng(3).normal(size=(331, 37))
    df = spark.createDataFrame([(i, x[i % 331].tolist()) for i in range(993)], "id long, vector array<double>").coalesce(1)
    if not few:
        monkeypatch.setattr(search, "QUERIES", 50), monkeypatch.setattr(search, "NUMBERS", 37 * 400)
    got = {}
    for r in knn_batch(df, df.selectExpr("id AS query_id", "vector").where("id < 331"), 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert all(got[i] == {1: i, 2: i + 331, 3: i + 662} for i in range(331))


@pytest.mark.parametrize("metric", list(Metric))
def test_memory_does_not_grow_with_the_rows(metric):
    """40,000 rows at once past 300 queries: far less is held than the distances of 256 queries (82 MB)."""
    r = np.random.default_rng(4)
    x, ids = r.integers(-40, 41, (40_000, 3)).astype(float), r.permutation(40_000)
    tracemalloc.start()
    held = search.Nearest(metric, np.arange(300), x[:300], 5)
    held.add(ids, x)
    found = pa.Table.from_batches(list(held.found()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and found.num_rows == 1500
    for q in range(0, 300, 50):
        d = pair_distances(metric, np.repeat(x[q : q + 1], 40_000, axis=0), x, np.repeat((x[q] ** 2).sum(), 40_000), (x**2).sum(axis=1))
        assert found.slice(5 * q, 5)["id"].to_pylist() == ids[np.lexsort((ids, d))[:5]].tolist()


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("size", [1e-30, 1.0, 1e19, 1e25])
def test_stream_as_single_pairs(metric, size):
    """Zero vectors and lengths beyond 32-bit floats included, in small blocks."""
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 6)) * size
    x[::7], x[3] = 0, np.nan
    held = search.Nearest(metric, np.arange(60), x[:60], 9)
    for a in range(0, 400, 90):
        held.add(np.arange(a, min(400, a + 90)), x[a : a + 90])
    lengths = search.sums(x, x)
    for q in range(60):
        d = pair_distances(metric, np.repeat(x[q : q + 1], 400, axis=0), x, np.repeat(lengths[q], 400), lengths)
        assert held.ids[q].tolist() == np.argsort(d, kind="stable")[:9].tolist()

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import ann
from vecloom.llm.ann import fit, nearest


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x)], "id long, vector array<double>")


def exact(x, ids, q, own, k):
    s = np.einsum("nd,d->n", x, q)
    keep = np.flatnonzero(ids != own)
    order = keep[np.lexsort((ids[keep], -s[keep]))][:k]
    return ids[order], s[order]


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths"])
def test_recall(spark, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 24))
    if kind == "clusters":
        x = r.normal(size=(30, 24))[r.integers(0, 30, 3000)] * 4 + x * 0.5
    if kind == "lengths":
        x *= r.lognormal(0, 0.5, (3000, 1))
    ids, df = np.arange(3000), frame(spark, x)
    got, hits = by_query(nearest(df.repartition(4), df.where("id % 20 = 0"), 20)), 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        want, scores = exact(x, ids, x[q], q, 20)
        hits += len(set(want.tolist()) & {f[1] for f in found})
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(math.isclose(f[2], x[q] @ x[f[1]], rel_tol=1e-12) for f in found)
    assert hits / (20 * len(got)) >= 0.93


def test_copies_and_ties(spark, monkeypatch):
    """A third of all rows are one vector; blocks are small, so its list is cut up."""
    monkeypatch.setattr(ann, "BLOCK", 50), monkeypatch.setattr(ann, "QUERIES", 7), monkeypatch.setattr(ann, "CELLS", 40)
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 8))
    x[::3] = [3.0] * 8
    df = frame(spark, x)
    got = by_query(nearest(df, df.where("id % 20 = 0"), 20))
    for q in range(0, 900, 60):
        assert [f[1] for f in got[q]] == [i for i in range(0, 66, 3) if i != q][:20]


def test_odd_vectors(spark):
    x = [[1, 0], [0.9, 0.1], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3], [], [0.5, 0.5], [1, 0]]
    df = frame(spark, x).withColumn("score", F.lit(1)).unionByName(frame(spark, [[1, 1]]).select(F.lit(None).cast("long").alias("id"), "vector", F.lit(1).alias("score")))
    got = by_query(nearest(df, df, 20))
    assert sorted(got) == [0, 1, 9, 10]
    assert [f[1] for f in got[0]] == [10, 1, 9] and [f[1] for f in got[10]] == [0, 1, 9]


def test_few_rows(spark):
    df = frame(spark, [[1.0, 2.0]])
    assert nearest(df, df).collect() == [] and nearest(df.limit(0), df).collect() == [] and nearest(df, df.limit(0)).collect() == []
    df = frame(spark, np.eye(5), [7, 7, 8, 9, 10])
    got = by_query(nearest(df, df.where("id = 8"), 20))
    assert sorted(f[1] for f in got[8]) == [7, 7, 9, 10]


def test_codes_stand_for_residuals():
    r = np.random.default_rng(6)
    x = r.normal(size=(2000, 10))
    index = fit(x, 2000, 10)
    lists = index.lists(x)
    codes = index.codes(x, lists)
    near = index.centroids[lists] + np.concatenate([index.books[g][codes[:, g]] for g in range(len(index.books))], axis=1)[:, :10]
    assert ((x - near) ** 2).sum() < 0.1 * (x**2).sum()
    q = x[:3]
    tables = index.tables(q)
    for i in range(3):
        looked_up = q[i] @ index.centroids[lists[5]] + sum(tables[i, g, codes[5, g]] for g in range(len(index.books)))
        assert math.isclose(looked_up, q[i] @ near[5], rel_tol=1e-9)


@pytest.mark.parametrize("n", [21, 40, 61])
def test_small_lists_give_k_neighbours(spark, n):
    """Equal vectors and a tight cluster, each in one list of at most 61 rows, far from all others."""
    r = np.random.default_rng(8)
    far = r.normal(size=(400, 6)) - [0, 0, 0, 0, 40, 40]
    for cluster in (np.tile([9.0, 0, 0, 0, 0, 0], (n, 1)), r.normal(size=(n, 6)) * 0.01 + [9, 0, 0, 0, 0, 0]):
        x, ids = np.concatenate([cluster, far]), np.arange(n + 400)
        df = frame(spark, x)
        got = by_query(nearest(df, df.where(f"id < {n}"), 20))
        for q in range(n):
            want, _ = exact(x, ids, x[q], q, 20)
            assert [f[0] for f in got[q]] == list(range(1, 21)) and {f[1] for f in got[q]} == set(want.tolist())


def test_one_list_of_equal_vectors(spark):
    df = frame(spark, np.ones((21, 3)))
    got = by_query(nearest(df, df, 20))
    assert all([f[1] for f in got[q]] == [i for i in range(21) if i != q] for q in range(21))


def test_repeats_of_an_id_take_no_places(spark):
    """All rows of a cluster have one id, so a query's neighbours are in other lists than its own."""
    x = np.random.default_rng(9).normal(size=(40, 16))
    x = np.repeat(x / np.linalg.norm(x, axis=1, keepdims=True), 30, axis=0)
    df = frame(spark, x, np.repeat(np.arange(40), 30))
    got = by_query(nearest(df, df.dropDuplicates(["id"]), 20))
    assert all(len(got.get(q, [])) == 20 and q not in {f[1] for f in got[q]} for q in range(40))


def test_queries_unlike_the_rows(spark):
    """The rows are clusters, the queries among them point anywhere: probes that suit the rows miss half of their neighbours."""
    r = np.random.default_rng(10)
    x = r.normal(size=(60, 32))[r.integers(0, 60, 4000)] + r.normal(size=(4000, 32)) * 0.1
    x[::20] = r.normal(size=(200, 32))
    ids, df = np.arange(4000), frame(spark, x)
    got = by_query(nearest(df.repartition(4), df.where("id % 20 = 0"), 20))
    shares = [len(set(exact(x, ids, x[q], q, 20)[0].tolist()) & {f[1] for f in got[q]}) / 20 for q in range(0, 4000, 20)]
    assert np.mean(shares) >= 0.93 and np.quantile(shares, 0.1) >= 0.7


@pytest.mark.parametrize("size", [1e-25, 1.0, 1e25])
def test_reranking_loses_nothing(spark, monkeypatch, size):
    """With all lists probed the search is exact: near copies with equal codes, vectors the sample did not hold, any scale."""
    monkeypatch.setattr(ann, "SAMPLE", 300), monkeypatch.setattr(ann, "MEASURED", 5000)
    r = np.random.default_rng(11)
    x = r.normal(size=(2000, 12))
    x[500:1200] = x[500] + r.normal(size=(700, 12)) * 1e-7
    x[1500:1505] *= 300
    x *= size
    ids, df = np.arange(2000), frame(spark, x)
    got = by_query(nearest(df.repartition(4), df.where("id % 20 = 0"), 20, recall=1.0))
    hits = sum(len(set(exact(x, ids, x[q], q, 20)[0].tolist()) & {f[1] for f in got[q]}) for q in got)
    assert len(got) == 100 and hits >= 0.99 * 2000


def test_bound_of_codes():
    r = np.random.default_rng(12)
    x = r.normal(size=(3000, 10)) * r.pareto(1.0, (3000, 1))
    index = fit(x[:500], 3000)
    lists = index.lists(x)
    codes = index.codes(x, lists)
    slack, far = index.left(x, lists, codes)
    q = ann.unit(r.normal(size=(50, 10))) * index.scale
    near = index.approximate(q, index.tables(q).astype(np.float32), lists, codes)
    assert (np.abs(near - q @ x.T) <= slack).all() and np.allclose(far, np.linalg.norm(x - index.centroids[lists], axis=1) * index.scale)

import numpy as np
import pytest

from vecloom.operators.scalar import ScalarQuery
from vecloom.operators.search import VectorQuery, knn_batch
from vecloom.plans.filters import And, Equal, In, Not, Range
from vecloom.plans.ordering import Cursor
from vecloom.types import DimensionMismatch, Direction, Metric, Projection

VECTORS = "id long, vector array<float>, metadata struct<group: string, score: long>"
ASC, DESC = Direction.ASC, Direction.DESC


def vectors(spark, rows):
    return spark.createDataFrame([(i + 1, [float(x) for x in v], m) for i, (v, m) in enumerate(rows)], VECTORS)


def test_cosine_ranking(spark):
    df = vectors(spark, [((1, 0, 0, 0), None), ((0.9, 0.1, 0, 0), None), ((0, 1, 0, 0), None), ((-1, 0, 0, 0), None)])
    got = VectorQuery(df, [1, 0, 0, 0]).top_k(4).to_list()
    assert [r.id for r in got] == [1, 2, 3, 4] and got[0].score == pytest.approx(1) and got[3].score == pytest.approx(-1)


def test_euclidean_far_last(spark):
    df = vectors(spark, [((0, 0, 0, 0), None), ((1, 0, 0, 0), None), ((10, 10, 10, 10), None)])
    got = VectorQuery(df, [0.5, 0, 0, 0], Metric.EUCLIDEAN).top_k(3).to_list()
    assert [r.id for r in got] == [1, 2, 3]


def test_hybrid(spark):
    df = vectors(spark, [((i, 0, 0, 0), ("A" if i < 10 else "B", i)) for i in range(20)])
    assert {r.metadata.group for r in VectorQuery(df, [1, 0, 0, 0]).where("group", "A").top_k(20).to_list()} == {"A"}
    assert len(VectorQuery(df, [1, 0, 0, 0]).where("group", "A").top_k(20).to_list()) == 10
    assert len(VectorQuery(df, [1, 0, 0, 0]).where(Range("score", 5, 15, high_inclusive=True)).top_k(20).to_list()) == 11
    assert VectorQuery(df, [1, 0, 0, 0]).where("group", "C").to_list() == []


def test_min_score_after_top_k(spark):
    df = vectors(spark, [((1, 0), None), ((0.7, 0.7), None), ((0, 1), None), ((-1, 0), None)])
    assert [r.id for r in VectorQuery(df, [1, 0]).with_min_score(0.9).to_list()] == [1]
    assert len(VectorQuery(df, [1, 0]).with_min_score(0).to_list()) == 4
    assert len(VectorQuery(df, [1, 0]).with_min_score(-5).to_list()) == 4


def test_refused(spark):
    df = vectors(spark, [((1, 0), None)])
    for wrong in (lambda: VectorQuery(df, [1, 0]).top_k(0), lambda: VectorQuery(df, [1, 0]).with_ef_search(0), lambda: ScalarQuery(df).top_k(0), lambda: ScalarQuery(df).order_by(" "), lambda: ScalarQuery(df).select(16)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(DimensionMismatch):
        VectorQuery(df, [1, 0, 0], dimensions=2)


@pytest.mark.parametrize("metric", list(Metric))
def test_batch_as_single(spark, metric):
    r = np.random.default_rng(42)
    x = r.uniform(-1, 1, (300, 16)).astype(np.float32)
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    got = {}
    for row in knn_batch(df, df.where("id < 5").selectExpr("id AS query_id", "vector"), 10, metric).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = row.id
    for q in range(5):
        single = [row.id for row in VectorQuery(df, x[q].tolist(), metric).top_k(10).to_list()]
        assert [got[q][k + 1] for k in range(10)] == single


SCALAR = "id long, metadata struct<priority: long, status: string, category: string, updatedAt: long, weight: double>"
FIVE = [(1, (1, "inactive", "normal", 10, 1.5)), (2, (3, "active", "normal", 20, None)), (3, (2, "pending", "normal", 30, float("nan"))), (4, (5, "active", "normal", 40, -2.0)), (5, (4, "active", "ignored", 50, 1.5))]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, SCALAR).cache()


def test_scalar(five):
    q = ScalarQuery(five).where(And(In("status", ["active", "pending"]), Range("priority", 2, 5, high_inclusive=True), Not(Equal("category", "ignored")))).order_by("priority")
    assert [r.metadata.priority for r in q.to_list()] == [2, 3, 5]
    assert [r.id for r in ScalarQuery(five).where("status", "active").order_by("priority", DESC).then_by("updatedAt", DESC).top_k(2).to_list()] == [4, 5]
    assert [r.id for r in ScalarQuery(five).order_by("status").order_by("priority", DESC).to_list()] == [4, 5, 2, 3, 1]
    assert [r.id for r in ScalarQuery(five).to_list()] == [1, 2, 3, 4, 5]
    assert [r.id for r in ScalarQuery(five).order_by("weight").to_list()] == [2, 3, 4, 1, 5]
    assert [r.id for r in ScalarQuery(five).order_by("weight", DESC).to_list()] == [1, 5, 4, 3, 2]


def test_projection(five):
    assert ScalarQuery(five).select(Projection.ID).to_df().columns == ["id"]
    assert ScalarQuery(five).select(Projection.METADATA | Projection.TEXT).to_df().columns == ["id", "metadata"]


@pytest.mark.parametrize("order", [[("status", ASC), ("priority", DESC)], [("weight", ASC)], [("weight", DESC), ("status", DESC)], [("category", DESC)], []])
@pytest.mark.parametrize("size", [1, 2, 4])
def test_pages_join_up(five, order, size):
    def query(k):
        q = ScalarQuery(five).top_k(k)
        for field, direction in order:
            q.then_by(field, direction)
        return q

    want, got, cursor = [r.id for r in query(100).to_list()], [], None
    for _ in range(10):
        q = query(size)
        page = (q.after(cursor) if cursor else q).select(Projection.ID).to_page()
        got += [r.id for r in page.records]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert got == want


def test_cursor_of_another_sort(five):
    cursor = ScalarQuery(five).order_by("priority").top_k(1).to_page().next_cursor
    with pytest.raises(ValueError):
        ScalarQuery(five).order_by("priority", DESC).after(cursor).to_page()
    with pytest.raises(ValueError):
        ScalarQuery(five).order_by("priority").after(Cursor(("priority",), (ASC,), (), 1)).to_page()


@pytest.mark.parametrize("name,table", [("sort_multi", "documents"), ("sort_stable_ties", "documents"), ("sort_nulls_asc", "documents"), ("sort_nulls_desc", "documents"), ("sort_fraction", "events")])
def test_sorting_queries_return_all_rows(spark, name, table):
    duckdb = pytest.importorskip("duckdb")
    from vecloom.queries import QUERIES, SQL

    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    assert len(got) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert got == sorted(con.execute(SQL[name]).fetchall())

import pytest

from vecloom.plans.filters import And, Equal, In, Not, NotEqual, Or, Range, where

SCHEMA = "id long, metadata struct<type: string, status: string, score: long, val: double, flag: boolean>"
ROWS = [
    (1, ("doc", "active", 1, 10.0, True)), (2, ("note", "inactive", 2, 20.5, False)), (3, ("doc", "archived", 3, float("nan"), None)), (4, ("image", "active", 4, None, True)),
    (5, (None, None, None, 5.5, None)), (6, None),
]
ALL = {1, 2, 3, 4, 5, 6}
CASES = [
    (Equal("type", "doc"), {1, 3}), (NotEqual("type", "doc"), {2, 4, 5, 6}), (In("status", ["active", "pending"]), {1, 4}), (In("status", []), set()), (Not(In("status", [])), ALL),
    (In("score", [1, "2", 3.0, True]), {1}), (Range("score", 2, 4), {2, 3}), (Range("score", 2, 4, high_inclusive=True), {2, 3, 4}), (Range("score", 2, 4, False, False), {3}),
    (Range("score", 3), {3, 4}), (Range("score", None, 3), {1, 2}), (Range("score"), {1, 2, 3, 4}), (Range("missing", 0, 100), set()), (Not(Range("missing", 0, 100)), ALL),
    (Range("score", 1.5, 3.5), {2, 3}), (Range("score", 2.0, 3.0, high_inclusive=True), {2, 3}), (Range("score", 1.5, 2.5, False, True), {2}), (Range("score", float("-inf"), float("inf")), {1, 2, 3, 4}),
    (Range("val", 10, 21), {1, 2}), (Range("val", None, 10.0), {3, 5}), (Range("val", 0.0), {1, 2, 5}), (Range("val"), {1, 2, 3, 5}), (Range("type", "doc", "j"), {1, 3, 4}), (Range("type", 1, 5), set()),
    (Range("score", float("nan")), set()), (Equal("score", 1.0), set()), (Equal("score", "1"), set()), (Equal("score", True), set()), (Equal("flag", True), {1, 4}), (Equal("flag", 1), set()),
    (Equal("val", 10), set()), (Equal("val", 10.0), {1}), (NotEqual("score", "1"), ALL), (NotEqual("missing", 1), ALL), (Equal("missing", 1), set()),
    (And(), set()), (Or(), set()), (Not(And()), ALL), (And(Equal("type", "doc"), Equal("status", "active")), {1}), (Or(Equal("type", "doc"), Equal("status", "active")), {1, 3, 4}),
    (Not(Equal("type", "doc")), {2, 4, 5, 6}), (Not(Not(Equal("type", "doc"))), {1, 3}), (Not(NotEqual("type", "doc")), {1, 3}), (Not(Range("score", 2)), {1, 5, 6}),
    (And(Or(Equal("type", "doc"), Equal("type", "note")), Not(Equal("status", "archived"))), {1, 2}), (Not(And(Equal("type", "doc"), Range("score", 2))), {1, 2, 4, 5, 6}),
    (Not(Or(Equal("type", "doc"), Equal("flag", True))), {2, 5, 6}), (Equal("type", "doc") & ~Equal("status", "active"), {3}), (Equal("type", "note") | Equal("type", "image"), {2, 4}),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_all(df):
    got = df.select("id", *[f.column(__import__("vecloom.plans.filters", fromlist=["Fields"]).Fields(df)).alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).collect()
    for i, (f, want) in enumerate(CASES):
        assert {r.id for r in got if r[f"c{i}"]} == want, f


def test_where_is_and(df):
    assert {r.id for r in where(df, Equal("type", "doc"), None, Range("score", 2)).collect()} == {3}


def test_plain_columns(spark):
    flat = spark.createDataFrame([(1, "a"), (2, None)], "id long, kind string")
    assert [r.id for r in where(flat, NotEqual("kind", "a")).collect()] == [2]


@pytest.mark.parametrize("make", [lambda: Equal("", 1), lambda: Equal("a", None), lambda: Range(" "), lambda: In("", [1])])
def test_refused(make):
    with pytest.raises(ValueError):
        make()


def test_pushed_down(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = where(spark.read.parquet(str(tmp_path / "t")), Range("score", 1.5, 4), NotEqual("type", "doc")).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(metadata.score,2)" in plan and "LessThan(metadata.score,4)" in plan and "flag" not in plan.split("ReadSchema")[1]

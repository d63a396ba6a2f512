import threading

import pytest
from pyspark.sql import functions as F

from vecloom.memory import Memory, MemoryStore
from vecloom.sources.store import Database, ScalarRecord, VectorRecord
from vecloom.streaming.changes import changes, ingest
from vecloom.types import CollectionError, DimensionMismatch, Direction, IndexDefinition, IndexType, Mode, Options, Projection


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "db")


def open_(spark, path, **options):
    return Database(spark, path, Options(checkpoint_interval=None, **options))


def test_collections(spark, path):
    db = open_(spark, path)
    c = db.get_or_create("a", 3)
    assert db.get_or_create("a", 3).name == "a" and c.mode is Mode.VECTOR and c.dimensions == 3 and c.count == 0
    s = db.get_or_create_scalar("s")
    assert s.mode is Mode.SCALAR_ONLY and db.names() == ["a", "s"] and db.exists("a") and db.get("x") is None
    for wrong in (lambda: db.get_or_create("a", 4), lambda: db.get_or_create_scalar("a"), lambda: s.query([1.0]), lambda: c.insert_scalar(ScalarRecord({}))):
        with pytest.raises(CollectionError):
            wrong()
    for wrong in (lambda: db.get_or_create(" ", 3), lambda: db.get_or_create("b", 0), lambda: db.get_or_create("b", 5000)):
        with pytest.raises(ValueError):
            wrong()
    assert db.delete("a") and not db.delete("a") and db.get_or_create("a", 2).insert(VectorRecord([1, 2])) == 1


def test_records(spark, path):
    db = open_(spark, path)
    c = db.get_or_create("a", 2)
    record = VectorRecord([1, 2], {"name": "x", "n": 5, "f": 5.0, "b": True}, "text")
    assert c.insert(record) == 1 and record.id is None
    assert c.insert_batch([VectorRecord([0, 1], {"name": "y"}), VectorRecord([3, 4], None, ""), VectorRecord([5, 6])]) == [2, 3, 4]
    row = c.get(1)
    assert list(row.vector) == [1, 2] and row.text == "text" and row.metadata.asDict() == {"name": "x", "n": 5, "f": 5.0, "b": True}
    assert c.get(3).text is None and c.get(99) is None
    assert [r.id for r in c.get_batch([4, 2, 9, 4, 1])] == [4, 2, 4, 1]
    assert c.get_batch([1], Projection.METADATA)[0].asDict().keys() == {"id", "metadata"}
    with pytest.raises(DimensionMismatch):
        c.insert_batch([VectorRecord([1, 1]), VectorRecord([1])])
    assert c.count == 4 and c.find_ids("n", 5) == [1] and c.find_ids("n", 5.0) == []
    assert c.delete(2) and not c.delete(2) and c.delete_batch([1, 1, 77]) == 1 and c.count == 2
    assert c.insert(VectorRecord([1, 1])) == 5
    with pytest.raises(CollectionError):
        c.insert(VectorRecord([1, 1], {"n": "text"}))
    assert len(c.filter().to_list()) == 3 and [r.id for r in c.query([1, 1]).top_k(1).to_list()] == [5]


def test_upsert(spark, path):
    c = open_(spark, path).get_or_create("a", 1)
    assert c.upsert(VectorRecord([1], {"name": "alice", "age": 20}), "name") == 1
    assert c.upsert(VectorRecord([2], {"name": "alice", "age": 30}), "name") == 2
    assert c.count == 1 and c.get(2).metadata.age == 30
    with pytest.raises(ValueError):
        c.upsert(VectorRecord([2], {"age": 1}), "name")


@pytest.mark.parametrize("checkpoint", [False, True])
def test_reopen(spark, path, checkpoint):
    db = open_(spark, path)
    c, s = db.get_or_create("a", 2), db.get_or_create_scalar("s")
    c.insert_batch([VectorRecord([i, 1], {"i": i}, f"t{i}") for i in range(10)])
    s.insert_scalar_batch([ScalarRecord({"sequence": i, "kind": "event"}) for i in range(1, 4)])
    c.delete_batch([1, 2, 3])
    s.create_index(IndexDefinition("by", IndexType.ORDERED, ("sequence",)))
    assert s._db.get("s").list_indexes()[0].fields == ("sequence",)
    s.delete_df(s.df().where("id = 2").select("id"))
    if checkpoint:
        db.close()
        db.close()
        with pytest.raises(CollectionError):
            db.get_or_create("new", 1)
    db = open_(spark, path)
    c, s = db.get("a"), db.get("s")
    assert c.count == 7 and [r.text for r in c.get_batch([9, 4])] == ["t8", "t3"]
    assert [r.metadata.sequence for r in s.filter().order_by("sequence", Direction.ASC).to_list()] == [1, 3]
    assert c.insert(VectorRecord([0, 0])) == 11 and s.insert_scalar(ScalarRecord({})) == 4
    assert bool(db._catalog["collections"]["s"]["snapshot"]) == checkpoint
    with pytest.raises(CollectionError):
        s.create_index(IndexDefinition("by", IndexType.COMPOSITE_ORDERED, ("a", "b")))


def test_broken_off_write_is_not_seen(spark, path):
    db = open_(spark, path)
    c = db.get_or_create("a", 1)
    c.insert(VectorRecord([1]))
    db._written("a", c.df())  # rows without a commit
    assert open_(spark, path).get("a").count == 1


def test_second_writer(spark, path):
    one, two = open_(spark, path), open_(spark, path)
    one.get_or_create("a", 1)
    with pytest.raises(CollectionError, match="another writer"):
        two.get_or_create("b", 1)
    assert two.names() == ["a"] and two.get_or_create("b", 1)
    one.refresh()
    assert one.names() == ["a", "b"]


def test_insert_df(spark, path):
    c = open_(spark, path).get_or_create("a", 2)
    df = spark.range(1000).repartition(7).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.struct((999 - F.col("id")).alias("back")).alias("metadata"))
    assert c.insert_df(df.withColumn("o", F.col("metadata.back")), ["o"]) == (1, 1001)
    assert {(r.id, r.metadata.back) for r in c.df().collect()} == {(i + 1, i) for i in range(1000)}
    with pytest.raises(DimensionMismatch):
        c.insert_df(df.withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    assert c.count == 1000 and c.insert(VectorRecord([1, 1], {"other": "x"})) == 1001


def test_threads(spark, path):
    c = open_(spark, path).get_or_create("a", 1)
    threads = [threading.Thread(target=lambda: [c.insert(VectorRecord([1])) for _ in range(3)]) for _ in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert {r.id for r in c.df().collect()} == set(range(1, 10))


def test_memory(spark, path):
    store = MemoryStore(open_(spark, path))
    store.create_collection("m")
    assert not store.exists("m") and store.get("m", "a") is None
    assert list(store.upsert_batch("m", [Memory("a", "one", [1, 0]), Memory("b", "two", [0, 1], "more"), Memory("a", "three", [1, 1])])) == ["a", "b", "a"]
    assert store.get("m", "a").text == "three" and store.get("m", "b", True) == Memory("b", "two", (0.0, 1.0), "more")
    assert [m.key for m in store.get_batch("m", ["b", "x", "a", "b"])] == ["b", "a", "b"]
    assert [(m.key, round(s, 3)) for m, s in store.nearest_matches("m", [0, 1], 5, 0.5)] == [("b", 1.0), ("a", 0.707)]
    assert store.nearest_match("m", [0, 1])[0].key == "b"
    store.remove("m", "b"), store.remove("m", "none")
    assert store.get("m", "b") is None and store.collections() == ["m"]
    store.delete_collection("m")
    assert store.collections() == []


def test_stream(spark, path, tmp_path):
    db = open_(spark, path)
    c = db.get_or_create_scalar("s")
    source = str(tmp_path / "in")
    for part in range(2):
        spark.range(part * 5, part * 5 + 5).select(F.struct("id").alias("metadata"), F.lit("t").alias("text")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("metadata struct<id: bigint>, text string").parquet(source)
        ingest(stream, c, str(tmp_path / "check")).awaitTermination()
        assert c.count == (part + 1) * 5
    assert sorted(r.metadata.id for r in c.df().collect()) == list(range(10))
    assert changes(c).groupBy("op").count().collect()[0]["count"] == 10
    c.register("logged")
    assert spark.sql("SELECT max(id) FROM logged").first()[0] == 10


def test_options():
    for wrong in ({"page_size": 1000}, {"max_dimensions": 0}, {"hnsw_m": 1}, {"hnsw_ef_search": 0}, {"hnsw_ef_construction": 3000}, {"checkpoint_interval": -1}, {"metric": "cosine"}):
        with pytest.raises(ValueError):
            Options(**wrong)
    for wrong in (("", IndexType.ORDERED, ("a",)), ("x", IndexType.ORDERED, ("a", "b")), ("x", IndexType.ORDERED, ()), ("x", IndexType.COMPOSITE_ORDERED, ("a", " "))):
        with pytest.raises(ValueError):
            IndexDefinition(*wrong)


def test_readers_outlive_checkpoints(spark, path):
    db = open_(spark, path)
    c = db.get_or_create_scalar("s")
    c.insert_scalar_batch([ScalarRecord({"n": i}) for i in range(10)])
    before = c.df()
    db.checkpoint()
    held = c.df()
    assert c.delete_batch([1, 2, 3]) == 3
    less = c.df()
    db.checkpoint()
    assert [x.count() for x in (before, held, less, c.df())] == [10, 10, 7, 7]
    assert db.delete("s") and less.count() == 7 and db.get_or_create_scalar("s").count == 0
    now = Database(spark, path, Options(checkpoint_interval=None, retention=0.0))
    now.checkpoint()
    assert now._catalog["retired"] == []
    with pytest.raises(Exception):
        less.count()


def test_checkpoints_rewrite_only_where_it_is_worth_it(spark, path, monkeypatch):
    from vecloom.sources import store

    monkeypatch.setattr(store, "LOGGED", 3)
    db = open_(spark, path)
    c = db.get_or_create_scalar("s")
    c.insert_scalar_batch([ScalarRecord({"n": i}) for i in range(100)])
    db.checkpoint()
    first = db._catalog["collections"]["s"]["snapshot"]
    for i in range(4):
        c.insert_scalar(ScalarRecord({"n": 1000 + i}))
    c.delete_batch([1, 101])
    db.checkpoint()
    state = db._catalog["collections"]["s"]
    assert state["snapshot"] == first and len(state["log"]) == 2 and c.count == 102
    assert sorted(r.id for r in open_(spark, path).get("s").df().collect()) == [i for i in range(1, 105) if i not in (1, 101)]
    c.delete_batch(range(2, 40))
    db.checkpoint()
    state = db._catalog["collections"]["s"]
    assert state["snapshot"] != first and state["log"] == [] and c.count == 64 == state["rows"]


def test_upsert_batch(spark, path):
    c = open_(spark, path).get_or_create("v", 1)
    c.insert_batch([VectorRecord([i], {"k": f"k{i % 3}", "n": i}) for i in range(6)])
    assert c.upsert_batch([VectorRecord([9], {"k": "k1", "n": 8}), VectorRecord([9], {"k": "k7", "n": 9}), VectorRecord([9], {"k": "k1", "n": 10})], "k") == [7, 8]
    assert sorted((r.metadata.k, r.metadata.n) for r in c.df().collect()) == [("k0", 0), ("k0", 3), ("k1", 10), ("k2", 2), ("k2", 5), ("k7", 9)]
    with pytest.raises(ValueError):
        c.upsert_batch([VectorRecord([1], {"n": 1})], "k")
    assert c.delete_values("k", ["k0", "none"]) == 2 and c.delete_values("other", [1]) == 0

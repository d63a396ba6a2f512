"""The library's own queries over the test tables, and the SQL that gives the same rows.

Collections: ``embeddings`` (vectors and a label), ``docs_vec`` (vectors with
their documents), ``docs_meta`` (documents with their labels, which some lack).
Orders are returned as a rank or pos column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import Memory, MemoryStore
from .operators import records
from .operators.scalar import ScalarQuery
from .operators.search import VectorQuery, knn_batch
from .plans.filters import And, Equal, Fields, Filter, In, Not, NotEqual, Or, Range, where
from .plans.ordering import Cursor, after
from .sources.staging import fresh_path, staged
from .sources.store import Collection, Database
from .streaming.changes import changes
from .types import Direction, IndexDefinition, IndexType, Metric, Options, Projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASC, DESC = Direction.ASC, Direction.DESC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.struct("label").alias("metadata"))


def docs_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    both = e.join(d, e["vec_id"] == d["doc_id"])
    return both.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.struct("label", "lang", "source", "n_chars").alias("metadata"), "text")


def docs_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.struct("lang", "source", "n_chars", "quality", "toxic").alias("metadata"), "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.struct("event_type", "user_id", "value").alias("metadata"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


#: Results show a missing quality as -1, as not all clients tell a missing whole number from a fraction.
def shown(name: str) -> Column:
    c = F.col(f"metadata.{name}")
    return F.coalesce(c, F.lit(-1)).alias("quality") if name == "quality" else c


def shown_sql(name: str) -> str:
    return "coalesce(quality, -1) AS quality" if name == "quality" else name


def ranked(found: DataFrame, *columns: str) -> DataFrame:
    """A result of k rows, with its order as a rank."""
    rank = F.row_number().over(Window.orderBy("distance", "id"))
    return found.select(rank.alias("rank"), F.col("id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"), (F.round("score", 6) + 0.0).alias("score"), *columns)


META = "docs_meta AS (SELECT d.doc_id AS id, lang, source, n_chars, quality, toxic, text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
DOCS = "docs_vec AS (SELECT vec_id AS id, embedding, label, lang, source, n_chars, text FROM embeddings JOIN documents ON vec_id = doc_id)"
DISTANCE = {
    Metric.COSINE: "list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))",
    Metric.EUCLIDEAN: "list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))",
    Metric.DOT: "list_negative_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))",
}


def knn_sql(metric: Metric = Metric.COSINE, predicate: str = "true", k: int = 10, least: float | None = None, source: str = "(SELECT vec_id AS id, embedding, label FROM embeddings)", ctes: str = "", extra: str = "") -> str:
    kept = f" AND 1 - d >= {least}" if least else ""
    return f"""WITH {ctes + ", " if ctes else ""}x AS (SELECT *, {DISTANCE[metric]} AS d FROM {source} WHERE {predicate}),
        r AS (SELECT *, row_number() OVER (ORDER BY d, id) AS rank FROM x)
        SELECT rank::INT AS rank, id AS vec_id, round(d, 6) + 0.0 AS distance, round(1 - d, 6) + 0.0 AS score{extra} FROM r WHERE rank <= {k}{kept}"""


def _knn(name: str, metric: Metric = Metric.COSINE, build=lambda q: q, **sql) -> None:
    QUERIES[name] = lambda spark, d: ranked(build(VectorQuery(embeddings(spark, d), vector_of(spark, d), metric)).to_df())
    SQL[name] = knn_sql(metric, **sql)


_knn("knn_cosine")
_knn("knn_euclidean", Metric.EUCLIDEAN)
_knn("knn_dot", Metric.DOT)
_knn("knn_min_score", build=lambda q: q.top_k(50).with_min_score(0.2), k=50, least=0.2)
_knn("knn_ef_search", build=lambda q: q.top_k(5).with_ef_search(100), k=5)
_knn("score_column", Metric.EUCLIDEAN, build=lambda q: q.top_k(25), k=25)


def _hybrid(name: str, predicate: str, *filters: Filter, metric: Metric = Metric.COSINE) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = VectorQuery(docs_vec(spark, d), vector_of(spark, d), metric)
        for f in filters:
            q.where(f)
        # The wide text is not read before the k are known.
        return ranked(q.to_df().drop("text"), "metadata.lang", "metadata.label")

    QUERIES[name] = run
    SQL[name] = knn_sql(metric, predicate, source="docs_vec", ctes=DOCS, extra=", lang, label")


_hybrid("hybrid_equal", "lang = 'en'", Equal("lang", "en"))
_hybrid("hybrid_range", "label >= 2 AND label < 6", Range("label", 2, 6))
_hybrid("hybrid_and", "lang = 'en' AND n_chars >= 500 AND n_chars <= 5000", Equal("lang", "en"), Range("n_chars", 500, 5000, high_inclusive=True), metric=Metric.EUCLIDEAN)
_hybrid("hybrid_or_not", "(lang = 'de' OR lang = 'fr') AND NOT coalesce(label = 3, false)", And(Or(Equal("lang", "de"), Equal("lang", "fr")), Not(Equal("label", 3))), metric=Metric.DOT)
_hybrid("hybrid_empty", "lang = 'none'", Equal("lang", "none"))


def knn_batch_query(spark: SparkSession, d: str) -> DataFrame:
    rows = embeddings(spark, d)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return knn_batch(rows, queries, 10).select("query_id", "rank", F.col("id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


QUERIES["knn_batch"] = knn_batch_query
SQL["knn_batch"] = """WITH x AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM x)
    SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 10"""


def _filter(name: str, predicate: str, *filters: Filter) -> None:
    QUERIES[name] = lambda spark, d: where(docs_meta(spark, d), *filters).select("id", "metadata.lang", "metadata.n_chars", shown("quality"))
    SQL[name] = f"WITH {META} SELECT id, lang, n_chars, coalesce(quality, -1) AS quality FROM docs_meta WHERE {predicate}"


_filter("filter_equal", "lang = 'en'", Equal("lang", "en"))
_filter("filter_not_equal", "quality IS DISTINCT FROM 1", NotEqual("quality", 1))
_filter("filter_in", "source IN ('src1', 'src2', 'src7')", In("source", ["src1", "src2", "src7", 5]))
_filter("filter_range_half_open", "n_chars >= 500 AND n_chars < 2000", Range("n_chars", 500, 2000))
_filter("filter_range_inclusive", "n_chars >= 500 AND n_chars <= 2000", Range("n_chars", 500, 2000, high_inclusive=True))
_filter("filter_range_open_low", "n_chars < 800", Range("n_chars", None, 800))
_filter("filter_range_open_high", "n_chars > 3000", Range("n_chars", 3000, None, low_inclusive=False))
_filter("filter_range_cross_type", "n_chars >= 500.5 AND n_chars < 2000.5", Range("n_chars", 500.5, 2000.5))
_filter("filter_range_present", "quality IS NOT NULL", Range("quality"))
_filter("filter_and", "lang = 'en' AND quality = 1 AND n_chars < 2000", And(Equal("lang", "en"), Equal("quality", 1), Range("n_chars", None, 2000)))
_filter("filter_or", "lang = 'fr' OR quality = 0", Or(Equal("lang", "fr"), Equal("quality", 0)))
_filter("filter_not", "NOT coalesce(quality = 1, false)", Not(Equal("quality", 1)))
_filter("filter_strict_types", "false", Equal("n_chars", "500"))
_filter("filter_empty_and", "false", And())
_filter("filter_empty_in", "false", In("lang", []))
_filter(
    "filter_complex", "(lang = 'de' OR lang = 'fr') AND NOT coalesce(n_chars >= 1000 AND n_chars < 4000, false) AND quality IS DISTINCT FROM 0",
    Or(Equal("lang", "de"), Equal("lang", "fr")), And(Not(Range("n_chars", 1000, 4000)), NotEqual("quality", 0)),
)


def _project(name: str, projection: Projection, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = docs_vec(spark, d)
        out = ScalarQuery(df).top_k(None).select(projection).to_df()
        return out.selectExpr(*columns)

    QUERIES[name] = run
    SQL[name] = f"WITH {DOCS} SELECT {sql} FROM docs_vec"


_project("project_id", Projection.ID, ["id"], "id")
_project("project_metadata", Projection.METADATA, ["id", "metadata.lang AS lang", "metadata.label AS label"], "id, lang, label")
_project("project_metadata_text", Projection.METADATA | Projection.TEXT, ["id", "metadata.source AS source", "char_length(text) AS text_length"], "id, source, length(text)::INT AS text_length")
_project("project_all", Projection.ALL, ["id", "metadata.n_chars AS n_chars", "char_length(text) AS text_length", "size(vector) AS dimensions"], "id, n_chars, length(text)::INT AS text_length, len(embedding)::INT AS dimensions")


#: Rows that a sorting query returns: all.
EVERY = 2**31 - 1


def _sort(name: str, order: list[tuple[str, Direction]], k: int, sql: str, *filters: Filter, predicate: str = "true", source=docs_meta, columns: tuple[str, ...] = ("lang", "n_chars", "quality")) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = source(spark, d)
        q = ScalarQuery(df).top_k(k)
        for f in filters:
            q.where(f)
        for field, direction in order:
            q.then_by(field, direction)
        if k == EVERY:
            # A range sort, kept, so that its partitions are numbered as they were sorted; no task sees all rows.
            ranged = q.rows().select("id", F.col("id").alias("record"), "metadata")
            ranged = ranged.repartitionByRange(*q.sort_keys()).sortWithinPartitions(*q.sort_keys()).withColumn("_at", F.monotonically_increasing_id())
            return records.dense(staged(ranged, "sorted"), 1).select(F.col("id").cast("int").alias("pos"), F.col("record").alias("id"), *[shown(c) for c in columns])
        pos = F.row_number().over(Window.orderBy(*q.sort_keys()))
        return q.to_df().select(pos.alias("pos"), "id", *[shown(c) for c in columns])

    QUERIES[name] = run
    relation, ctes = ("docs_meta", f"{META}, ") if source is docs_meta else ("(SELECT event_id AS id, event_type, user_id, value FROM events)", "")
    SQL[name] = f"""WITH {ctes}r AS (SELECT *, row_number() OVER (ORDER BY {sql}) AS pos FROM {relation} WHERE {predicate})
        SELECT pos::INT AS pos, id, {", ".join(map(shown_sql, columns))} FROM r WHERE pos <= {k}"""


_sort("sort_multi", [("lang", ASC), ("n_chars", DESC)], EVERY, "lang ASC NULLS FIRST, n_chars DESC NULLS LAST, id")
_sort("sort_stable_ties", [("source", DESC)], EVERY, "source DESC NULLS LAST, id", columns=("source",))
_sort("sort_nulls_asc", [("quality", ASC), ("n_chars", ASC)], EVERY, "quality ASC NULLS FIRST, n_chars ASC NULLS FIRST, id")
_sort("sort_nulls_desc", [("quality", DESC), ("n_chars", ASC)], EVERY, "quality DESC NULLS LAST, n_chars ASC NULLS FIRST, id")
_sort("sort_fraction", [("value", DESC), ("event_type", ASC)], EVERY, "value DESC NULLS LAST, event_type ASC NULLS FIRST, id", source=events, columns=("event_type", "user_id", "value"))
_sort("scalar_topk", [("n_chars", DESC)], 10, "n_chars DESC NULLS LAST, id", Equal("lang", "en"), predicate="lang = 'en'")
_sort("scalar_default_order", [], 10, "id")

PAGED = [("quality", DESC), ("lang", ASC)]
PAGED_SQL = "quality DESC NULLS LAST, lang ASC NULLS FIRST, id"


def _page(name: str, skip: int, k: int, order: list[tuple[str, Direction]] = PAGED, sql: str = PAGED_SQL) -> None:
    """The page of k rows after the first ``skip`` rows, reached by a cursor."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = docs_meta(spark, d)
        q = ScalarQuery(df).top_k(k)
        for field, direction in order:
            q.then_by(field, direction)
        if skip:
            first = ScalarQuery(df).top_k(skip).select(Projection.METADATA)
            for field, direction in order:
                first.then_by(field, direction)
            q.after(first.to_page().next_cursor)
        pos = F.row_number().over(Window.orderBy(*q.sort_keys()))
        return q.select(Projection.METADATA).to_df().select(pos.alias("pos"), "id", "metadata.lang", shown("quality"))

    QUERIES[name] = run
    SQL[name] = f"""WITH {META}, r AS (SELECT *, row_number() OVER (ORDER BY {sql}) AS n FROM docs_meta)
        SELECT (n - {skip})::INT AS pos, id, lang, coalesce(quality, -1) AS quality FROM r WHERE n > {skip} AND n <= {skip + k}"""


_page("page_first", 0, 25)
_page("page_second", 25, 25)
_page("page_after_null_key", 30, 40, [("quality", ASC), ("lang", DESC)], "quality ASC NULLS FIRST, lang DESC NULLS LAST, id")


def keyset(spark: SparkSession, d: str) -> DataFrame:
    """Everything after a cursor in the middle, whose first key is missing."""
    df = docs_meta(spark, d)
    cursor = Cursor(("quality", "n_chars"), (ASC, DESC), (None, 1500), 100)
    return df.where(after(Fields(df), cursor)).select("id", shown("quality"), "metadata.n_chars")


QUERIES["page_keyset_rest"] = keyset
SQL["page_keyset_rest"] = f"WITH {META} SELECT id, coalesce(quality, -1) AS quality, n_chars FROM docs_meta WHERE quality IS NOT NULL OR n_chars < 1500 OR n_chars IS NULL OR (n_chars = 1500 AND id > 100)"


def _query(f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[f.__name__] = f


@_query
def batch_insert_ids(spark: SparkSession, d: str) -> DataFrame:
    return records.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]).select("id", "o_orderkey")


SQL["batch_insert_ids"] = "SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders"


@_query
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    return records.get(docs_meta(spark, d), 17).select("id", "metadata.lang", "metadata.n_chars")


SQL["get_by_id"] = f"WITH {META} SELECT id, lang, n_chars FROM docs_meta WHERE id = 17"


@_query
def get_batch_ordered(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").selectExpr("event_id AS pos", "user_id AS id")
    return records.get_batch(docs_meta(spark, d).select("id", "metadata.lang", "metadata.n_chars"), asked)


SQL["get_batch_ordered"] = f"WITH {META} SELECT event_id AS pos, id, lang, n_chars FROM events JOIN docs_meta ON user_id = id"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey", "o_orderstatus", "o_totalprice")


@_query
def delete_then_scan(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d)
    return records.deleted(df, df.where("id % 7 = 0"))


SQL["delete_then_scan"] = "SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0"


@_query
def delete_batch(spark: SparkSession, d: str) -> DataFrame:
    return records.count_deleted(orders(spark, d), table(spark, d, "lineitem").selectExpr("l_orderkey AS id"))


SQL["delete_batch"] = "SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"


@_query
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    new = orders(spark, d).where("o_orderstatus = 'F'").selectExpr("id - 1 AS pos", "o_custkey AS user_id", "'new' AS event_type", "o_totalprice AS value")
    df = table(spark, d, "events").selectExpr("event_id AS id", "user_id", "event_type", "value")
    return records.upserted(df, new, "user_id", 1_000_000_000)


SQL["upsert_by_key"] = """WITH new AS (SELECT o_orderkey - 1 AS pos, o_custkey AS user_id, 'new' AS event_type, o_totalprice AS value,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F')
    SELECT event_id AS id, user_id, event_type, value FROM events WHERE user_id NOT IN (SELECT user_id FROM new)
    UNION ALL SELECT pos + 1000000000, user_id, event_type, value FROM new WHERE n = 1"""


@_query
def find_ids(spark: SparkSession, d: str) -> DataFrame:
    return records.find_ids(docs_meta(spark, d), "source", "src3")


SQL["find_ids"] = "SELECT doc_id AS id FROM documents WHERE source = 'src3'"


@_query
def collection_count(spark: SparkSession, d: str) -> DataFrame:
    return docs_meta(spark, d).agg(F.count("*").alias("n"))


SQL["collection_count"] = "SELECT count(*) AS n FROM documents"


def memories(spark: SparkSession, d: str) -> DataFrame:
    return docs_vec(spark, d).select("id", F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("_key"), "vector", "text")


@_query
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    df = memories(spark, d)
    new = df.where("id % 3 = 0").selectExpr("id AS pos", "_key", "vector", "concat(text, '!') AS text")
    return records.upserted(df, new, "_key", 1_000_000).select("id", F.col("_key").alias("key"), F.length("text").alias("text_length"))


SQL["memory_upsert"] = f"""WITH {DOCS} SELECT CASE WHEN id % 3 = 0 THEN id + 1000000 ELSE id END AS id, 'doc-' || id AS key,
    length(CASE WHEN id % 3 = 0 THEN text || '!' ELSE text END)::INT AS text_length FROM docs_vec"""


@_query
def memory_get_batch(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").selectExpr("event_id AS _pos", "concat('doc-', user_id) AS _key")
    return asked.join(memories(spark, d), "_key").select(F.col("_pos").alias("pos"), F.col("_key").alias("key"), F.length("text").alias("text_length"))


SQL["memory_get_batch"] = f"WITH {DOCS} SELECT event_id AS pos, 'doc-' || id AS key, length(text)::INT AS text_length FROM events JOIN docs_vec ON user_id = id"


@_query
def memory_nearest(spark: SparkSession, d: str) -> DataFrame:
    df = memories(spark, d).select("id", "vector", F.struct("_key").alias("metadata"))
    found = VectorQuery(df, vector_of(spark, d, 7)).top_k(5).with_min_score(0.05).to_df()
    return found.select(F.col("metadata._key").alias("key"), (F.round("score", 6) + 0.0).alias("score"))


SQL["memory_nearest"] = f"""WITH {DOCS}, x AS (SELECT id, list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS d FROM docs_vec),
    r AS (SELECT *, row_number() OVER (ORDER BY d, id) AS n FROM x) SELECT 'doc-' || id AS key, round(1 - d, 6) + 0.0 AS score FROM r WHERE n <= 5 AND 1 - d >= 0.05"""


def opened(spark: SparkSession) -> Database:
    """A new database in the shared folder."""
    return Database(spark, fresh_path(spark, "store"), Options(checkpoint_interval=None))


def reopened(db: Database) -> Database:
    return Database(db.spark, db.path, Options(checkpoint_interval=None))


def stored_docs(spark: SparkSession, d: str, name: str = "docs") -> tuple[Database, Collection]:
    """All documents that have a vector, as a collection; ids follow doc_id."""
    db = opened(spark)
    collection = db.get_or_create(name, 64)
    collection.insert_df(docs_vec(spark, d).select("id", "vector", "metadata", "text"), ["id"])
    return db, collection


def lines(df: DataFrame) -> DataFrame:
    return df.select("id", "metadata.lang", "metadata.label", F.length("text").alias("text_length"))


STORED = f"{DOCS}, stored AS (SELECT row_number() OVER (ORDER BY id) AS id, embedding, label, lang, n_chars, length(text)::INT AS text_length FROM docs_vec)"


@_query
def store_insert_reopen(spark: SparkSession, d: str) -> DataFrame:
    """Insert, close (a checkpoint), open again, read all."""
    db, _ = stored_docs(spark, d)
    db.close()
    return lines(reopened(db).get("docs").df())


SQL["store_insert_reopen"] = f"WITH {STORED} SELECT id, lang, label, text_length FROM stored"


@_query
def store_log_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Insert and delete without a checkpoint; another database on the same path reads snapshot-less logs."""
    db, collection = stored_docs(spark, d)
    collection.delete_df(collection.df().where("id % 5 = 0"))
    return lines(reopened(db).get("docs").df())


SQL["store_log_recovery"] = f"WITH {STORED} SELECT id, lang, label, text_length FROM stored WHERE id % 5 <> 0"


@_query
def store_delete_compact(spark: SparkSession, d: str) -> DataFrame:
    """Delete a third of a checkpointed collection, so that the next checkpoint compacts it; a reader from before stays whole."""
    db, collection = stored_docs(spark, d)
    db.checkpoint()
    before = collection.df()
    n = collection.delete_df(collection.df().where("id % 3 = 0"))
    db.checkpoint()
    counted = collection.df().agg(F.count("*").alias("n_left"), F.sum("id").alias("sum_left"))
    return counted.crossJoin(before.agg(F.count("*").alias("n_before"))).withColumn("n_deleted", F.lit(n).cast("long"))


SQL["store_delete_compact"] = f"""WITH {STORED} SELECT count(*) FILTER (id % 3 <> 0) AS n_left, sum(id) FILTER (id % 3 <> 0)::BIGINT AS sum_left,
    count(*) AS n_before, count(*) FILTER (id % 3 = 0) AS n_deleted FROM stored"""


@_query
def store_recreate(spark: SparkSession, d: str) -> DataFrame:
    """Delete a collection and make one of its name with other dimensions: ids start anew."""
    db, _ = stored_docs(spark, d)
    db.delete("docs")
    collection = db.get_or_create("docs", 2)
    rows = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.struct(F.col("p_brand").alias("brand")).alias("metadata"))
    collection.insert_df(rows, ["p_partkey"])
    return collection.df().select("id", "metadata.brand", F.get("vector", F.lit(0)).cast("int").alias("size"))


SQL["store_recreate"] = "SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_brand AS brand, p_size::INT AS size FROM part"


@_query
def store_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Collections and indexes as a database lists them after it is opened again."""
    db, collection = stored_docs(spark, d)
    db.get_or_create_scalar("events")
    db.get_or_create("gone", 3)
    db.delete("gone")
    collection.create_index(IndexDefinition("by_size", IndexType.ORDERED, ("n_chars",)))
    collection.create_index(IndexDefinition("by_lang", IndexType.COMPOSITE_ORDERED, ("lang", "n_chars")))
    db.close()
    again = reopened(db)
    rows = [(n, c.mode.value, c.dimensions, ",".join(f"{x.name}:{'+'.join(x.fields)}" for x in c.list_indexes()), again.exists("gone")) for n in again.names() for c in [again.get(n)]]
    return spark.createDataFrame(rows, "name string, mode string, dimensions int, indexes string, gone boolean")


SQL["store_catalog"] = "SELECT * FROM (VALUES ('docs', 'vector', 64::INT, 'by_size:n_chars,by_lang:lang+n_chars', false), ('events', 'scalar_only', 1::INT, '', false)) v(name, mode, dimensions, indexes, gone)"


@_query
def store_ordered_range(spark: SparkSession, d: str) -> DataFrame:
    """A range over a field whose declared order sorts the snapshot."""
    db, collection = stored_docs(spark, d)
    collection.create_index(IndexDefinition("by_size", IndexType.ORDERED, ("n_chars",)))
    db.checkpoint()
    return collection.filter().where(Range("n_chars", 500, 2000)).top_k(None).select(Projection.METADATA).to_df().select("id", "metadata.n_chars", "metadata.lang")


SQL["store_ordered_range"] = f"WITH {STORED} SELECT id, n_chars, lang FROM stored WHERE n_chars >= 500 AND n_chars < 2000"


@_query
def store_scalar_only(spark: SparkSession, d: str) -> DataFrame:
    """A collection without vectors: insert, delete, close, open again, filter."""
    db = opened(spark)
    collection = db.get_or_create_scalar("events")
    collection.insert_df(events(spark, d), ["id"])
    collection.delete_df(collection.df().where("id % 2 = 0"))
    db.close()
    q = reopened(db).get("events").filter().where("event_type", "click").top_k(None).select(Projection.METADATA)
    return q.to_df().select("id", "metadata.user_id", "metadata.value")


SQL["store_scalar_only"] = """WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS id, event_type, user_id, value FROM events)
    SELECT id, user_id, value FROM s WHERE id % 2 <> 0 AND event_type = 'click'"""


@_query
def store_search(spark: SparkSession, d: str) -> DataFrame:
    """Nearest records of an open collection, with their texts."""
    db, collection = stored_docs(spark, d)
    db.checkpoint()
    return ranked(collection.query(vector_of(spark, d)).where(Equal("lang", "en")).to_df().withColumn("text_length", F.length("text")), "text_length")


SQL["store_search"] = knn_sql(predicate="lang = 'en'", source="stored", ctes=STORED, extra=", text_length")


@_query
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change log of a collection: its insertions and deletions."""
    _, collection = stored_docs(spark, d)
    collection.delete_df(collection.df().where("id % 10 = 0"))
    return changes(collection).groupBy("op").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"), F.countDistinct("seq").alias("n_changes"))


SQL["store_changes"] = f"""WITH {STORED} SELECT 'insert' AS op, count(*) AS n, sum(id)::BIGINT AS sum_id, 1::BIGINT AS n_changes FROM stored
    UNION ALL SELECT 'delete', count(*), sum(id)::BIGINT, 1 FROM stored WHERE id % 10 = 0"""


def remembered(spark: SparkSession, d: str) -> MemoryStore:
    """A memory store of nations: all of them, some again with another text, some removed; few objects, as its interface takes them."""
    store = MemoryStore(opened(spark))
    nations = table(spark, d, "nation").orderBy("n_nationkey").collect()
    memory = lambda n, more="": Memory(n["n_name"], n["n_name"] + more, (float(n["n_nationkey"]), float(n["n_regionkey"]), 1.0), str(n["n_regionkey"]))
    list(store.upsert_batch("nations", [memory(n) for n in nations]))
    list(store.upsert_batch("nations", [memory(n, " again") for n in nations if n["n_nationkey"] % 3 == 0]))
    store.remove_batch("nations", [n["n_name"] for n in nations if n["n_nationkey"] % 5 == 4])
    return store


REMEMBERED = """kept AS (SELECT n_name AS key, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' again' ELSE '' END AS text, n_regionkey::VARCHAR AS additional,
    n_nationkey AS n, [n_nationkey::DOUBLE, n_regionkey::DOUBLE, 1.0::DOUBLE] AS x FROM nation WHERE n_nationkey % 5 <> 4)"""


@_query
def memory_store_get(spark: SparkSession, d: str) -> DataFrame:
    """Memories by key, in the order asked for, without missing ones."""
    keys = [r["n_name"] for r in table(spark, d, "nation").orderBy(F.desc("n_nationkey")).collect()]
    got = remembered(spark, d).get_batch("nations", ["nobody", *keys])
    return spark.createDataFrame([(i, m.key, m.text, m.additional) for i, m in enumerate(got)], "pos int, key string, text string, additional string")


SQL["memory_store_get"] = f"WITH {REMEMBERED} SELECT (row_number() OVER (ORDER BY n DESC) - 1)::INT AS pos, key, text, additional FROM kept"


@_query
def memory_store_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The memories nearest to a vector, with their relevance."""
    found = remembered(spark, d).nearest_matches("nations", [3.0, 1.0, 2.0], 5, 0.1)
    return spark.createDataFrame([(i + 1, m.key, round(s, 6) + 0.0) for i, (m, s) in enumerate(found)], "rank int, key string, score double")


SQL["memory_store_nearest"] = f"""WITH {REMEMBERED}, r AS (SELECT key, n, list_cosine_similarity(x, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS score FROM kept)
    SELECT (row_number() OVER (ORDER BY score DESC, n))::INT AS rank, key, round(score, 6) + 0.0 AS score FROM r WHERE score >= 0.1 ORDER BY score DESC, n LIMIT 5"""


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the ten records nearest to record 0 among those of some labels."""
    return QUERIES["hybrid_range"](spark, sf_dir)


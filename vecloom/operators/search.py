"""Nearest-neighbour search: exact, lazily built, optionally restricted by predicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance_to, distances, pair_distances, sums
from ..plans.filters import Equal, Filter, where
from ..types import DimensionMismatch, Metric


class VectorQuery:
    """``VectorQuery(df, q).where(...).top_k(10).to_df()``: df has id, vector and further columns.

    Predicates apply first, then distances, then the k nearest (ties by id),
    then the minimum score if it is above 0.  The result has distance and
    score (1 - distance) besides the columns of df.
    """

    def __init__(self, df: DataFrame, vector: Sequence[float], metric: Metric = Metric.COSINE, dimensions: int | None = None, struct: str | None = "metadata"):
        if dimensions is not None and len(vector) != dimensions:
            raise DimensionMismatch(dimensions, len(vector))
        self._df, self._vector, self._metric, self._struct = df, vector, metric, struct
        self._filters: list[Filter] = []
        self._k, self._least, self._effort = 10, 0.0, None

    def where(self, filter_or_field: Filter | str, value=None) -> VectorQuery:
        self._filters.append(Equal(filter_or_field, value) if isinstance(filter_or_field, str) else filter_or_field)
        return self

    def top_k(self, k: int) -> VectorQuery:
        if k < 1:
            raise ValueError("k must be 1 at least")
        self._k = k
        return self

    def with_min_score(self, score: float) -> VectorQuery:
        self._least = score
        return self

    def with_ef_search(self, effort: int) -> VectorQuery:
        """Accepted and without effect: search is exact."""
        if effort < 1:
            raise ValueError("the effort must be 1 at least")
        self._effort = effort
        return self

    def to_df(self) -> DataFrame:
        rows = where(self._df, *self._filters, struct=self._struct)
        found = rows.withColumn("distance", distance_to(self._metric, F.col("vector"), self._vector))
        found = found.orderBy("distance", "id").limit(self._k).withColumn("score", 1 - F.col("distance"))
        return found.where(F.col("score") >= self._least) if self._least > 0 else found

    def to_list(self) -> list:
        return self.to_df().orderBy("distance", "id").collect()


#: Queries that are sent to every task at once (a tile has up to four times as many), and numbers in them, at most; the same for a tile of rows.
QUERIES, NUMBERS = 4_096, 4_194_304
#: Distances, and numbers of vectors, that are worked out at a time.
CELLS = 1 << 19


class Nearest:
    """The k nearest of the rows that have streamed past, for each of some queries: memory is bounded by the queries."""

    def __init__(self, metric: Metric, asking: np.ndarray, q: np.ndarray, k: int):
        self.metric, self.asking, self.q, self.k = metric, asking, q, k
        self.length = sums(q, q)
        self.best, self.ids = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if x.shape[1] != self.q.shape[1]:
            raise DimensionMismatch(self.q.shape[1], x.shape[1])
        length = sums(x, x)
        few = min(256, len(self.q))
        for a in range(0, len(x), step := max(1, CELLS // few)):
            for c in range(0, len(self.q), few):
                self._cell(slice(c, c + few), ids[a : a + step], x[a : a + step], length[a : a + step])

    def _cell(self, own: slice, ids: np.ndarray, x: np.ndarray, length: np.ndarray) -> None:
        """Matrix products tell what may be among the k nearest; those pairs are worked out one by one, so that equal vectors tie."""
        q, best = self.q[own], self.best[own]
        seems, last = self._seeming(q, self.length[own], x, length), best[:, -1]
        # How far a seeming distance may be off; lengths that are no numbers give distances that are exact.
        share = 4 * np.finfo(float).eps * (4 + x.shape[1])
        with np.errstate(all="ignore"):
            longest = np.where(np.isnan(length), 0, length).max(initial=0)
            off = share * {Metric.COSINE: np.ones(len(q)), Metric.DOT: np.sqrt(self.length[own] * longest), Metric.EUCLIDEAN: np.where(np.isfinite(last), last, 0)}[self.metric]
            off[np.isnan(off)] = np.inf
        may = seems <= (last + off)[:, None]
        if self.k < len(ids) and np.count_nonzero(may) > 4 * may.shape[0] * self.k:
            kth = np.partition(seems, self.k - 1, axis=1)[:, self.k - 1]
            if self.metric is Metric.EUCLIDEAN:
                off = share * kth
            may &= seems <= (kth + 2 * off)[:, None]
        who, row = np.nonzero(may)
        if not len(who):
            return
        step = max(1, CELLS // max(1, x.shape[1]))
        d = np.concatenate([pair_distances(self.metric, q[who[i : i + step]], x[row[i : i + step]], self.length[own][who[i : i + step]], length[row[i : i + step]]) for i in range(0, len(who), step)])
        keep = (d < last[who]) | ((d == last[who]) & (ids[row] < self.ids[own][who, -1]))
        who = np.concatenate([np.repeat(np.arange(len(q)), self.k), who[keep]])
        d, found = np.concatenate([best.ravel(), d[keep]]), np.concatenate([self.ids[own].ravel(), ids[row[keep]]])
        order = np.lexsort((found, d, who))
        who = who[order]
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < self.k]
        self.best[own], self.ids[own] = d[order].reshape(best.shape), found[order].reshape(best.shape)

    def _seeming(self, q: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances up to rounding; with fewer passes over them where lengths are neither tiny nor huge."""
        plain = [((v == 0) | ((v > 1e-100) & (v < 1e38))).all() for v in (a, b)]
        if self.metric is Metric.EUCLIDEAN or not all(plain):
            return distances(self.metric, q, x)
        if self.metric is Metric.COSINE:
            q, x = (v / np.sqrt(np.where(n == 0, 1, n))[:, None] for v, n in ((q, a), (x, b)))
            return np.subtract(1, near := q @ x.T, out=near)
        return -q @ x.T

    def found(self) -> Iterator[pa.RecordBatch]:
        for c in range(0, len(self.q), step := max(1, CELLS // self.k)):
            who, at = np.nonzero(np.isfinite(self.best[c : c + step]))
            yield pa.RecordBatch.from_arrays([pa.array(self.asking[c + who]), pa.array(self.ids[c + who, at]), pa.array(self.best[c + who, at])], ["query_id", "id", "distance"])


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most about CELLS numbers of its vectors."""
    step = max(1, CELLS * batch.num_rows // max(1, len(batch.column(column).flatten()))) if batch.num_rows else 1
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def knn_batch(rows: DataFrame, queries: DataFrame, k: int = 10, metric: Metric = Metric.COSINE) -> DataFrame:
    """The k nearest rows (id, vector) of every query (query_id, vector): query_id, id, distance, rank.

    Queries are counted.  As many as make one block go to every task, which
    reads its rows in place.  More of them never come to the driver: rows and
    queries are dealt to tiles, each worked out by one task, which keeps the
    tile's queries and streams the rows past them.  What is shuffled on is k
    rows a query and task, or tile.
    """
    found_ = "query_id long, id long, distance double"
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), "vector").where("id IS NOT NULL AND vector IS NOT NULL")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector IS NOT NULL")
    known = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not known["n"]:
        return spark.createDataFrame([], f"{found_}, rank int")
    block = max(1, min(QUERIES, NUMBERS // max(1, known["d"])))
    if known["n"] <= block:
        few = asked.toArrow().sort_by("query_id")
        sent = spark.sparkContext.broadcast((few["query_id"].to_numpy(), _matrix(few["vector"], few.num_rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Nearest(metric, *sent.value, k)
            for b in (part for batch in batches for part in _parts(batch, 1)):
                held.add(b.column(0).to_numpy(), _matrix(b.column(1), b.num_rows))
            yield from held.found()

        out = rows.mapInArrow(run, found_)
    else:
        width = max(1, NUMBERS // max(1, known["d"]))
        across, down = -(-known["n"] // min(4 * QUERIES, width)), -(-rows.count() // width) or 1
        if rows.schema["vector"].dataType != asked.schema["vector"].dataType:
            rows, asked = (df.withColumn("vector", F.col("vector").cast("array<double>")) for df in (rows, asked))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = rows.withColumn("_r", F.pmod(F.xxhash64("id", "vector"), F.lit(down))).withColumn("_q", every(across))
        right = asked.withColumn("_q", F.pmod(F.xxhash64("query_id", "vector"), F.lit(across))).withColumn("_r", every(down))
        tile, kind = (F.col("_r") * across + F.col("_q")).alias("_tile"), lambda i: F.lit(i).alias("_kind")
        both = right.select(tile, kind(0), F.col("query_id").alias("id"), "vector").unionByName(left.select(tile, kind(1), "id", "vector"))
        # More tasks than tiles, so that few tasks get several.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * across * down)
        dealt = both.repartition(tasks, "_tile").sortWithinPartitions("_tile", "_kind", "id")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, asks, held = None, [], None
            for b in (part for batch in batches for part in _parts(batch, 3)):
                key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
                cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), b.num_rows]
                for first, end in zip(cut, cut[1:]):
                    part = b.slice(first, end - first)
                    if at != key[first] // 2:
                        if held:
                            yield from held.found()
                        at, asks, held = key[first] // 2, [], None
                    some = part.column(2).to_numpy(zero_copy_only=False), _matrix(part.column(3), part.num_rows)
                    if key[first] % 2 == 0:
                        asks.append(some)
                        continue
                    if asks:
                        held, asks = Nearest(metric, *(np.concatenate(v) for v in zip(*asks)), k), []
                    if held:
                        held.add(*some)
            if held:
                yield from held.found()

        out = dealt.mapInArrow(search, found_)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)

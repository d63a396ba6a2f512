"""Approximate nearest neighbours by inner product: inverted lists, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals are fitted on a bounded
sample; every vector is then indexed: its list, one byte for each group of
dimensions, and itself for reranking.  A query probes the lists whose centroids
have the largest inner product with it.  Within a list, distances come from an
asymmetric table (one inner product for each group and code, looked up for all
vectors of the list), the best of each shard are reranked exactly in double
precision, and the best of all shards are merged.

How many lists to probe is measured, not guessed: some of the queries themselves
are held against every row, and the fewest lists are taken that hold ``RECALL``
of their true neighbours, and a share of ``LEAST`` for nearly each of them.  So it
does not matter whether queries are like the rows.  Clustered vectors need few
lists; vectors without structure need many.  A query whose lists hold too few
vectors probes on until there are enough for k neighbours.

Reranking loses nothing: with each vector goes a bound of what its code leaves
out, and all that may be among the k best by that bound are reranked.  Near
copies, whose codes are equal, and vectors that the sample did not foresee differ
only in how many are reranked.

Lists that lie near each other share a shard of at most about ``BLOCK`` vectors; a
larger list is cut into several shards.  Each vector is sent to its shard once,
each query to every shard that holds a list of its, once; the shard's task keeps
the vectors and streams the queries past them.  Only where a shard has more than
``QUERIES`` queries are its vectors sent several times, so a list that holds a
third of all vectors, or that most queries probe, does not land in one task.

Defined cases: vectors that are null, all zero, hold null or non-finite
components or have another dimension than most take no part, nor do rows with a
null id; rows that repeat an id are candidates each, but for queries of that
id; ties go to the smaller id; with fewer than k candidates all are returned; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors of the sample, and numbers in it, at most.
SAMPLE, SAMPLE_NUMBERS = 32_768, 4_194_304
LISTS = 4_096
#: Dimensions that one byte stands for come from this many groups, at most.
GROUPS = 32
#: Vectors of a shard, and numbers in them, at most about; queries of a shard that one task answers.
BLOCK, BLOCK_NUMBERS, QUERIES = 65_536, 4_194_304, 131_072
#: Vectors that a shard should have at least, and shards that there should be, so that small tables use several tasks.
SMALL, SHARDS = 4_096, 8
#: Reranked first for each neighbour wanted, of each shard; the k-th of them tells which others may be nearer.
RERANK = 3
#: Distances that are worked out at a time.
CELLS = 1 << 21
#: True neighbours to find: of all, and of each query but for one in twenty.
RECALL, LEAST = 0.97, 0.8
#: Queries on which that is measured, at most.
MEASURED = 256
#: How much the radius of a list counts in the order of probing, in units of a random direction's share of it: the best of these.
REACHES = (0.0, 0.5, 1.0, 2.0, 4.0)


@dataclass
class Index:
    """Everything that is fitted; its size is bounded by LISTS, GROUPS and the dimension."""

    centroids: np.ndarray  # lists by dimensions
    books: np.ndarray  # groups by codes by dimensions of a group
    scale: float  # times a vector is about 1 long

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector."""
        half = (self.centroids**2).sum(axis=1) / 2
        return np.concatenate([np.zeros(0, np.int64), *(np.argmax(part @ self.centroids.T - half, axis=1) for part in np.array_split(x, len(x) // 4096 + 1))])

    def grouped(self, x: np.ndarray) -> np.ndarray:
        """Vectors as groups of dimensions, filled up with zeros."""
        groups, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, groups * width - x.shape[1]))).reshape(len(x), groups, width)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest, out = self.grouped(x - self.centroids[lists]), np.empty((len(x), len(self.books)), np.uint8)
        for g, book in enumerate(self.books):
            out[:, g] = np.argmax(rest[:, g] @ book.T - (book**2).sum(axis=1) / 2, axis=1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, group and code the inner product."""
        return np.einsum("qgw,gcw->qgc", self.grouped(q), self.books)

    def approximate(self, q: np.ndarray, tables: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The inner product of each query with each vector, as far as its list and codes tell."""
        own, place = np.unique(lists, return_inverse=True)
        near = (q @ self.centroids[own].T).astype(np.float32)[:, place]
        for g in range(codes.shape[1]):
            near += tables[:, g][:, codes[:, g]]
        return near

    def left(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector, scaled: how far its inner product with a query of length 1 may be from the approximate one, and its distance from its centroid."""
        groups, _, width = self.books.shape
        rest = self.grouped((x - self.centroids[lists]) * self.scale)
        coded = np.stack([self.books[g][codes[:, g]] for g in range(groups)], axis=1) * self.scale if len(x) else np.zeros((0, groups, width))
        far = np.sqrt((rest**2).sum(axis=(1, 2)))
        middle = np.sqrt(((self.centroids[lists] * self.scale) ** 2).sum(axis=1))
        # Sums of up to GROUPS + 1 numbers of 32 bits are as exact as the second term says.
        return np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2))) * (1 + 1e-6) + 1e-5 * (far + middle + np.sqrt((coded**2).sum(axis=(1, 2)))), far


@dataclass
class Probing:
    """The order in which a query probes the lists, and how many of them."""

    held: np.ndarray  # vectors of each list
    reach: np.ndarray  # what is added to the inner product of a query of length 1 with each centroid
    probes: int

    def order(self, index: Index, q: np.ndarray) -> np.ndarray:
        return np.argsort(-np.where(self.held > 0, unit(q) @ index.centroids.T * index.scale + self.reach, -np.inf), axis=1, kind="stable")


def unit(q: np.ndarray) -> np.ndarray:
    """Vectors at length 1."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return q / np.sqrt((q**2).sum(axis=1, keepdims=True))


def probing(index: Index, held: np.ndarray, radius: np.ndarray, q: np.ndarray, asking: np.ndarray, lists: np.ndarray, recall: float = RECALL) -> Probing:
    """The order that needs the fewest vectors, from queries q and, for each true neighbour, its query's place in q and its list."""
    found, share = [], 1 / np.sqrt(index.centroids.shape[1])
    for reach in REACHES if len(lists) else REACHES[:1]:
        p = Probing(held, reach * share * radius, 1)
        order = p.order(index, q)
        place = np.argsort(order, axis=1)[asking, lists]
        if len(place):
            alone = [np.sort(place[asking == i]) for i in np.unique(asking)]
            alone = np.sort([x[int(np.ceil(LEAST * len(x))) - 1] for x in alone])
            p.probes = 1 + int(max(np.sort(place)[int(np.ceil(recall * len(place))) - 1], alone[int(np.ceil(0.95 * len(alone))) - 1]))
        found.append((int(held[order[:, : p.probes]].sum()), p))
    return min(found, key=lambda f: f[0])[1]


def kmeans(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    centres = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        half = (centres**2).sum(axis=1) / 2
        own = np.concatenate([np.argmax(part @ centres.T - half, axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
        if (empty := np.flatnonzero(count == 0)).size:
            centres[empty] = x[r.integers(0, len(x), len(empty))]
    return centres


def fit(x: np.ndarray, rows: int, seed: int = 11) -> Index:
    """An index for ``rows`` vectors, from a sample of them."""
    r = np.random.default_rng(seed)
    lists = int(np.clip(np.sqrt(rows), 1, max(1, min(LISTS, len(x) // 8))))
    peak = np.abs(x).max()
    index = Index(kmeans(x, lists, 10, r), np.zeros((1, 1, x.shape[1])), float(1 / (peak * np.sqrt(((x / peak) ** 2).sum(axis=1).mean()))))
    own = index.lists(x)
    width = -(-x.shape[1] // GROUPS)
    index.books = np.zeros((-(-x.shape[1] // width), min(256, len(x)), width))
    rest = index.grouped(x - index.centroids[own])[: 1 << 13]
    index.books = np.stack([kmeans(rest[:, g], min(256, len(rest)), 8, r) for g in range(rest.shape[1])])
    return index


def dealt(index: Index, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first shard and the number of shards it is cut into; lists that share a shard lie near each other."""
    most = max(1, min(BLOCK, BLOCK_NUMBERS // index.centroids.shape[1], max(SMALL, -(-n // SHARDS))))
    groups = kmeans(index.centroids, int(np.clip(n // most, 1, len(counts))), 4, np.random.default_rng(5))
    near = np.argmax(index.centroids @ groups.T - (groups**2).sum(axis=1) / 2, axis=1)
    first, parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // most))
    shard, held = 0, 0
    for i in np.argsort(near, kind="stable").tolist():
        if held and (parts[i] > 1 or held + counts[i] > most):
            shard, held = shard + 1, 0
        first[i], held = shard, held + int(counts[i])
        if parts[i] > 1:
            shard, held = shard + int(parts[i]), 0
    return first, parts


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """For each query (id, vector) its k nearest of rows (id, vector): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, n = sizes["d"], sizes["n"]
    rows = rows.where(F.size("vector") == dimension)
    queries = queries.where(F.col("id").isNotNull() & usable(F.col("vector")) & (F.size("vector") == dimension))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // dimension))).select("vector").toArrow()
    sent = spark.sparkContext.broadcast(fit(matrix(some["vector"], some.num_rows), n))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // 2 // dimension)
        for b in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            x = matrix(b.column(1), b.num_rows)
            own = sent.value.lists(x)
            codes = sent.value.codes(x, own)
            slack, far = sent.value.left(x, own, codes)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1), pa.array(slack), pa.array(far)], ["list", "id", "codes", "vector", "slack", "far"])

    kind = rows.schema["vector"].dataType.simpleString()
    indexed = staged(rows.select("id", "vector").mapInArrow(assign, f"list int, id long, codes binary, vector {kind}, slack double, far double"), "index")
    lists = indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # LISTS rows at most
    held, radius = np.zeros(len(sent.value.centroids), np.int64), np.zeros(len(sent.value.centroids))
    for of in lists:
        held[of["list"]], radius[of["list"]] = of["n"], of["far"]
    asks = queries.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MEASURED, SAMPLE_NUMBERS // dimension))).select("id", "vector").toArrow()
    if not asks.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some_q = matrix(asks["vector"], asks.num_rows)
    true = truth(indexed, asks["id"].to_numpy(), some_q, k).toArrow()
    way = probing(sent.value, held, radius, some_q, true["query"].to_numpy(), true["list"].to_numpy(), recall)
    shards = spark.sparkContext.broadcast((way, *dealt(sent.value, held, n)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, first, parts = shards.value
        held = way.held
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                q = matrix(b.column(1), b.num_rows)
                order = way.order(sent.value, q)
                # On beyond the usual number until there are k candidates besides the query's own rows.
                least = np.minimum(k + np.maximum(b.column(2).to_numpy(), 1), held.sum())
                many = np.maximum(np.argmax(np.cumsum(held[order], axis=1) >= least[:, None], axis=1) + 1, way.probes)
                row, to, lists = [], [], []
                for i, (own, m) in enumerate(zip(order, many)):
                    own = np.sort(own[:m]).astype(np.int32)
                    of = np.repeat(first[own], parts[own]) + np.concatenate([np.arange(p) for p in parts[own]])
                    own = np.repeat(own, parts[own])
                    for shard in np.unique(of).tolist():
                        row.append(i)
                        to.append(shard)
                        lists.append(own[of == shard].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column(0).take(pa.array(row)), pa.array(lists, pa.binary()), b.column(1).take(pa.array(row))], ["shard", "id", "lists", "vector"])

    own_rows = indexed.groupBy("id").agg(F.count("*").alias("own"))
    asking = queries.select("id", "vector").join(own_rows, "id", "left").select("id", "vector", F.coalesce("own", F.lit(0)).alias("own"))
    probed = staged(asking.mapInArrow(probe, f"shard long, id long, lists binary, vector {kind}"), "probes")
    # Shards that more queries probe than one task should answer: their number is bounded by that of all probes.
    asked = staged(probed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > QUERIES).select("shard", F.ceil(F.col("n") / F.lit(QUERIES)).cast("int").alias("asks")), "asked")
    first, parts = (F.get(F.array(*[F.lit(int(v)) for v in x]), F.col("list")) for x in shards.value[1:])
    of = indexed.withColumn("shard", (first + F.pmod(F.xxhash64("id", F.col("vector")), parts)).cast("long")).join(asked, "shard", "left")
    of = of.withColumn("ask", F.explode(F.sequence(F.lit(0), F.coalesce("asks", F.lit(1)) - 1)))
    asks = probed.join(asked, "shard", "left").withColumn("ask", F.pmod(F.xxhash64("id"), F.coalesce("asks", F.lit(1))).cast("int"))
    none = lambda t: F.lit(None).cast(t)
    both = of.select("shard", "ask", F.lit(0).alias("query"), "list", "id", "codes", none("binary").alias("lists"), "vector", "slack")
    both = both.unionByName(asks.select("shard", "ask", F.lit(1).alias("query"), none("int").alias("list"), "id", none("binary").alias("codes"), "lists", "vector", none("double").alias("slack")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(shards.value[2].sum()))
    cells = both.repartition(tasks, "shard", "ask").sortWithinPartitions("shard", "ask", "query", "list", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shard(sent.value, k)
        for batch in batches:
            key = [batch.column(i).to_numpy() for i in range(3)]
            cut = np.flatnonzero(np.concatenate([[True], *[np.any([x[1:] != x[:-1] for x in key], axis=0)]])) if batch.num_rows else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                held.turn(int(key[0][a]), int(key[1][a]))
                if key[2][a] == 0:
                    held.add(part)
                else:
                    yield from held.answer(part)

    found = cells.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def truth(indexed: DataFrame, asking: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The lists of the k nearest of all rows for each of a few queries: query (its place in q), list."""
    sent = indexed.sparkSession.sparkContext.broadcast((asking, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, q = sent.value
        best = [np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int32)]
        for batch in batches:
            for b in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                ids, lists = b.column(1).to_numpy(), b.column(0).to_numpy()
                score = q @ matrix(b.column(2), b.num_rows).T
                score[asking[:, None] == ids] = -np.inf  # a query's own rows take no part
                of = np.argpartition(-score, min(k, b.num_rows) - 1, axis=1)[:, :k]
                all_ = [np.concatenate([x, y], axis=1) for x, y in zip(best, (np.take_along_axis(score, of, axis=1), ids[of], lists[of]))]
                order = np.lexsort((all_[1], -all_[0]))[:, :k]
                best = [np.take_along_axis(x, order, axis=1) for x in all_]
        who, at = np.nonzero(best[0] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), *(pa.array(x[who, at]) for x in best)], ["query", "score", "id", "list"])

    found = indexed.select("list", "id", "vector").mapInArrow(run, "query int, score double, id long, list int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "list")


class Shard:
    """The vectors of one shard, which its queries stream past: memory is bounded by the shard."""

    def __init__(self, index: Index, k: int):
        self.index, self.k, self.key, self.parts, self.rows = index, k, None, [], None

    def turn(self, shard: int, ask: int) -> None:
        """To the next shard, if it is another one."""
        if self.key != (shard, ask):
            self.key, self.parts, self.rows = (shard, ask), [], None

    def add(self, part: pa.RecordBatch) -> None:
        codes = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(part.num_rows, -1)
        self.parts.append((part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(), codes, matrix(part.column(7), part.num_rows), part.column(8).to_numpy().astype(np.float32)))

    def answer(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.rows is None:
            if not self.parts:
                return
            self.rows = [np.concatenate(x) for x in zip(*self.parts)]
            self.parts = []
            lists = self.rows[0]
            self.first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        for a in range(0, part.num_rows, 64):
            some = part.slice(a, 64)
            yield self._nearest(some.column(4).to_numpy(), matrix(some.column(7), some.num_rows), [np.frombuffer(x, np.int32) for x in some.column(6).to_pylist()])

    def _nearest(self, asking: np.ndarray, q: np.ndarray, probes: list[np.ndarray]) -> pa.RecordBatch:
        (lists, ids, codes, x, slack), k, n = self.rows, self.k, len(self.rows[1])
        scaled = unit(q) * self.index.scale
        tables = self.index.tables(scaled).astype(np.float32)
        of = np.zeros((len(q), len(self.index.centroids)), bool)
        for i, own in enumerate(probes):
            of[i, own] = True
        valid, near = np.zeros((len(q), n), bool), np.full((len(q), n), -np.inf, np.float32)
        for a, b in zip(self.first.tolist(), [*self.first[1:].tolist(), n]):
            who = np.flatnonzero(of[:, lists[a]])
            step = max(1, CELLS // max(1, len(who)))
            for c in range(a, b, step) if len(who) else ():
                d = min(b, c + step)
                valid[who, c:d] = asking[who][:, None] != ids[None, c:d]  # a query's own rows take no part
                near[who, c:d] = self.index.approximate(scaled[who], tables[who], lists[c:d], codes[c:d])
        near[~valid] = -np.inf
        # The exact k-th best of those that seem best: what can't be as near by its bound is left out, all else is reranked.
        last = np.full(len(q), -np.inf)
        if n >= k:
            row = np.argpartition(-near, min(n, RERANK * k) - 1, axis=1)[:, : RERANK * k]
            score = np.where(np.take_along_axis(valid, row, axis=1), self._exact(q, np.repeat(np.arange(len(q)), row.shape[1]), row.ravel()).reshape(row.shape), -np.inf)
            last = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        size = np.sqrt((q**2).sum(axis=1))
        with np.errstate(all="ignore"):
            least = last / np.abs(q).max(axis=1) * self.index.scale * (np.abs(q).max(axis=1) / size)
            least = (least - 1e-6 * np.abs(least)).astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // 4 // len(q))
        for a in range(0, n, step):
            part = slice(a, min(n, a + step))
            with np.errstate(all="ignore"):
                may = valid[:, part] & ~(near[:, part] + slack[part] < least[:, None])
                if 16 * np.count_nonzero(may) > may.size:  # too many to look up each: matrix products first
                    lengths = np.sqrt((x[part] ** 2).sum(axis=1))
                    may &= ~(q @ x[part].T < last[:, None] - 1e-15 * x.shape[1] * size[:, None] * lengths)
            who, row = np.nonzero(may)
            score = self._exact(q, who, row + a)
            keep = score >= last[who]
            found.append((who[keep], row[keep] + a, score[keep]))
        who, row, score = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, row, score = who[keep], row[keep], score[keep]
        return pa.RecordBatch.from_arrays([pa.array(asking[who]), pa.array(ids[row]), pa.array(score)], ["query_id", "vec_id", "score"])

    def _exact(self, q: np.ndarray, who: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The inner products of pairs of a query and a row, the same wherever a pair stands."""
        x, step = self.rows[3], max(1, CELLS // q.shape[1])
        return np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", x[row[i : i + step]], q[who[i : i + step]]) for i in range(0, len(who), step))])

"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of word n-grams (shingles), as 64-bit hashes.  If two sets of
sizes x and y have a Jaccard similarity of at least t, then, under any one
order of all shingles, the first x - ceil(t x) + k of one and the first
y - ceil(t y) + k of the other share at least k shingles, for every k.  A longer
prefix asks for correspondingly more matches.  The join uses this twice.

1. Screening, over the whole corpus: prefixes in hash order with k a tenth of
   the set.  Prefixes are dealt to buckets in packed blocks (no row a shingle);
   a bucket finds which shingles occur in two texts or more and sends counts
   back.  A shingle that several texts of a block share is counted there and
   sent once a block, however many texts hold it.  A set with fewer such
   shingles in its prefix than the k of its smallest possible partner cannot
   link to anything and is done.
2. Joining, over the rest: shingles ordered from rare to frequent, so prefixes
   hold rare ones.  Each set picks its own k, by the estimated cost of the
   candidates that its prefix would meet (postings read, and sets to verify);
   a pair is verified if it shares min(k of either) prefix shingles, or more
   where its sizes ask for more.

What is known of a shingle (how many sets hold it, its hub, its components) is
aggregated before it is shuffled and joined back from a written table, so that
adaptive execution splits a shingle that very many sets hold.

Equal sets are one class from the start (one row each).  Groups of near copies
are not expanded into pairs either: each set is first verified against the one
set that is the least of most of its prefix shingles' postings, links become
components, and only sets of different components that share enough prefix
shingles are verified further.  No pair of different components that might link
is left out, so components are exact.

Defined cases: null text counts as empty; a text with fewer words than n is one
shingle of all its words; without words its set is empty and it links with
nothing, not even with other empty ones; a null doc_id has no component; rows
that share a doc_id are one node with all their texts' links; repeated rows are
returned as often as they occur; a very long text is one set, held by one task
at a time; an empty table gives an empty result; further columns are ignored
(``representatives`` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import free_name, fresh_path, join_ids, map_texts, remove, staged, text_of
from .components import components

#: Bytes of text that a bucket of the screening stands for.
BUCKET_BYTES = 16 << 20
#: Texts of a block (their numbers take 16 bits).
CHUNK = 1 << 15
#: k that a set may pick in the join.
CHOICES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Members of a pair's side that share one copy of the other's shingles.
SHARED = 5_000
PLACE = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, end to end, and n + 1 offsets."""
    words, bounds = textnum.words(column)
    count = np.diff(bounds)
    odd = [np.uint64(pow(int(PLACE), k + 1, 2**64)) for k in range(n)]
    full = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        full += words[k : k + len(full)] * odd[k]
    full = textnum.mix(full)
    parts, sizes = [], np.zeros(len(count), np.int64)
    for i, (a, c) in enumerate(zip(bounds[:-1].tolist(), count.tolist())):
        if c >= n:
            own = np.unique(full[a : a + c - n + 1])
        elif c:
            own = textnum.mix(np.array([sum(int(w) * int(odd[k]) for k, w in enumerate(words[a : a + c])) + c & 2**64 - 1], np.uint64))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles, as two signed numbers."""
    a = int(np.bitwise_xor.reduce(textnum.mix(own * PLACE + np.uint64(len(own)))))
    b = int(np.add.reduce(textnum.mix(own ^ PLACE), dtype=np.uint64))
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b))


def least_overlap(size, percent: int):
    """ceil(percent * size / 100)."""
    return -(-size * percent // 100)


def screened_k(size: int) -> int:
    """The k of a set's prefix in the screening: a tenth of the set, 1 at least."""
    return max(1, size // 10)


PROFILE = "kind int, bucket int, chunk long, ordinal int, doc_id long, n long, d1 long, d2 long, known int, fps binary, ordinals binary"
#: The ordinal of a shingle whose texts know already that it is shared.
NOBODY = 0xFFFF


def profile(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """One pass over the texts: a row a document (kind 0: its set's size and digest, and how many of its prefix
    shingles other texts of its chunk share), and packed prefixes by bucket (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("ordinal", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n", "d1", "d2")), ("known", pa.int32()), ("fps", pa.binary()), ("ordinals", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, rows, size = TaskContext.get().partitionId() << 32, [], [], 0
        seen: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            known = np.zeros(len(rows), np.int64)
            packed = []
            if held:
                fps, ordinals = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                order = np.argsort(fps, kind="stable")
                fps, ordinals = fps[order], ordinals[order]
                first = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]]))
                times = np.diff(np.append(first, len(fps)))
                known = np.bincount(ordinals[np.repeat(times > 1, times)], minlength=len(rows))
                fps, ordinals = fps[first], np.where(times > 1, NOBODY, ordinals[first]).astype(np.uint16)
                to = (fps % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                fps, ordinals, to = fps[order], ordinals[order], to[order]
                at = np.flatnonzero(np.diff(to, prepend=-1))
                packed = [(int(to[a]), fps[a:b].tobytes(), ordinals[a:b].tobytes()) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(to)])]
            full = [(0, None, chunk, i, *row, int(k), None, None) for i, (row, k) in enumerate(zip(rows, known))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full), schema.types)], schema=schema)
            for bucket, f, o in packed:
                yield pa.RecordBatch.from_pylist([{"kind": 1, "bucket": bucket, "chunk": chunk, "fps": f, "ordinals": o}], schema)

        for part in textnum.parts(batches, "text"):
            sets, bounds = shingles(part.column(1), n)
            for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = sets[a:b]
                d1, d2 = digest(own) if b > a else (0, 0)
                if b > a and (d1, d2) not in seen:  # a task sends each set once
                    seen.add((d1, d2))
                    prefix = own[: len(own) - least_overlap(len(own), percent) + screened_k(len(own))]
                    held.append((prefix, np.full(len(prefix), len(rows), np.uint16)))
                    size += len(prefix)
                rows.append((doc, b - a, d1, d2))
                if len(rows) == CHUNK or size > 1 << 21:
                    yield from flush()
                    chunk, held, rows, size = chunk + 1, [], [], 0
            if len(seen) > 200_000:
                seen.clear()
        if rows:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_texts(rows, run, PROFILE)


def screened(blocks: DataFrame) -> DataFrame:
    """chunk, ordinal and matched: how many prefix shingles of each set occur in the prefix of a set of another chunk too
    (without those that its own chunk knows of)."""

    def shared(table: pa.Table) -> pa.Table:
        fps = np.concatenate([np.frombuffer(x, np.uint64) for x in table["fps"].to_pylist()])
        ordinals = [np.frombuffer(x, np.uint16) for x in table["ordinals"].to_pylist()]
        block = np.repeat(np.arange(len(ordinals)), [len(x) for x in ordinals])
        ordinals = np.concatenate(ordinals)
        order = np.argsort(fps)
        fps = fps[order]
        same = np.zeros(len(fps) + 1, bool)
        same[1:-1] = fps[1:] == fps[:-1]
        hit = order[same[1:] | same[:-1]]
        hit = hit[ordinals[hit] != NOBODY]
        key = np.sort(block[hit].astype(np.int64) << 16 | ordinals[hit])
        key, count = np.unique(key, return_counts=True)
        chunks = table["chunk"].to_numpy()
        at = np.searchsorted(key >> 16, np.arange(len(chunks) + 1))
        rows = [(int(c), (key[a:b] & 0xFFFF).astype(np.uint16).tobytes(), count[a:b].astype(np.uint32).tobytes()) for c, a, b in zip(chunks, at[:-1], at[1:]) if b > a]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "ordinals": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for o, c in zip(table["ordinals"].to_pylist(), table["counts"].to_pylist()):
            total[np.frombuffer(o, np.uint16)] += np.frombuffer(c, np.uint32)  # an ordinal occurs once in a row
        found = np.flatnonzero(total)
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * len(found), pa.int64()), "ordinal": pa.array(found, pa.int32()), "matched": pa.array(total[found], pa.int64())})

    some = blocks.select("bucket", "chunk", "fps", "ordinals").groupBy("bucket").applyInArrow(shared, "chunk long, ordinals binary, counts binary")
    return some.groupBy("chunk").applyInArrow(added, "chunk long, ordinal int, matched long")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, digest and shingles of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textnum.parts(batches, "text"):
            sets, bounds = shingles(part.column(1), n)
            both = [digest(sets[a:b]) if b > a else (0, 0) for a, b in zip(bounds[:-1], bounds[1:])]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), *(pa.array([d[i] for d in both], pa.int64()) for i in (0, 1)), lists], ["doc_id", "n", "d1", "d2", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_texts(rows, run, "doc_id long, n long, d1 long, d2 long, tokens array<long>")


def sql_overlap(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / F.lit(100.0)).cast("int") if percent % 100 else size


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """The prefix of every set that may link: token, cid, n, the k that it picks, reach and hub.

    reach is the largest size of a partner: with u shingles that no other set
    has, at most n - u are shared, and n - u >= t / (1 + t) (n + size) bounds
    the size.  hub is the mean frequency of a set's shingles: of near copies
    of one text, those with the fewest changes have the highest.
    """
    rows = sets.select("cid", "n", F.explode("tokens").alias("token"))
    rows = rows.join(staged(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies"), "token")
    own = rows.groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    least = F.expr(f"cast(n * {percent} div 100 + if(n * {percent} % 100 > 0, 1, 0) as int)")
    # Shingles that no other set has come first in the order and never match.
    own = own.withColumn("_spare", F.size("shared") - least).where("_spare >= 0").withColumn("_least", least)
    read = lambda k: F.aggregate(F.slice("shared", F.lit(1), F.col("_spare") + k), F.lit(0).cast("long"), lambda a, x: a + x["df"])
    # Postings that a prefix of k reads, and sets that share k of it (at most postings / k), each of which costs a merge.
    cost = [F.when(F.col("_least") >= k, F.struct((read(k) + (read(k) / k) * F.col("n")).alias("cost"), F.lit(k).alias("k"))) for k in CHOICES]
    own = own.withColumn("k", F.least(*cost)["k"])
    own = own.withColumn("reach", F.expr(f"size(shared) * {100 + percent} div {percent} - n"))
    own = own.withColumn("hub", F.aggregate("shared", F.lit(0).cast("long"), lambda a, x: a + x["df"]) / F.col("n"))
    return own.select("cid", "n", "k", "reach", "hub", F.explode(F.slice("shared", F.lit(1), F.col("_spare") + F.col("k"))["token"]).alias("token"))


def near(a: str, b: str, percent: int) -> Column:
    """Whether two sets may link as far as their sizes tell."""
    x, y = f"{a}.n", f"{b}.n"
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (F.col(x) <= F.col(f"{b}.reach")) & (F.col(y) <= F.col(f"{a}.reach"))


def enough(shared: Column, percent: int) -> Column:
    """Whether a pair (a, b) may link that shares so many prefix shingles.

    Of two prefixes, the one that ends first in the order lacks in the other
    set what it lacks in the other prefix.  Beyond its prefix it has
    ceil(t n) - k shareable shingles, so no more are shared than those and the
    ones in the prefixes; a link takes t / (1 + t) of both sizes.
    """
    beyond = lambda x: F.expr(f"({x}.n * {percent} + 99) div 100 - {x}.k")
    return shared + F.greatest(beyond("a"), beyond("b")) >= F.expr(f"({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent}")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. b may be common to many pairs: its shingles are sent once a part of them."""
    many = pairs.groupBy("b").agg(F.count("*").alias("_m")).withColumn("_parts", F.ceil(F.col("_m") / F.lit(SHARED)).cast("int"))
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")).join(many, "b").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    left = pairs.join(many.select("b", "_parts"), "b").withColumn("_part", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int"))
    both = left.select("a", "b", "_part").join(right.select("b", "_part", "tb"), ["b", "_part"]).join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("_i", shared).where((100 * F.col("_i")) >= percent * (F.size("ta") + F.size("tb") - F.col("_i"))).select("a", "b").distinct()


def link_components(sets: DataFrame, percent: int) -> DataFrame:
    """node and component of all sets (cid, n, tokens) that link to one of a lower cid, directly or not."""
    posted = staged(postings(sets, percent), "postings")
    # Each token names the best hub of its postings; a set is verified against the one that most of its tokens name.
    own = F.struct("n", "reach", "k")
    hubs = staged(posted.groupBy("token").agg(F.max(F.struct("hub", (-F.col("cid")).alias("minus"), "n", "reach", "k")).alias("b")), "hubs")
    named = posted.select("token", "cid", own.alias("a")).join(hubs, "token").withColumn("_to", -F.col("b.minus")).where((F.col("_to") != F.col("cid")) & near("a", "b", percent))
    named = named.groupBy("cid", "_to").agg(F.count("*").alias("m"), F.first(F.least("a.k", "b.k")).alias("k")).where("m >= k")
    best = named.groupBy("cid").agg(F.max(F.struct("m", (-F.col("_to")).alias("minus"))).alias("x")).select(F.col("cid").alias("a"), (-F.col("x.minus")).alias("b"))
    stars = components(verified(best, sets, percent))
    # What is left: sets of different components that share enough.
    rows = posted.join(stars, posted["cid"] == stars["node"], "left").select("token", "cid", "n", "k", "reach", F.coalesce("component", "cid").alias("comp"))
    parts = rows.groupBy("token", "comp").agg(F.count("*").alias("_in"))
    apart = parts.groupBy("token").agg(F.max(F.struct("_in", "comp"))["comp"].alias("_largest"), F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    apart = staged(apart.where("_low <> _high").select("token", "_largest"), "apart")
    rows = staged(rows.join(apart, "token").select("token", "cid", "n", "k", "reach", "comp", (F.col("comp") == F.col("_largest")).alias("largest")), "crossing")
    rows = rows.join(rows.groupBy("cid").agg(F.collect_set("token").alias("prefix")), "cid")
    # A token's largest component meets the others; those meet each other.  A pair
    # comes out once, at the least token that its prefixes share, if they share enough.
    a, b = rows.where("NOT largest").alias("a"), rows.alias("b")
    shared = F.array_intersect("a.prefix", "b.prefix")
    apart = (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & (F.col("b.largest") | (F.col("a.cid") < F.col("b.cid"))) & near("a", "b", percent)
    met = a.join(b, apart & enough(F.size(shared), percent) & (F.array_min(shared) == F.col("a.token")))
    second = verified(met.select(F.greatest("a.cid", "b.cid").alias("a"), F.least("a.cid", "b.cid").alias("b")).distinct(), sets, percent)
    return components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))


def classed(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What links: rows (doc_id, n, d1, d2) of all documents, classes of equal sets (d1, d2, id, cid, last: its number,
    its least and its greatest doc_id), and links (node, component) between the classes' numbers."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(64, -(-size // BUCKET_BYTES))
    path = fresh_path(spark, "profile")
    profile(docs, n, percent, buckets).write.parquet(path)
    table = spark.read.parquet(path)
    rows = staged(table.where("kind = 0").select("doc_id", "n", "d1", "d2", "chunk", "ordinal", "known"), "sets")
    matched = screened(table.where("kind = 1"))
    # A pair shares as many as the smaller k of the two; the smallest partner has ceil(t n) shingles.
    some = rows.join(matched, ["chunk", "ordinal"], "left").withColumn("_shared", F.coalesce("matched", F.lit(0)) + F.col("known"))
    some = some.where(F.col("_shared") >= F.greatest(F.lit(1), F.expr(f"(n * {percent} + 99) div 100 div 10"))).select("d1", "d2").distinct()
    rows = rows.select("doc_id", "n", "d1", "d2")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("cid"), F.max("doc_id").alias("last"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    some = staged(classes.join(some, ["d1", "d2"]).select("d1", "d2", "id", "cid"), "screened")
    remove(spark, path)  # the largest of what is staged
    texts = join_ids(docs, staged(some.select(F.col("cid").alias("doc_id")).distinct(), "ids"), "left_semi")
    sets = full_sets(texts, n).join(some.drop("cid"), ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select(F.col("id").alias("cid"), "n", "tokens")
    return rows, classes, link_components(staged(sets, "tokens"), percent)


def labelled(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """The classes of components of several classes (d1, d2, id), with the component's first class: least (its least
    doc_id, the component's too) and first (its number)."""
    nodes = linked.select("component", F.col("node").alias("id")).unionByName(linked.select("component", F.col("component").alias("id")).distinct())
    nodes = nodes.join(classes, "id").select("component", "id", "d1", "d2", "cid")
    label = staged(nodes.groupBy("component").agg(F.min(F.struct("cid", "id")).alias("x")).select("component", F.col("x.cid").alias("least"), F.col("x.id").alias("first")), "labels")
    return nodes.drop("cid").join(label, "component").drop("component")


def with_class(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Left join of documents with what is known of their classes; a class that very many share is spread."""
    salted = moved.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, ["d1", "d2", "_salt"], "left").drop("_salt")


def jaccard_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    rows, classes, linked = classed(docs, n, percent)
    # A doc_id with several texts ties their classes together.
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    several = real.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("_low"), F.max(F.struct("d1", "d2")).alias("_high")).where("_low <> _high").select("doc_id")
    several = staged(several, "several")
    if several.limit(1).count():
        texts = real.join(several, "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct().join(classes, ["d1", "d2"]).select("doc_id", "id")
        ties = texts.join(texts.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").where("b <> id").select(F.col("id").alias("a"), "b")
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(ties))
    # Classes whose documents do not all stand for themselves; every other document is its own component.
    moved = classes.join(labelled(classes, linked).select("id", "least"), "id", "left").where("least IS NOT NULL OR cid <> last").select("d1", "d2", F.coalesce("least", "cid").alias("component_id"))
    out = with_class(rows, moved)
    own_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"))


def digested(docs: DataFrame, n: int, names: list[str]) -> DataFrame:
    """The documents, as they are, with their set's size and digest in columns of three further names."""
    text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textnum.parts(batches, "text"):
            sets, bounds = shingles(part.column(text), n)
            both = [digest(sets[a:b]) if b > a else (0, 0) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), *(pa.array([d[i] for d in both], pa.int64()) for i in (0, 1))], [*part.schema.names, *names])

    return map_texts(docs, run, schema)


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of texts that link, that of the least doc_id; every other column as it is.

    Texts are what links: different texts that share a doc_id stay both unless
    they link.  Of equal texts of one doc_id one row stays.  Documents without
    words and rows without a doc_id link with nothing and stay.
    """
    rows, classes, linked = classed(docs, n, percent)
    found = classes.join(labelled(classes, linked).select(F.col("id").alias("_id"), "least", "first"), F.col("id") == F.col("_id"), "left")
    moved = found.where("least IS NOT NULL OR cid <> last").select("d1", "d2", F.coalesce("least", "cid").alias("least"), (F.coalesce("first", "id") == F.col("id")).alias("chosen"))
    judged = with_class(rows.where("doc_id IS NOT NULL"), moved).withColumn("stays", F.expr("n = 0 OR least IS NULL OR (chosen AND doc_id = least)"))
    # Nearly all doc_ids have one row, which the id alone tells; rows of the others are told apart by their digests.
    of_id = judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("stays").alias("stays"))
    told = staged(of_id.where("rows > 1 OR NOT stays"), "told")
    kept = join_ids(docs, told.select("doc_id"), "left_anti").select(*docs.columns)
    several = told.where("rows > 1").select("doc_id")
    if not several.limit(1).count():
        return kept
    size, a, b, key = (free_name(docs, c) for c in ("_n", "_d1", "_d2", "_key"))
    twice = digested(join_ids(docs, several, "left_semi").select(*docs.columns), n, [size, a, b])
    stay = judged.where("stays AND n > 0").join(several, "doc_id", "left_semi").select("doc_id", F.col("d1").alias(a), F.col("d2").alias(b)).distinct()
    chosen = twice.where(F.col(size) > 0).join(stay, ["doc_id", a, b], "left_semi")
    # Of equal texts one row, by order of a hash of the whole row; found before rows are shuffled.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [F.col(f"`{c}`").cast("string") for c, kind in docs.dtypes if not kind.startswith(("map", "variant", "array", "struct"))]
    one = chosen.groupBy("doc_id", a, b).agg(F.min_by(whole, F.xxhash64(*plain)).alias(key)).select(f"{key}.*")
    return kept.unionByName(twice.where(F.col(size) == 0).select(*docs.columns)).unionByName(one)

"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t from 0 to 1, piecewise
linear between knots: its class's weight times its class's schedule.  Its
integral is the source's cumulative token demand; the mean over [0, 1] is the
weight that its target is worked out with.  A source's documents stand in a
random but fixed order, passes one after another; a document's cumulative words,
as a share of the target, are inverted through the integral to the time at which
training reaches it.  Sorting by that time (a range sort) gives the mixture, in
which at every moment sources appear in the proportions of the schedule.

Targets: sources (by code point, null last) share all words by weight, a target
stops at ``most`` times its source's size, and what is over is shared by weight
among the others until none is above.  Whole passes are taken as often as they
fit; of the last pass documents are taken in order until the target is reached,
the last of them in part (its first words), so taken words equal the target,
rounded.

``mixed`` gives that mixture; ``report`` makes it and states of each document
what is in it: the words counted in its passes there, and when and where in the
order of training the first of them comes.  ``plan`` only works out the plan.

Running sums use equal buckets of the fixed order within each source: sums of
buckets first, then places within a bucket, so a source with a third of all
rows is spread over as many tasks as it needs.

Defined cases: null text has size 0; a very long text is counted, and cut, whole
within one task; null source is a source; documents without words are taken 0
times; repeated rows count separately; rows with the same
doc_id stand next to each other in the order; an empty table gives an
empty result; further columns are kept by ``mixed``
(whatever their names) and ignored by ``plan`` and ``report``; passes of one
time stand by doc_id, pass and source; a document that is not taken has no start
and no place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, null_key, staged, text_of

WEIGHTS = (5.0, 2.0, 1.0)
#: Times, and for each weight class its schedule's values there: heavy sources fade, light ones rise.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.4, 1.0, 0.6), (1.0, 1.0, 1.0), (0.6, 1.0, 1.4))
#: Documents of a source that one task puts in order.
BUCKET = 2_000


def words(text: str | Column = "text") -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text_of(text), F.lit(WORD)), F.lit(0)).cast("long")


def mean(schedule: Sequence[float], knots: Sequence[float]) -> float:
    """The mean of a schedule: its integral over all its time."""
    return sum((b - a) * (v + w) / 2 for a, b, v, w in zip(knots, knots[1:], schedule, schedule[1:])) / (knots[-1] - knots[0])


def demand(schedule: Sequence[float], knots: Sequence[float]) -> list[tuple[float, float, float, float, float]]:
    """(share of demand before, its end, start time, start value, slope) of each segment, demand scaled to 1 over all."""
    areas = [(b - a) * (v + w) / 2 for a, b, v, w in zip(knots, knots[1:], schedule, schedule[1:])]
    out, at, whole = [], 0.0, sum(areas)
    for area, a, b, v, w in zip(areas, knots, knots[1:], schedule, schedule[1:]):
        out.append((at, at + area / whole, a, v / whole, (w - v) / (b - a) / whole))
        at += area / whole
    return out


def time_of(share: Column, schedule: Sequence[float], knots: Sequence[float]) -> Column:
    """The time by which a schedule's demand has come to ``share`` (0 to 1) of all: its integral, inverted."""
    out = F.lit(float(knots[-1]))
    for before, end, start, value, slope in reversed(demand(schedule, knots)):
        rest = share - before
        # value * x + slope * x**2 / 2 = rest, in the form that holds for slope 0 too
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(value * value) + F.lit(2 * slope) * rest))
        x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(value) + root))
        out = F.when(share <= end, start + x).otherwise(out)
    return out


def numbered(ranged: DataFrame, what: str) -> DataFrame:
    """A range-sorted table, staged, with each row's ``_place`` in it from 0, by offsets of its partitions: no task ranks all rows."""
    columns = ranged.columns
    ranged = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), what)
    part, place = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    # A row a partition of the range sort: that bound is what lets them go to every task.
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*columns, (F.col("_offset") + place).alias("_place"))


def classes(sizes: DataFrame, n: int) -> DataFrame:
    """A row a source with its class: its rank among all sources, by code point and null last, modulo n."""
    ranked = numbered(sizes.repartitionByRange("_source").sortWithinPartitions("_source"), "ranked")
    return ranked.withColumn("class", F.pmod("_place", F.lit(n)).cast("int")).select(*sizes.columns, "class")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """_source, source_size, class (its number modulo the weights) and target, from a row a source.

    With weights w, caps c and T words in all, targets are min(c, L w) for the
    L that makes them sum to T.  By ascending c / w, L is (T - caps so far) /
    (weights left) at the first source that this leaves under its cap.  This
    sorts a row for all sources of one class and size (of most sizes there are
    few, and very many sources have small ones), not sources or documents.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("class"))
    one = classes(sizes, len(weights))
    like = one.groupBy("class", "source_size").agg(F.count("*").alias("_n")).withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    every, up = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "class").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.sum(F.col("_n") * F.col(x)).over(every) - F.coalesce(F.sum(F.col("_n") * F.col(x)).over(up), F.lit(0.0))
    capped = F.coalesce(F.sum(F.col("_n") * F.col("_cap")).over(up), F.lit(0.0))
    like = like.withColumn("_level", (F.sum(F.col("_n") * F.col("source_size")).over(every) - capped) / before("_w"))
    level = like.where("_level * _w <= _cap").agg(F.min(F.struct(F.col("_cap") / F.col("_w"), "class", "_level"))["_level"].alias("_share"))  # one row
    return one.crossJoin(F.broadcast(level)).select("_source", "source_size", "class", F.least(most * F.col("source_size"), F.col("_share") * weight).alias("target"))


def _keyed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    return docs.select("doc_id", words().alias("size"), null_key("source").alias("_source"), F.xxhash64(F.lit(seed), "doc_id").alias("_hash"), *more)


def _planner(docs: DataFrame, weights: Sequence[float], schedules: Sequence[Sequence[float]], knots: Sequence[float], most: float, seed: int) -> Callable[..., DataFrame]:
    """A function that gives the documents as planned, with the further columns of ``docs`` that it is called with."""
    means = [w * mean(schedules[n % len(schedules)], knots) for n, w in enumerate(weights)]
    base = staged(_keyed(docs, seed), "sizes")
    of_source = staged(base.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")), "sources")
    # The upper 31 bits of the hash, dealt into equal buckets, as many as the largest source needs.
    buckets = max(1, -(-(of_source.agg(F.max("_docs")).first()[0] or 0) // BUCKET))
    bucketed = lambda df: df.withColumn("_bucket", F.expr(f"shiftrightunsigned(_hash, 33) * {buckets} div {1 << 31}"))
    sums = bucketed(base).groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_sum")
    sums = sums.select("_source", "_bucket", ahead.alias("_ahead")).join(targets(of_source.drop("_docs"), means, most), "_source")

    def when_taken(k: Column) -> Column:
        share = F.least(F.lit(1.0), (k * F.col("source_size") + F.col("_at")) / F.greatest(F.col("target"), F.lit(1.0)))
        time = F.lit(0.0)
        for n in range(len(weights)):
            time = F.when(F.col("class") == n, time_of(share, schedules[n % len(schedules)], knots)).otherwise(time)
        return time

    def planned(*more: Column) -> DataFrame:
        rows = bucketed(_keyed(docs, seed, *more) if more else base)
        own = Window.partitionBy("_source", "_bucket").orderBy(F.expr("shiftrightunsigned(_hash, 33)"), "_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("_upto", F.sum("size").over(own)).join(sums, ["_source", "_bucket"])
        out = out.withColumn("_at", F.col("_ahead") + F.col("_upto") - F.col("size"))
        out = out.withColumn("_whole", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
        rest = F.round("target").cast("long") - F.col("_whole") * F.col("source_size")
        out = out.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_at"))))
        out = out.withColumn("taken", F.col("_whole") * F.col("size") + F.col("part"))
        passes = (F.col("_whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
        starts = F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0), passes - 1), when_taken)).otherwise(F.array().cast("array<double>"))
        return out.withColumn("starts", starts)

    return planned


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, knots: Sequence[float] = KNOTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken and starts (the training time of each pass that takes it)."""
    return _planner(docs, weights, schedules, knots, most, seed)().select("doc_id", "size", "source_size", "target", "taken", "starts")


def _passes(docs: DataFrame, planned: Callable[..., DataFrame]) -> DataFrame:
    """The mixture, range-sorted by training time: a row a pass, with its _doc, its _text as taken, and _source and _at, which tell its document."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = planned(whole).select("_doc", "_source", "_at", "size", "part", "starts", F.posexplode("starts").alias("_pass", "_time"))
    cut = (F.col("_pass") == F.size("starts") - 1) & (F.col("part") > 0) & (F.col("part") < F.col("size"))
    text, n = F.col("_doc.text"), F.col("part").cast("int")
    first = F.array_join(F.zip_with(F.slice(F.split(text, WORD, -1), F.lit(1), n), F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n), lambda g, w: F.concat(g, w)), "")
    rows = rows.withColumn("_text", F.when(cut, first).otherwise(text))
    order = ("_time", F.col("_doc.doc_id"), "_pass", "_source", "_at")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, knots: Sequence[float] = KNOTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """The documents as the mix takes them, repeated and cut as planned, range-sorted by training time."""
    rows = _passes(docs, _planner(docs, weights, schedules, knots, most, seed))
    return rows.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])


def report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, knots: Sequence[float] = KNOTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, and what the mixture holds of it.

    That is counted in the mixture itself, made as ``mixed`` makes it: the words
    of its passes (taken), their number (passes), the training time of the first
    (start) and the number of passes of all documents before that one (place).
    """
    docs = docs.select("doc_id", "text", "source")
    planned = _planner(docs, weights, schedules, knots, most, seed)
    passes = numbered(_passes(docs, planned).select("_source", "_at", "_time", words("_text").alias("_words")), "mixture")
    of_doc = passes.groupBy("_source", "_at").agg(F.sum("_words").alias("taken"), F.count("*").alias("passes"), F.min("_time").alias("start"), F.min("_place").alias("place"))
    # Documents without words stand where the next one does: they get keys that no pass has, dealt by hash.
    at = F.when(F.col("size") > 0, F.col("_at")).otherwise(-1 - F.shiftrightunsigned("_hash", 1))
    out = planned().select("doc_id", "size", "source_size", "target", "_source", at.alias("_at")).join(of_doc, ["_source", "_at"], "left")
    return out.select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "passes")], "start", "place")

"""Quality rules with thresholds that adapt to each language and source; DataFrame functions only.

Every document gets a handful of rates.  For each (lang, source) and rate a
mergeable quantile sketch is kept: the counts of relative-error buckets (values
up to 63 apart, then 32 buckets for each doubling), so a sketch has a bounded
number of buckets, merges by addition and gives the same quantiles however the
rows were dealt.  A rate is an outlier above its group's fence: the upper
quartile plus ``spread`` times the distance of the quartiles, where groups of
under ``least`` documents take the fence of all documents.  The thresholds join
back to the documents, and a document stays if no rule strikes.

Texts are read once; later steps read the written rates.

Defined cases: null text counts as empty (no words: base_failed); null lang and
source are groups of their own; a document without words strikes no adaptive
rule; a very long text is measured whole, within one task (its arrays of words,
hashes and windows take some 100 bytes a word); repeated rows are counted and
returned as often as they occur; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, join_small, null_key, staged, text_of

#: In thousandths: each rate's name, and the least distance of quartiles that a fence counts with.
RATES = {"symbols": 10, "dup_lines": 150, "repeats": 100, "word_length": 500, "capitals": 50}
SPREAD, LEAST, MIN_WORDS, MAX_REPEAT = 3, 50, 50, 50
#: Bits of a window's place in its text, below those of its hash, while windows are sorted; a text with more windows
#: sorts pairs of hash and place instead, which takes longer.
PLACE = 24


def measured(docs: DataFrame, place: int = PLACE) -> DataFrame:
    """doc_id, lang, source, the base counts and the rates of every document.

    Words in 3-word windows that occur twice or more: windows are sorted by
    hash, with their places in the low bits; neighbours (the next two on either
    side, should the upper bits of hashes collide) are compared by their whole
    hashes; the places of repeated windows, sorted, cover
    min(3, distance to the one before) words each.
    """
    text = text_of()
    out = docs.select("doc_id", "lang", "source", text.alias("text"))
    out = out.withColumn("_words", F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    out = out.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn(
        "_windows", F.when(F.size("_words") > 2, F.zip_with(
            F.zip_with(F.slice("_hash", F.lit(1), F.size("_hash") - 2), F.slice("_hash", F.lit(2), F.size("_hash") - 2), lambda a, b: F.xxhash64(a, b)),
            F.slice("_hash", F.lit(3), F.size("_hash") - 2), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")),
    )
    # The hash's upper bits and the place in one number, so that one sort of numbers brings equal windows together.
    mask = F.lit(-(1 << place))
    packed = F.array_sort(F.transform("_windows", lambda h, i: h.bitwiseAND(mask).bitwiseOR(i.cast("long"))))
    packed = F.transform(packed, lambda p: p.bitwiseAND(F.lit((1 << place) - 1)).cast("int"))
    pairs = F.transform(F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda p: p["i"])
    sorted_ = F.when(F.size("_windows") <= 1 << place, packed).otherwise(pairs)
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("_full", F.transform("_sorted", lambda i: F.get("_windows", i)))
    same = lambda i, k: F.get("_full", i) == F.get("_full", i + k)
    twice = F.filter(F.transform("_sorted", lambda p, i: F.when(same(i, 1) | same(i, -1) | same(i, 2) | same(i, -2), p).otherwise(F.lit(-1))), lambda p: p >= 0)
    out = out.withColumn("_twice", F.array_sort(twice))
    covered = F.aggregate(
        F.transform("_twice", lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get("_twice", i - 1), p - 3))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    bare = F.translate("text", SPACES, "")
    out = out.withColumn("_lines", lines).withColumn("_bare", bare)
    out = out.select(
        "doc_id", "lang", "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length("_bare").cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.length("_bare") - F.length(F.translate("_bare", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("_n_capitals"),
    )
    rate = lambda a, b: F.expr(f"if({b} = 0, NULL, {a} * 1000 div {b})")
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate("n_symbols", "n_words").alias("symbols"), rate("n_dup_lines", "_n_lines").alias("dup_lines"), rate("n_repeat_words", "n_words").alias("repeats"),
        rate("word_chars", "n_words").alias("word_length"), rate("_n_capitals", "word_chars").alias("capitals"),
    )


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number from 0 on."""
    top = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(F.call_function("shiftrightunsigned", value, top) + top * 32)


def bucket_end(b: Column) -> Column:
    """The largest value of a bucket."""
    top = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise(((b - top * 32 + 1) * F.pow(F.lit(2), top)).cast("long") - 1)


def sketches(rates: DataFrame, names: list[str]) -> DataFrame:
    """_g (group), rate, bucket, n: the sketch of every group and rate. Summing n over groups merges them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), F.col(name).alias("value")) for name in names]))
    long = rates.select("_lang", "_source", pairs.alias("p")).where("p.value IS NOT NULL")
    return long.groupBy("_lang", "_source", F.col("p.rate").alias("rate"), bucket(F.col("p.value")).alias("bucket")).agg(F.count("*").alias("n"))


def quantile_fences(sketch: DataFrame, keys: list[str], floors: dict[str, int], spread: int) -> DataFrame:
    """Each group's fence by rate, from its sketch: the upper quartile plus spread times the quartiles' distance."""
    own = Window.partitionBy(*keys, "rate")
    up = sketch.withColumn("_up", F.sum("n").over(own.orderBy("bucket"))).withColumn("_all", F.sum("n").over(own))
    quartile = lambda k: F.min(F.when(F.col("_up") * 4 >= F.col("_all") * k, bucket_end(F.col("bucket"))))
    q = up.groupBy(*keys, "rate").agg(quartile(1).alias("_low"), quartile(3).alias("_high"), F.max("_all").alias("_n"))
    floor = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
    return q.select(*keys, "rate", "_n", (F.col("_high") + spread * F.greatest(F.col("_high") - F.col("_low"), floor[F.col("rate")])).alias("fence"))


def quality_rules(docs: DataFrame, floors: dict[str, int] = RATES, spread: int = SPREAD, least: int = LEAST) -> DataFrame:
    """Every document with its base counts, base_failed and kept."""
    names = list(floors)
    rates = staged(measured(docs), "rates").withColumn("_lang", null_key("lang")).withColumn("_source", null_key("source"))
    sketch = staged(sketches(rates, names), "sketches")
    merged = sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    fences = quantile_fences(sketch, ["_lang", "_source"], floors, spread)
    # One row, of as many columns as there are rates.
    overall = quantile_fences(merged, [], floors, spread).agg(*[F.max(F.when(F.col("rate") == n, F.col("fence"))).alias(f"_all_{n}") for n in names])
    wide = fences.groupBy("_lang", "_source").agg(*[F.max(F.when((F.col("rate") == n) & (F.col("_n") >= least), F.col("fence"))).alias(f"_own_{n}") for n in names])
    out = join_small(rates, wide.crossJoin(F.broadcast(overall)), ["_lang", "_source"])
    struck = F.lit(False)
    for n in names:
        struck = struck | F.coalesce(F.col(n) > F.coalesce(F.col(f"_own_{n}"), F.col(f"_all_{n}")), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~struck).alias("kept"), *names
    )

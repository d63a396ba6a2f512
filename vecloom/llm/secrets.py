"""Secret scans through a trigram inverted index; DataFrame functions only.

1. Each rule's regex is analysed into a Boolean query over trigrams that every
   match must hold (lower-cased); a rule without such trigrams scans all texts.
2. The index keeps, by trigram and segment of documents, the ids of documents
   that hold the trigram.  It covers the trigrams that the rules ask for, a
   number fixed by the rules.  Segments bound the length of a posting list, so
   a trigram that a third of all documents hold is spread over many rows.
3. Within each segment, posting lists are intersected and united as the query
   says; what is left are a rule's candidates.
4. Candidates are verified with the regex itself over their whole texts.
   Matches come from regexp_extract_all and their places from the lengths of
   what split leaves between them, in code points.

Defined cases: null text counts as empty and has no spans; rows with a null
doc_id are candidates of every rule; rows that share a doc_id share candidates
(more are verified, none is missed); repeated rows are returned as often as
they occur; an empty table gives an empty result; further columns are kept,
whatever their names; a very long text, or one of very many secrets, is searched
and redacted whole, in time that grows with its length and its matches.
The span of a private key is the whole key, from its BEGIN through its END line,
or through the base64 lines that follow if it has none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, join_ids, staged, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their listed order, then the kinds that this operator adds.
#: Greedy runs of one class are written with their least length where that gives the same matches.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What follows the header of a private key: all up to its END line (no five hyphens in a row, at most 50 groups of fewer);
#: without one, its own headers and base64 lines (at most 240, in parts that RE2 can count), then one shorter line.
#: A line break may be written as an escape. What stands on the shorter line up to a sign beyond base64 counts as the key's.
BREAK = r"(?:[ \t\r\n]+|(?:\\r)?\\n)"
KEY_LINES = rf"(?:{BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}}){{0,60}}"
KEY_BODY = (
    r"(?:[^-]*(?:-{1,4}[^-]+){0,50}-----END [A-Z ]{0,30}PRIVATE KEY-----"
    rf"|(?:{BREAK}[A-Z][A-Za-z]*-[A-Z][A-Za-z]*: [^\r\n\\]*){{0,5}}{BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}}{KEY_LINES * 4}(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]{{1,15}}={{0,2}})?)?"
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----" + KEY_BODY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED
#: Strings that the analysis of a regex keeps apart before it turns them into trigrams.
APART = 16
#: Documents of one segment of the index.
SEGMENT = 50_000
#: Elements that a running value goes through one by one, and code points of a part of a text that is redacted.
RUN, PART = 128, 1024

Query = tuple  # ("all",), ("has", trigram), ("and", queries), ("or", queries)


def both(a: Query, b: Query) -> Query:
    if a == ("all",):
        return b
    return a if b == ("all",) or a == b else ("and", tuple(dict.fromkeys([*(a[1] if a[0] == "and" else [a]), *(b[1] if b[0] == "and" else [b])])))


def either(queries: list[Query]) -> Query:
    distinct = tuple(dict.fromkeys(queries))
    return ("all",) if ("all",) in distinct else distinct[0] if len(distinct) == 1 else ("or", distinct)


def of_strings(strings: set[str]) -> Query:
    """What a text holds that holds one of the strings."""
    queries = []
    for s in sorted(strings):
        q: Query = ("all",)
        for i in range(len(s) - 2):
            q = both(q, ("has", s[i : i + 3]))
        queries.append(q)
    return either(queries)


def _exact(op, value) -> set[str] | None:
    """All lower-cased strings that a node of a regex matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < APART:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= APART else None
    if op is sre.SUBPATTERN:
        return _exact_all(value[-1])
    if op is sre.BRANCH:
        parts = [_exact_all(x) for x in value[1]]
        if any(p is None for p in parts):
            return None
        out = set().union(*parts)
        return out if len(out) <= APART else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
        one = _exact_all(value[2])
        if one is None:
            return None
        out = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(sorted(one), repeat=n)}
        return out if len(out) <= APART else None
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for op, value in nodes:
        one = _exact(op, value)
        if one is None or len(out) * len(one) > APART:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> Query:
    """The Boolean query over trigrams that every text with a match fulfils; ("all",) if there is none."""

    def sequence(nodes) -> Query:
        found: Query = ("all",)
        strings = {""}
        for op, value in nodes:
            one = _exact(op, value)
            if one is not None and len(strings) * len(one) <= APART:
                strings = {a + b for a in strings for b in one}
                continue
            found, strings = both(found, of_strings(strings)), {""}
            if one is not None:
                strings = one
            elif op is sre.SUBPATTERN:
                found = both(found, sequence(value[-1]))
            elif op is sre.BRANCH:
                found = both(found, either([sequence(x) for x in value[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                found = both(found, sequence(value[2]))
        return both(found, of_strings(strings))

    return sequence(sre_parse.parse(pattern))


def trigrams(q: Query) -> set[str]:
    return {q[1]} if q[0] == "has" else set().union(*(trigrams(x) for x in q[1])) if len(q) > 1 else set()


def trigram_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Posting lists: segment, trigram, ids (of documents whose lower-cased text holds the trigram)."""
    segments = max(1, math.ceil(docs.count() / SEGMENT))
    # Lowered in a projection of its own, which Spark keeps as it is used more than once:
    # within one expression over arrays a text would be lowered for each trigram.
    flags = F.array(*[F.contains(F.col("low"), F.lit(t)) for t in wanted])
    return (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.lower("text").alias("low")).select("doc_id", flags.alias("flags"))
        .select("doc_id", F.posexplode("flags").alias("place", "held")).where("held")
        .select("doc_id", F.get(F.array(*[F.lit(t) for t in wanted]), F.col("place")).alias("trigram"))
        .groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(segments)).alias("segment"), "trigram")
        .agg(F.collect_set("doc_id").alias("ids"))
    )


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """doc_id and rules (bit n: rule n), by intersecting and uniting posting lists segment by segment."""
    lists = F.map_from_entries(F.collect_list(F.struct("trigram", "ids")))

    def run(q: Query) -> Column:
        if q[0] == "has":
            return F.coalesce(F.try_element_at(F.col("lists"), F.lit(q[1])), F.array().cast("array<bigint>"))
        parts = [run(x) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = F.array_intersect(out, p) if q[0] == "and" else F.array_union(out, p)
        return out

    found = F.array(*[F.struct(F.lit(1 << n).cast("long").alias("bit"), run(q).alias("ids")) for n, q in queries.items()])
    return (
        index.groupBy("segment").agg(lists.alias("lists"))
        .select(F.explode(found).alias("rule")).select("rule.bit", F.explode("rule.ids").alias("doc_id"))
        .groupBy("doc_id").agg(F.bit_or("bit").alias("rules"))
    )


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of a column of long numbers what ``step`` makes of it and all before it, from 0 on.

    Results are gathered in runs, so that adding one to a list copies a run or the list of runs, never all of them.
    ``values`` should be a column, as it is taken apart once a run.
    """
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(RUN)).cast("int")), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN)))

    def within(at: Column, run: Column) -> Column:
        return F.aggregate(run, state(at, F.array().cast("array<bigint>")), lambda a, x: state(step(a["at"], x), F.concat(a["out"], F.array(step(a["at"], x)))))["out"]

    zero = state(F.lit(0).cast("long"), F.array().cast("array<array<bigint>>"))
    return F.flatten(F.aggregate(runs, zero, lambda a, run: state(F.aggregate(run, a["at"], step), F.concat(a["out"], F.array(within(a["at"], run)))))["out"])


def verified(docs: DataFrame, cands: DataFrame, rules: tuple[Rule, ...], scan: set[int], name: str) -> DataFrame:
    """docs with spans: array of (start, rule, end), sorted; rules in ``scan`` search every text."""
    own = free_prefix(docs)
    out = join_ids(docs, cands.withColumnRenamed("rules", f"{own}rules"), "left")
    for n, rule in enumerate(rules):
        wanted = F.col("doc_id").isNull() | ((F.coalesce(F.col(f"{own}rules"), F.lit(0)).bitwiseAND(F.lit(1 << n))) != 0)
        found = F.regexp_extract_all(text_of(), F.lit(rule.pattern), F.lit(0))
        out = out.withColumn(f"{own}m{n}", found if n in scan else F.when(wanted, found).otherwise(F.array().cast("array<string>")))
    for n, rule in enumerate(rules):
        some = F.size(f"{own}m{n}") > 0
        out = out.withColumn(f"{own}l{n}", F.when(some, F.transform(f"{own}m{n}", lambda m: F.length(m).cast("long"))))
        out = out.withColumn(f"{own}g{n}", F.when(some, F.transform(F.split(text_of(), rule.pattern, -1), lambda g: F.length(g).cast("long"))))
        if rule.group:
            out = out.withColumn(f"{own}v{n}", F.when(some, F.transform(F.regexp_extract_all(text_of(), F.lit(rule.pattern), F.lit(rule.group)), lambda v: F.length(v).cast("long"))))
    for n in range(len(rules)):
        # A match starts after the gaps up to it and the matches before it.
        ahead = F.zip_with(f"{own}g{n}", F.concat(F.array(F.lit(0).cast("long")), F.col(f"{own}l{n}")), lambda g, m: g + m)
        out = out.withColumn(f"{own}a{n}", F.when(F.size(f"{own}m{n}") > 0, ahead))
    spans = []
    for n, rule in enumerate(rules):
        least, some = F.lit(rule.least), F.size(f"{own}m{n}") > 0
        kept = F.zip_with(
            F.slice(running(F.col(f"{own}a{n}"), lambda a, x: a + x), F.lit(1), F.size(f"{own}m{n}")),
            F.arrays_zip(F.col(f"{own}l{n}").alias("l"), F.col(f"{own}v{n}" if rule.group else f"{own}l{n}").alias("v")),
            lambda s, x: F.struct(s.alias("start"), F.lit(n).alias("rule"), (s + x["l"]).alias("end"), x["v"].alias("v")),
        )
        kept = F.transform(F.filter(kept, lambda x: x["v"] >= least), lambda x: F.struct(x["start"], x["rule"], x["end"]))
        spans.append(F.when(some, kept).otherwise(F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")))
    return out.withColumn(f"{own}spans", F.array_sort(F.concat(*spans))).select(*docs.columns, F.col(f"{own}spans").alias(name))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """The documents with their spans of secrets as column ``name``: start, rule (its number) and end, sorted, in code points from 0.

    A column that is called so already is replaced; ``free_name`` finds a name that none has.
    """
    for r in rules:
        re.compile(r.pattern)
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    scan = {n for n, q in queries.items() if q == ("all",)}
    wanted = sorted(set().union(*map(trigrams, queries.values())))
    docs = docs.drop(name)
    cands = candidates(staged(trigram_index(docs, wanted), "trigrams"), {n: q for n, q in queries.items() if n not in scan})
    return verified(docs, staged(cands, "candidates"), rules, scan, name)


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """A row a document: counts of the base kinds, the digest of their spans, and all spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = lambda n: F.size(F.filter("spans", lambda s: s["rule"] == n)).cast("long").alias(f"n_{rules[n].kind}")
    return found.select(
        "doc_id", *[of(n) for n in range(base)], F.sha2(written(F.filter("spans", lambda s: s["rule"] < base)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def redacted(found: DataFrame, mark: str = "[SECRET]", name: str = "spans") -> DataFrame:
    """The documents, without column ``name``, with every span of a secret replaced by a mark; overlapping spans by one.

    A text with spans is cut into parts of equal length once, and what stands
    between its spans is put together from these.
    """
    own = free_prefix(found)
    ends, reach, parts = (f"{own}{c}" for c in ("ends", "reach", "parts"))
    some = F.size(name) > 0
    out = found.withColumn(ends, F.transform(name, lambda s: s["end"]))
    out = out.withColumn(reach, F.when(some, F.concat(F.array(F.lit(0).cast("long")), running(F.col(ends), lambda a, x: F.greatest(a, x)))))
    out = out.withColumn(parts, F.when(some, F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        """The text from code point a to b."""
        first, last = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
        at, to = (a - first * PART + 1).cast("int"), (b - last * PART).cast("int")
        part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        several = F.concat(F.substring(part(first), at, F.lit(PART)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substring(part(last), F.lit(1), to))
        return F.when(first == last, F.substring(part(first), at, (b - a).cast("int"))).otherwise(several)

    gaps = F.zip_with(F.col(name), F.slice(reach, F.lit(1), F.size(name)), lambda s, r: F.when(s["start"] >= r, F.concat(between(r, s["start"]), F.lit(mark))).otherwise(F.lit("")))
    text = F.concat(F.array_join(gaps, ""), between(F.element_at(reach, -1), F.length("text").cast("long")))
    return out.withColumn("text", F.when(some, text).otherwise(F.col("text"))).select(*[c for c in found.columns if c != name])

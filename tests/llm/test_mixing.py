import random
import re

import pytest

from vecloom.llm.common import null_key
from vecloom.llm.mixing import KNOTS, SCHEDULES, demand, mean, mixed, plan, report, targets
from vecloom.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def want_targets(sizes):
    """Sharing and resharing as the contract says it."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3 * sizes[s] if over else share[s]
            left -= target[s]
        free -= over or free
    return target


def corpus(seed, n=300):
    r = random.Random(seed)
    sources = ["b", "a", "ä", "z", None, "hot"]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 200])), "en", r.choice(sources + ["hot"] * 3)) for i in range(n)]
    return [*rows, (n, None, None, "b"), (n + 1, "  \n\t", None, None), (None, "x y", None, "a"), (0, "one two", None, "tiny"), rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_plan(spark, docs, seed):
    rows = corpus(seed)
    out = plan(docs(*rows).withColumnRenamed("n_chars", "target")).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    target = want_targets(sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in out) == sorted((r[0] is None, r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and all(0 <= t <= 1 for t in r.starts) and bool(r.starts) == (r.taken > 0)
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s in sizes:
        assert any(k[0] == sizes[s] and k[1] == pytest.approx(target[s], abs=1e-5) for k in by)
    for (size, t), taken in by.items():  # sources of the same size and target count together
        n = sum(1 for s in sizes if sizes[s] == size and round(target[s], 6) == t)
        assert n and abs(sum(taken) - n * t) <= 0.5 * n + 1e-5
    again = plan(docs(*random.Random(9).sample(rows, len(rows))).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


@pytest.mark.parametrize("seed", [4, 5])
def test_targets_of_many_sources(spark, seed):
    """Sources are ranked over several partitions, and shared out by class and size."""
    r = random.Random(seed)
    names = [None, "", "ä", "\U0001f600", "\uffee", *(f"host{r.random()}" for _ in range(700))]
    sizes = {s: r.choice([0, 1, 1, 2, 3, 30, 30, r.randrange(5000)]) for s in names}
    if seed == 5:
        sizes["hot"] = 10**7
    rows = r.sample([*sizes.items()], len(sizes))
    table = spark.createDataFrame(rows, "source string, source_size long").select(null_key("source").alias("_source"), "source_size")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        got = {x._source: x for x in targets(table).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    target = want_targets(sizes)
    order = sorted(s for s in sizes if s is not None) + [None]
    assert len(got) == len(sizes)
    for i, s in enumerate(order):
        x = got["~" if s is None else "=" + s]
        assert x["class"] == i % 3 and x.source_size == sizes[s] and x.target == pytest.approx(target[s], rel=1e-9, abs=1e-6)


def test_mixed(spark, docs):
    rows = corpus(3)
    taken = sum(r.taken for r in plan(docs(*rows)).collect())
    df = mixed(docs(*rows).withColumnRenamed("n_chars", "size"))
    got = df.collect()
    assert df.columns == ["doc_id", "text", "lang", "source", "size"]
    assert sum(len(WORD.findall(r.text)) for r in got) == taken
    texts = {(r[0], r[3]): [x[1] for x in rows if (x[0], x[3]) == (r[0], r[3])] for r in rows}
    assert all(any((t or "").startswith(r.text) for t in texts[r.doc_id, r.source]) for r in got)


def test_curriculum(spark, docs):
    """Heavy sources come early, light ones late, in the proportions of the schedule's integral."""
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate("abc" * 1000)]
    got = {}
    for r in plan(docs(*rows)).collect():
        got.setdefault(round(r.target), []).extend(r.starts)
    for times, schedule in zip((got[k] for k in sorted(got, reverse=True)), SCHEDULES):
        half = sum((b - a) * (v + w) / 2 for a, b, v, w in zip(KNOTS, KNOTS[1:], schedule, schedule[1:]) if b <= 0.5)
        assert sum(t < 0.5 for t in times) / len(times) == pytest.approx(half, abs=0.01)


def test_demand():
    parts = demand((2.0, 0.0), (0.0, 1.0))
    assert parts[0][0] == 0 and parts[-1][1] == pytest.approx(1)


def test_no_words(spark, docs):
    assert plan(docs((1, "x")).limit(0)).collect() == []
    assert [r.taken for r in plan(docs((1, None), (2, " "))).collect()] == [0, 0]


def test_query_states_the_mixture(spark, docs, tmp_path):
    """op4_mixing counts what stands in the mixture, and says where."""
    df = docs(*corpus(6))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op4_mixing"](spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    got, mixture = out.collect(), mixed(df).collect()
    assert sorted(map(str, (r[:5] for r in got))) == sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in plan(df).collect())
    words, passes = {}, {}
    for r in mixture:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        passes[r.doc_id] = passes.get(r.doc_id, 0) + 1
    for key in {r.doc_id for r in got}:
        assert sum(r.taken for r in got if r.doc_id == key) == words.get(key, 0)
        assert sum(r.passes for r in got if r.doc_id == key) == passes.get(key, 0)
    taken = sorted((r for r in got if r.taken), key=lambda r: r.place)
    assert [r.start for r in taken] == sorted(r.start for r in taken)
    assert len({r.place for r in taken}) == len(taken) and all(mixture[r.place].doc_id == r.doc_id for r in taken)
    assert all((r.passes, r.start, r.place) == (0, None, None) for r in got if not r.taken) and any(r.size == 0 for r in got)
    again = QUERIES["op4_mixing"](spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedules_move_documents(spark, docs):
    """Other schedules of the same mean change times and places, not what is taken."""
    df = docs(*[(i, "w " * 10, "en", s) for i, s in enumerate("abc" * 200)])
    one, other = ({r.doc_id: r for r in report(df, schedules=s).collect()} for s in (SCHEDULES, SCHEDULES[::-1]))
    assert {i: r.taken for i, r in one.items()} == {i: r.taken for i, r in other.items()}
    for first, later in ((one, other), (other, one)):  # source a, then source c: what fades comes earlier
        ids = [i for i in one if i % 3 == (0 if first is one else 2) and one[i].taken]
        assert sum(first[i].place for i in ids) < sum(later[i].place for i in ids)
        assert sum(first[i].start for i in ids) < sum(later[i].start for i in ids)


def test_targets_follow_the_integrals(spark, docs):
    assert [mean(s, KNOTS) for s in SCHEDULES] == [1.0, 1.0, 1.0]
    assert mean((2.0, 0.0, 4.0), (0.0, 1.0, 3.0)) == pytest.approx(5 / 3)
    df = docs(*[(i, "w " * 10, "en", s) for i, s in enumerate("abc" * 20)])
    got = {r.doc_id % 3: r.target for r in plan(df, schedules=((3.0, 2.0, 1.0), (1.0, 1.0, 1.0), (0.0, 1.0, 2.0))).collect()}
    assert got == pytest.approx({0: 600 * 10 / 13, 1: 600 * 2 / 13, 2: 600 * 1 / 13})


def test_report_without_words(spark, docs):
    assert report(docs((1, "x")).limit(0)).collect() == []
    assert [tuple(r)[4:] for r in report(docs((1, None), (1, None), (None, " "))).collect()] == [(0, 0, None, None)] * 3

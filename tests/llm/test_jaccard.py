import random
import re

import pytest

from vecloom.llm.components import components
from vecloom.llm.jaccard import jaccard_groups, representatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def by_hand(rows, n, percent):
    nodes = sorted({d for d, _ in rows if d is not None})
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    up = {d: d for d in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(d), find(e)))
                up[high] = low
    return sorted((str(d), len(s), str(find(d) if d is not None else None)) for d, s in sets)


def corpus(seed, size):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "É", "of"]
    passage = " ".join(r.choices(vocabulary, k=25))
    out = []
    for _ in range(size):
        kind = r.random()
        if out and kind < 0.5:  # a near copy, some just at the border
            words = WORD.findall(r.choice(out))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append((" " if r.random() < 0.8 else "\n ").join(words).swapcase() if r.random() < 0.1 else " ".join(words))
        else:
            out.append(" ".join(r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 4, 5, 20, 60, 150]))) + (" " + passage if kind > 0.8 else ""))
    return out


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_against_all_pairs(spark, docs, seed, n, percent):
    texts = corpus(seed, 250) + [None, "", "  ", "a b", "A B", "word " * 4000]
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    random.Random(seed).shuffle(rows)
    rows += [rows[0], (None, texts[5]), (None, None)]
    got = jaccard_groups(docs(*rows).withColumnRenamed("n_chars", "n").repartition(5), n, percent).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == by_hand(rows, n, percent)


def test_one_id_with_several_texts(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a), (3, a), (7, b), (9, b), (9, c), (8, c), (20, "something else altogether here")]
    got = {(x.doc_id, x.component_id) for x in jaccard_groups(docs(*rows)).collect()}
    assert got == {(7, 3), (3, 3), (9, 3), (8, 3), (20, 20)}


def test_many_near_copies(spark, docs):
    """A chain in which neighbours link and others do not, and a crowd around one text."""
    words = [f"w{i}" for i in range(240)]
    chain = [(1000 - i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(30)]
    r = random.Random(3)
    crowd = []
    for i in range(300):
        own = [f"c{k}" for k in range(120)]
        own[r.randrange(120)] = f"x{i}"
        crowd.append((2000 + i, " ".join(own)))
    got = {x.doc_id: x.component_id for x in jaccard_groups(docs(*chain, *crowd)).collect()}
    assert got == {int(d): int(c) for d, _, c in by_hand([*chain, *crowd], 4, 85)} and set(got[d] for d, _ in crowd) == {2000}


def test_representatives(spark, docs):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(5, a), (2, a + " more"), (2, a + " more"), (9, None), (10, ""), (11, "unlike all others"), (None, a), (4, a.upper())]
    out = representatives(docs(*rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(x.doc_id) for x in out.collect()) == ["10", "11", "2", "9", "None"]


def test_empty(spark, docs):
    none = docs((1, "x")).limit(0)
    assert jaccard_groups(none).collect() == [] and representatives(none).collect() == []


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_representatives_of_ids_with_several_texts(spark, docs):
    """Texts are what links: an id's other text goes only if it links itself; names of further columns do not matter."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(7, a), (7, b), (3, a), (9, c), (9, None), (9, c), (9, ""), (12, c + " more"), (12, None), (20, a + " more"), (20, a), (None, c)]
    out = representatives(docs(*rows).withColumnRenamed("lang", "_d1").withColumnRenamed("source", "rows").withColumnRenamed("n_chars", "component"))
    assert out.columns == ["doc_id", "text", "_d1", "rows", "component"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(3, a), (7, b), (9, c), (9, None), (9, ""), (12, None), (None, c)]))


def test_a_shingle_in_every_text(spark, docs, monkeypatch):
    """Texts of one passage and own words, many more than a block holds; only some link."""
    from vecloom.llm import jaccard

    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 1 << 10)
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"{passage} " + " ".join(f"o{r.randrange(4000)}" for _ in range(20))) for i in range(400)]
    rows += [(1000 + i, rows[i * 3][1] + " tail") for i in range(60)]
    got = jaccard_groups(docs(*rows).repartition(3)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == by_hand(rows, 4, 85)

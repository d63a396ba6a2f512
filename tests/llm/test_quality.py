import random

import numpy as np
import pyarrow as pa

from vecloom.llm.quality import BUCKETS, RANK, STATS, Model, accepted, features, fit, scored, train

LABELS = "doc_id long, quality int, toxic int"


def brute(m, bucket, value, at, raw):
    """The machine over dense features, pair by pair."""
    out = []
    for i in range(len(at) - 1):
        x = np.zeros(BUCKETS + len(STATS))
        x[bucket[at[i] : at[i + 1]]] = value[at[i] : at[i + 1]]
        x[BUCKETS:] = m.stats(raw)[i]
        some = np.flatnonzero(x)
        y = m.bias + x @ m.w + sum(m.v[a] @ m.v[b] * x[a] * x[b] for k, a in enumerate(some) for b in some[k + 1 :])
        out.append(1 / (1 + np.exp(-y)))
    return np.array(out)


def test_linear_time_identity():
    r = np.random.default_rng(1)
    size = BUCKETS + len(STATS)
    m = Model(np.zeros(len(STATS)), np.ones(len(STATS)), 0.3, r.normal(0, 0.3, size), r.normal(0, 0.3, (size, RANK)))
    got = features(pa.array(["the cat sat on the mat", None, "A B! c | d\n\nA B! c | d", "x " * 50, "é中文"]), np.array([22, np.nan, 5, 1e9, -1]))
    assert np.allclose(m.score(*got), brute(m, *got))


def test_features():
    bucket, value, at, raw = features(pa.array(["Aa aa bb", "", None, "x\nx\ny"]), np.array([8.0, np.nan, 0, 5]))
    stat = lambda i, name: raw[i, STATS.index(name)]
    assert at.tolist() == [0, 2, 2, 2, 4] and np.allclose([np.linalg.norm(value[a:b]) for a, b in zip(at, at[1:])], [1, 0, 0, 1])
    assert stat(0, "capitals") == 1 / 8 and stat(0, "stutter") == 1 / 3 and stat(3, "repeated_lines") == 1 / 3 and stat(1, "no_chars") == 1 and not np.isnan(raw).any()
    assert [len(x) for x in features(pa.array([], pa.string()), np.zeros(0))] == [0, 0, 1, 0]


def corpus(n, seed=2):
    r = random.Random(seed)
    good = lambda: " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(60)) + "."
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        rows.append((i, "!! ".join(good().upper().split()) if bad else good()))
        if r.random() < 0.7:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out(spark, docs):
    rows, labels = corpus(600)
    labels += [(None, 1, 0), (3, None, 0), (10**6, 0, 0)]
    df, truth = docs(*rows, (700, None), (701, ""), (None, "null id")).withColumnRenamed("lang", "score"), spark.createDataFrame(labels, LABELS)
    out = scored(df, train(df, truth)).collect()
    assert len(out) == 603 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    import zlib

    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    known = {d: q for d, q, _ in labels if q is not None}
    held = [(x.predicted, known[x.doc_id]) for x in out if x.held_out and x.doc_id in known]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    again = scored(df.repartition(7), train(df.repartition(3), truth)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_held_out_labels_do_not_count(spark, docs):
    rows, labels = corpus(300)
    import zlib

    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    a, b = (train(docs(*rows), spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_bound(spark, docs):
    rows, labels = corpus(200)
    assert np.isfinite(train(docs(*rows), spark.createDataFrame(labels, LABELS), rows=20).w).all()


def test_no_labels_or_one_kind(spark, docs):
    df = docs((1, "a"), (2, None))
    assert {round(x.score, 6) for x in scored(df, train(df, spark.createDataFrame([], LABELS))).collect()} == {0.5}
    ones = train(df, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS))
    assert all(x.score > 0.5 for x in scored(df, ones).collect())
    assert scored(df.limit(0), ones).collect() == []
    assert fit(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros((0, len(STATS))), np.zeros(0)).bias == 0


def test_accepted(spark, docs):
    rows, labels = corpus(300)
    df = docs(*rows).withColumnRenamed("lang", "score")
    model = train(df, spark.createDataFrame(labels, LABELS))
    want = sorted(x.doc_id for x in scored(df, model).collect() if x.predicted)
    out = accepted(df, model)
    assert out.schema == df.schema and sorted(x.doc_id for x in out.collect()) == want

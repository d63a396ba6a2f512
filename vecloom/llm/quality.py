"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words, hashed to ``BUCKETS`` buckets and scaled to
length 1; rates that describe its structure; and what its row says of it
(n_chars).  The score is the logistic of a bias, a weight a feature, and
pairwise interactions <v_i, v_j> x_i x_j of low rank, taken in linear time as
half of (sum of v x) squared less the sum of (v x) squared, by factor.

The model is fitted on a bounded sample of labelled rows: ``ROWS`` of them, by
order of a hash of doc_id, whatever the size of the corpus.  Only these rows'
features come to the driver.  Scoring goes through all texts in one pass,
without a shuffle; the model has a fixed size and is broadcast.

Defined cases: null text counts as empty and is scored like any text (all word
features 0); a null n_chars has a feature of its own; a very long text is scored
whole, in memory of some 20 times its bytes; labels with a null doc_id or quality
are not learned from; of rows that share a doc_id one is learned from; if all
labels learned from agree, or there are none, the score is their smoothed share;
repeated rows are scored as often as they occur; an empty table gives an empty
result; further columns are ignored by ``scored`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import map_texts, text_of

BUCKETS = 1 << 12
RANK = 8
#: Labelled rows that a model is fitted on, at most.
ROWS = 12_000
FOLDS = 5
CUT = 0.3
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 1e-5
#: Classes of bytes whose share a text's structure is described by.
BYTES = {
    "symbols": b"#*$%&<>@^~=_+\\/{}[]", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "shouts": b"!?", "bars": b"|", "points": b".,;:",
    "quotes": b"\"'()`-", "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
}
STATS = (*BYTES, "log_words", "word_length", "log_lines", "words_a_line", "repeated_lines", "repeated_words", "stutter", "long_words", "log_chars", "no_chars")


def features(column: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts of a column: bucket of each (text, bucket) pair, its value, n + 1 offsets, and the statistics (n by len(STATS))."""
    data, offsets = textnum.buffers(column)
    n = len(offsets) - 1
    starts, ends, bounds = textnum.word_spans(data, offsets)
    hashes = textnum.spans_hash(data, starts, ends, lower=True)
    words = np.diff(bounds)
    text = np.repeat(np.arange(n), words)
    key, count = np.unique(text * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    of, bucket = key // BUCKETS, key % BUCKETS
    at = np.searchsorted(of, np.arange(n + 1))
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(of, value**2, n))
    value = value / np.maximum(norm, 1e-9)[of]
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(offsets), 1)
    full = np.flatnonzero(np.diff(offsets))  # texts with bytes: between their starts nothing else lies
    columns = []
    for chars in BYTES.values():
        own, total = np.zeros(256, np.uint8), np.zeros(n)
        own[list(chars)] = 1
        if len(full):
            total[full] = np.add.reduceat(own[data], offsets[full], dtype=np.int64)
        columns.append(total / size)
    length = (ends - starts).astype(np.float64)
    # Lines: spans between line feeds, texts' ends included.
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feed + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data)) if len(begin) else begin
    line_text = np.searchsorted(offsets, begin, "right") - 1
    lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    hashed = textnum.spans_hash(data, begin, stop) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((hashed, line_text))
    again = (hashed[order][1:] == hashed[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])
    stutter = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    known = ~np.isnan(n_chars)
    columns += [
        np.log1p(words), np.bincount(text, length, n) / some, np.log1p(lines), np.log1p(words / lines), np.bincount(line_text[order][1:][again], minlength=n) / lines,
        1 - np.diff(at) / some, np.bincount(text[1:][stutter], minlength=n) / some, np.bincount(text[length > 20], minlength=n) / some,
        np.log1p(np.where(known, np.maximum(n_chars, 0), 0)), (~known).astype(float),
    ]
    return bucket, value, at, np.stack(columns, axis=1) if n else np.zeros((0, len(STATS)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    w: np.ndarray  # a weight a feature: buckets, then statistics
    v: np.ndarray  # a row of factors a feature

    def stats(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.scale, -4, 4) / 2

    def score(self, bucket: np.ndarray, value: np.ndarray, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        n, s = len(at) - 1, self.stats(raw)
        text = np.repeat(np.arange(n), np.diff(at))
        ws, vs = self.w[BUCKETS:], self.v[BUCKETS:]
        # Sums row by row, not by matrix product: a score must not depend on the batch that a row came in.
        along = lambda weights: (s * weights).sum(axis=1)
        linear = self.bias + along(ws) + np.bincount(text, self.w[bucket] * value, n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[bucket, f] * value
            pairs += (np.bincount(text, x, n) + along(vs[:, f])) ** 2 - np.bincount(text, x * x, n) - along(s * vs[:, f] ** 2)
        return 1 / (1 + np.exp(-np.clip(linear + pairs / 2, -30, 30)))


def fit(bucket: np.ndarray, value: np.ndarray, at: np.ndarray, raw: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    """A model for labels y (0 or 1), by Adam on the logistic loss; the same for the same rows."""
    mean, scale = (raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-3)) if len(y) else (np.zeros(len(STATS)), np.ones(len(STATS)))
    size, share = BUCKETS + len(STATS), (y.sum() + 0.5) / (len(y) + 1)
    r = np.random.default_rng(seed)
    m = Model(mean, scale, float(np.log(share / (1 - share))), np.zeros(size), r.normal(0, 0.02, (size, RANK)))
    if len(y) == 0 or y.min() == y.max():
        m.v[:] = 0
        return m
    stats, theta, step = m.stats(raw), np.concatenate([m.w[:, None], m.v], axis=1), 0
    first, second, bias = np.zeros_like(theta), np.zeros_like(theta), [m.bias, 0.0, 0.0]
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            x = np.zeros((len(rows), size))
            for i, row in enumerate(rows):
                x[i, bucket[at[row] : at[row + 1]]] = value[at[row] : at[row + 1]]
            x[:, BUCKETS:] = stats[rows]
            w, v = theta[:, 0], theta[:, 1:]
            xv, x2 = x @ v, x * x
            logit = bias[0] + x @ w + ((xv**2) - x2 @ (v**2)).sum(axis=1) / 2
            e = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            grad = np.concatenate([(x.T @ e)[:, None], x.T @ (e[:, None] * xv) - v * (x2.T @ e)[:, None]], axis=1) + DECAY * theta
            step += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            bias[1], bias[2] = 0.9 * bias[1] + 0.1 * e.sum(), 0.999 * bias[2] + 0.001 * e.sum() ** 2
            bias[0] -= RATE * (bias[1] / (1 - 0.9**step)) / (np.sqrt(bias[2] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, bias[0], theta[:, 0].copy(), theta[:, 1:].copy())


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("n_chars").cast("double").alias("n_chars"))


def held_out() -> Column:
    """The fold that is never learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textnum.parts(batches, "text"):
            bucket, value, at, raw = features(b.column(1), b.column(2).to_numpy(zero_copy_only=False))
            lists = [[bucket[i:j].astype("<u2").tobytes(), value[i:j].astype("<f4").tobytes()] for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), *(pa.array([x[k] for x in lists], pa.binary()) for k in (0, 1)), pa.array([x.tobytes() for x in raw], pa.binary())], ["doc_id", "quality", "buckets", "values", "stats"]
            )

    # At most ``rows`` small rows: that bound is what lets them go to every task.
    known = _columns(docs).join(F.broadcast(chosen), "doc_id")
    got = map_texts(known.select("doc_id", "text", "n_chars", F.col("quality").cast("int").alias("quality")), run, "doc_id long, quality int, buckets binary, values binary, stats binary")
    # A doc_id that repeats is learned from once (of several texts one, by order of what is known of them).
    got = got.groupBy("doc_id").agg(F.min(F.struct("quality", "buckets", "values", "stats")).alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    parts = [np.frombuffer(x, "<u2") for x in got["buckets"].to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    join = lambda column, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in got[column].to_pylist())])
    y = got["quality"].to_numpy().astype(float) if len(parts) else np.zeros(0)
    return fit(join("buckets", "<u2").astype(np.int64), join("values", "<f4").astype(float), at, join("stats", "<f8").reshape(-1, len(STATS)), y)


def scored(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textnum.parts(batches, "text"):
            score = sent.value.score(*features(b.column(1), b.column(2).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    out = map_texts(_columns(docs), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents that the model predicts 1 for, all columns as they were; rows are judged one by one, without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textnum.parts(batches, "text"):
            score = sent.value.score(*features(b.column(text), b.column(chars).cast(pa.float64()).to_numpy(zero_copy_only=False)))
            yield b.filter(pa.array(score >= cut))

    return map_texts(docs, run, docs.schema)

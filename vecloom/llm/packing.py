"""Best-fit packing: documents into as few fixed-length training sequences as best-fit decreasing finds.

Lengths are whole numbers of at most ``capacity``, and which bin best-fit
decreasing takes depends on lengths alone.  So the packing is worked out once,
for the whole corpus, over the histogram of lengths: equal pieces form one run,
bins with the same room left form ranges, and a segment tree over the remaining
capacities finds the tightest open bin for a run in logarithmic time.  The
outcome is a list of instructions ("pieces k to k+n of length L go to the bins
from b on, q to a bin, from place p on") whose number depends on the capacity,
not on the corpus; each piece then finds its instruction by its length and its
rank among pieces of that length, in parallel.  It is the packing that
one-by-one best-fit decreasing makes, without shards and so without their loss.

Defined cases: null text counts as empty and gives the end id alone; a document
longer than the capacity is cut into full pieces and a rest; ties go by doc_id,
then piece; repeated rows are packed as often as they occur; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import map_texts, staged, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that one task ranks.
RANKED = 100_000


class TightestFit:
    """A segment tree over remaining capacities: a node is set if an open bin below it has that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, length: int) -> int:
        """The least room of at least ``length`` that an open bin has; -1 if none has."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths (1 to ``capacity``).

    Returns instructions (length, first rank, pieces, pieces a bin, first bin,
    place in the bin), by descending length and ascending rank.
    """
    tree, rooms, bins = TightestFit(capacity), [[] for _ in range(capacity + 1)], 0
    out = []

    def leave(room: int, first: int, n: int) -> None:
        """n bins from ``first`` on have that much room."""
        if n and room:
            if not rooms[room]:
                tree.set(room, True)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.find(length)
            if room < 0:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                leave(room - each * length, first, full)
            if left and full < n:  # fewer pieces than one bin takes
                out.append((length, rank, left, left, first + full, capacity - room))
                leave(room - left * length, first + full, 1)
                full, left = full + 1, 0
            leave(room, first + full, n - full)
    return out


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of all documents, with their ids' checksums: one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        for batch in textnum.parts(batches, "text"):
            ids, bounds = encoder(tokenizer).encode(batch.column(1))
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = np.append(ids[a:b], end_id).astype("<u4")
                rows += [(doc, k, s, len(p := own[s : s + capacity]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(own), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_texts(rows, run, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, start and length.

    The pieces are read three times, so they should be a written table.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    steps = best_fit(histogram, capacity)
    salts = F.array(*[F.lit(-(-histogram.get(i, 1) // RANKED)) for i in range(capacity + 1)])
    keyed = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.get(salts, F.col("length").cast("int"))).cast("int"))
    groups = keyed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    groups = groups.select("length", "_salt", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start"))
    ranked = keyed.withColumn("_own", own).join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    # The number of steps is bounded by the capacity alone, so they may go to every task.
    table = np.array(steps or [(capacity, 0, 0, 1, 0, 0)], dtype=np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = spark.sparkContext.broadcast((table, np.searchsorted(table[:, 0], np.arange(capacity + 2))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, begin = sent.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.empty(len(length), np.int64)
            for value in np.unique(length):
                own = length == value
                first, last = begin[value], begin[value + 1]
                at[own] = first + np.searchsorted(steps[first:last, 1], rank[own], "right") - 1
            s = steps[at]
            k = rank - s[:, 1]
            keep = [i for i, name in enumerate(b.schema.names) if not name.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(s[:, 4] + k // s[:, 3]), pa.array(s[:, 5] + k % s[:, 3] * length)], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    names = [c for c in pieces.columns]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents: one row a piece with its sequence and its place there."""
    return pack(staged(cut(docs, tokenizer, capacity, end_id), "pieces"), capacity)

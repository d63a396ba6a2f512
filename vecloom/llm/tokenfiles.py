"""Token output: Arrow stream files of equal-length sequences, and flat files of ids.

``write_sequences`` range-sorts documents by doc_id, encodes them, ends each
with the end id and lays the ids of a partition end to end.  They are cut into
rows of ``length`` ids; a file is an Arrow IPC stream whose batches hold a
fixed number of rows of two fixed-size lists, ids and mask, the last row filled
up under a mask of false.  Mapped into memory, row i is at batch i // rows, so
any sequence is reached without a copy and without an index.  Ids take 16 bits
where the vocabulary allows.  Beside the files stands a small table of where
each document lies (file, place in the file, length), which is what maps rows
back to documents.

``flat`` files hold nothing but ids, little-endian, 16 or 32 bits.  As the end id
is all that parts their documents, the text of a special token ("<|endoftext|>")
is encoded as plain text there, never as the token; an end id that plain text
gives is refused.

Files are written under a temporary name and moved, so a task that runs again
(lost executor, speculation) leaves the same file; the table of places is
written by Spark and commits with its tasks.  One document at a time must fit a
task's memory; nothing else grows with the data.

Defined cases: null text counts as empty and gives the end id alone; a null
doc_id sorts first; rows with the same doc_id stand in the order of their
texts' hashes; an empty table gives no files and an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import fresh_path, local_path, map_texts, staged, text_of, write_once

#: Rows of a batch of a sequence file.
BATCH_ROWS = 64
PLACES = "file int, doc_id long, local_start long, n_tokens long"
#: Bytes of text that a task of the writer should get, at most.
TASK_BYTES = 32 << 20


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, apart: bool = False) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, ids with the end id after each document, and the number of ids of each; for parts of the batches.

    If ``apart``, the end id only ends documents: a special token's text within
    a document is plain text, and an end id that a document holds even so is refused.
    """
    from .tokens import encoder

    for part in textnum.parts(batches, "text"):
        ids, bounds = encoder(tokenizer, apart).encode(part.column(1))
        if apart and (ids == end_id).any():
            raise ValueError(f"the end id {end_id} stands for text of documents, so it cannot part them")
        yield part.column(0).to_pylist(), np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1


def id_type(tokenizer: str, end_id: int) -> np.dtype:
    from tokenizers import Tokenizer

    return np.dtype("<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")


class SequenceSink:
    """Writes ids as rows of a sequence file as they come; holds less than one batch."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind, self.rest = length, kind, np.zeros(0, kind)
        ids = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(ids, length)), pa.field("mask", pa.list_(pa.bool_(), length))], {"rows_per_batch": str(BATCH_ROWS)})
        self.writer = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids.astype(self.kind)])
        size = self.length * BATCH_ROWS
        for first in range(0, len(ids) - size + 1, size):
            self._batch(ids[first : first + size], size)
        self.rest = ids[len(ids) - len(ids) % size :]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if n := len(self.rest):
            self._batch(np.append(self.rest, np.zeros(-n % self.length, self.kind)), n)
        self.writer.close()


class SequenceFile:
    """A sequence file for reading: row i of all in constant time, without a copy where the file can be mapped."""

    def __init__(self, uri: str):
        system, path = local_path(uri)
        source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of row i (a view of the file) and its mask."""
        b, k = self.batches[i // BATCH_ROWS], i % BATCH_ROWS
        return b.column(0)[k].values.to_numpy(), b.column(1)[k].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place ``start`` of the file on."""
        out, size = [], self.batches[0].column(0).type.list_size * BATCH_ROWS if self.batches else 1
        while n > 0:
            values = self.batches[start // size].column(0).flatten().to_numpy()[start % size : start % size + n]
            out.append(values)
            start, n = start + len(values), n - len(values)
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint16), *out])


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, range-partitioned and sorted by doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")


def write_sequences(docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Write all documents as sequence files below ``path``; returns where each lies (file, doc_id, local_start, n_tokens)."""
    kind = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, place = TaskContext.get().partitionId(), [], 0
        parts = encoded(batches, tokenizer, end_id)
        first = next(parts, None)
        if first is None:
            return

        def write(sink) -> None:
            nonlocal place
            file = SequenceSink(sink, length, kind)
            for docs_, ids, counts in (part for group in ([first], parts) for part in group):
                file.add(ids)
                starts = place + np.cumsum(counts) - counts
                out.append((docs_, starts, counts))
                place += int(counts.sum())
            file.close()

        write_once(f"{path}/part-{number:06d}.arrows", write)
        for docs_, starts, counts in out:
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(docs_), pa.int32()), pa.array(docs_, pa.int64()), pa.array(starts), pa.array(counts)], ["file", "doc_id", "local_start", "n_tokens"])

    return staged(map_texts(in_order(docs), run, PLACES), "places")


def read_sequences(places: DataFrame, path: str) -> DataFrame:
    """Every document read back from its file: doc_id, start, n_tokens and ids_crc32.

    A file is read by one task, document by document; documents of a file are
    sorted by place, so the file is gone through once.
    """
    files = places.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row a file
    ahead = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, file = None, None
        for b in batches:
            crc = []
            for f, start, n in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "local_start", "n_tokens"))):
                if f != number:
                    number, file = f, SequenceFile(f"{path}/part-{f:06d}.arrows")
                crc.append(zlib.crc32(file.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crc, pa.int64())], [*b.schema.names, "ids_crc32"])

    rows = places.join(ahead, "file").select("file", "doc_id", "local_start", "n_tokens", "ahead")
    rows = rows.repartition("file").sortWithinPartitions("file", "local_start").mapInArrow(run, PLACES + ", ahead long, ids_crc32 long")
    return rows.select("doc_id", (F.col("ahead") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def sequence_output(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write documents as sequence files in the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "sequences")
    return read_sequences(write_sequences(docs, path, tokenizer, end_id, length), path)


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write ids as flat files, in the table's own order, without a shuffle; returns file, number and bytes of each, and its doc_ids in order."""
    kind = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, order = TaskContext.get().partitionId(), []
        parts = encoded(batches, tokenizer, end_id, apart=True)
        first = next(parts, None)
        if first is None:
            return
        size = 0

        def write(sink) -> None:
            nonlocal size
            for docs_, ids, _ in (part for group in ([first], parts) for part in group):
                sink.write(raw := ids.astype(kind).tobytes())
                size += len(raw)
                order.append(docs_)

        write_once(f"{path}/part-{number:06d}.bin", write)
        at = 0
        for docs_ in order:
            n = len(docs_)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{path}/part-{number:06d}.bin"] * n), pa.array([size] * n, pa.int64()), pa.array(np.arange(at, at + n)), pa.array(docs_, pa.int64())], ["file", "bytes", "ordinal", "doc_id"]
            )
            at += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return staged(map_texts(rows, run, "file string, bytes long, ordinal long, doc_id long"), "flat")


def flat_files(written: DataFrame) -> DataFrame:
    """file and bytes, a row a flat file."""
    return written.groupBy("file").agg(F.max("bytes").alias("bytes"))



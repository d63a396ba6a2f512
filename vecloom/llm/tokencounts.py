"""Token counts from flat, unindexed token files: a separator scan.

Files are cut into blocks of fixed size, whatever lies in them.  Each block is
searched for the end-of-document id in one vectorised comparison and reports
the places of its separators.  A prefix scan over the blocks of a file then
stitches documents across block borders: the last separator before a block
tells where its first document began, the number of separators before it gives
its first ordinal.  Blocks are scanned in parallel and no index is needed.

Defined cases: ids after the last separator of a file are a document too (of
``ended`` false); a file of separators only gives documents of length 1 (the
separator counts); an empty file or table gives no rows; a file whose size is
no multiple of the id's width is refused.  Documents are encoded so that none
holds the end id: a special token's text in a document counts as the tokens of
plain text (see ``tokenfiles``).  Null text counts as empty (the separator
alone); rows that repeat, or share a doc_id, are documents each; a null doc_id is
returned as it is; a very long document stretches over as many blocks as it
needs; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, local_path, staged
from .tokenfiles import flat_files, id_type, write_flat

#: Bytes of a block.
BLOCK = 4 << 20
SCANNED = "file string, block long, tokens long, ends array<int>"


def scan(files: DataFrame, end_id: int, width: int, block: int = BLOCK) -> DataFrame:
    """file, block, tokens and ends (places of separators in the block) of every block; files has file and bytes."""
    kind, block = np.dtype(f"<u{width}"), block // width * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, number in zip(*(b.column(i).to_pylist() for i in range(3))):
                if size % width:
                    raise ValueError(f"{file}: {size} bytes are no whole number of ids")
                system, path = local_path(file)
                with system.open_input_file(path) as f:
                    raw = f.read_at(min(block, size - number * block), number * block)
                ids = np.frombuffer(raw, dtype=kind)
                ends = np.flatnonzero(ids == end_id).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), lists], ["file", "block", "tokens", "ends"])

    number = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {block}"))).alias("block")
    blocks = files.where("bytes > 0").select("file", "bytes", number)
    return blocks.repartition("file", "block").mapInArrow(run, SCANNED)


def stitch(scanned: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens and ended of every document, from the scanned blocks."""
    per = block // width
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    # One row a block: the list of its separators stays aside.
    last = F.when(F.size("ends") > 0, F.col("block") * per + F.element_at("ends", -1).cast("long") + 1)
    head = scanned.select("file", "block", "tokens", F.size("ends").alias("_n"), last.alias("_last"))
    head = head.select(
        "file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ordinal"), F.coalesce(F.max("_last").over(before), F.lit(0)).alias("_open"),
        F.sum("_n").over(every).alias("_ends"), F.sum("tokens").over(every).alias("_tokens"), F.coalesce(F.max("_last").over(every), F.lit(0)).alias("_tail"),
    )
    docs = scanned.join(head, ["file", "block"]).select("file", "block", "_ordinal", "_open", F.posexplode("ends").alias("_k", "_end"), F.col("ends").alias("_all"))
    start = F.when(F.col("_k") == 0, F.col("_open")).otherwise(F.col("block") * per + F.get("_all", F.col("_k") - 1) + 1)
    end = F.col("block") * per + F.col("_end") + 1
    ended = docs.select("file", (F.col("_ordinal") + F.col("_k")).alias("ordinal"), start.alias("start"), (end - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = head.where("block = 0 AND _tokens > _tail").select("file", F.col("_ends").alias("ordinal"), F.col("_tail").alias("start"), (F.col("_tokens") - F.col("_tail")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def token_counts(files: DataFrame, end_id: int, width: int, block: int = BLOCK) -> DataFrame:
    """Token counts of every document of flat files (file, bytes)."""
    return stitch(staged(scan(files, end_id, width, block), "blocks"), width, block)


def document_counts(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Encode documents into flat files, and count their tokens from these alone: doc_id, file number, ordinal, start, n_tokens."""
    written = write_flat(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer, end_id)
    counts = token_counts(flat_files(written), end_id, id_type(tokenizer, end_id).itemsize, block)
    out = written.join(counts, ["file", "ordinal"], "left")
    return out.select("doc_id", F.regexp_extract("file", r"part-([0-9]+)\.bin$", 1).cast("long").alias("file"), "ordinal", "start", "n_tokens")

"""What the operators share: tables, the shared folder, staging, joins with a checked size."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import fresh_path, release, remove, shared_dir, staged  # noqa: F401

#: White space that separates words, as bytes; a word is a run of anything else.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that go to a Python worker at once (or one text, if longer).
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def null_key(column: str | Column) -> Column:
    """A string key that is never null, tells null from every string and sorts it last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~"))


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` for rows that hold texts, in batches of at most about ``BATCH_BYTES``.

    Spark fills batches by number of rows up to a bound of 64 MB, which both the
    executor and the worker hold more than once; the bound is the session's
    setting, which is lowered here unless the session sets it itself.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_prefix(df: DataFrame, prefix: str = "_x") -> str:
    """``prefix``, with underscores behind it until no column of ``df`` starts so in any case."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def salted_join(df: DataFrame, small: DataFrame, keys: list[str], how: str, salts: int = 32) -> DataFrame:
    """Join with a table of one row a key so that each key's rows (null ones too) spread over ``salts`` tasks.

    Rows are dealt by their place, so ``df`` should be a written table, which is read in the same order again.
    """
    salt = free_name(df, "_salt")
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(spread, [*keys, salt], how).drop(salt)


def join_small(df: DataFrame, small: DataFrame, keys: list[str], *, rows: int = 20_000, salts: int = 32) -> DataFrame:
    """Left join of a written table with one of one row a key, without sending a hot key to one task.

    ``small`` is counted: up to ``rows`` rows it is broadcast; beyond that both
    sides are salted, so that a key's rows spread over ``salts`` tasks.
    """
    if small.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(small), keys, "left")
    return salted_join(df, small, keys, "left", salts)


def join_ids(df: DataFrame, ids: DataFrame, how: str, *, key: str = "doc_id", rows: int = 1_000_000) -> DataFrame:
    """Join a written table of wide rows with a written table of small rows, one an id.

    The ids are counted: up to ``rows`` of them (some 16 MB) they are broadcast,
    so that the texts stay where they are; beyond that both sides are shuffled,
    salted, as an id (or null) may be that of very many rows.
    """
    return df.join(F.broadcast(ids), key, how) if ids.limit(rows + 1).count() <= rows else salted_join(df, ids, [key], how, 8)


def local_path(uri: str) -> tuple[object, str]:
    """pyarrow's file system and path of a URI: local, hdfs, s3, gcs and so on."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, write) -> None:
    """Run ``write(sink)`` into a temporary name, then move it in place.

    A task that is run again (lost executor, speculation) writes the same
    bytes under the same final name; readers never see half a file.
    """
    system, path = local_path(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as sink:
        write(sink)
    system.move(temporary, path)

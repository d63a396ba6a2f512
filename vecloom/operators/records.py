"""Reads and changes of a collection as DataFrame algebra: nothing here writes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import Equal, where


def get(df: DataFrame, record_id: int) -> DataFrame:
    return df.where(F.col("id") == F.lit(record_id))


def get_batch(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of ids (pos, id), in the order of pos; an id that repeats is returned again, a missing one is left out."""
    return ids.select("pos", F.col("id").cast("long").alias("id")).join(df, "id").select("pos", *df.columns)


def deleted(df: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left without the ids."""
    return df.join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_anti")


def count_deleted(df: DataFrame, ids: DataFrame) -> DataFrame:
    """How many records the ids delete (an id that repeats counts once), as n."""
    return df.select("id").join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_semi").agg(F.count("*").alias("n"))


def find_ids(df: DataFrame, field: str, value: Any, struct: str | None = "metadata") -> DataFrame:
    return where(df, Equal(field, value), struct=struct).select("id")


def numbered(df: DataFrame, order: Sequence[str], next_id: int = 1) -> DataFrame:
    """Give new rows dense ids from ``next_id`` on, in the given order.

    The order is made by a range sort; row numbers are offsets of partitions
    (one number each) plus places within them, so no task sees all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return dense(ranged, next_id)


def dense(df: DataFrame, next_id: int) -> DataFrame:
    """Replace _at (monotonically increasing, sparse) by a dense id in the same order; df must be stable."""
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    out = df.withColumn("_part", part).join(offsets, "_part")
    return out.select((F.col("_offset") + place + next_id).alias("id"), *[c for c in df.columns if c not in ("_at", "id")])


def upserted(df: DataFrame, new: DataFrame, key: str, next_id: int, struct: str | None = None) -> DataFrame:
    """Apply new rows (pos, then the columns of df but id) in order: each replaces the records of its key.

    Of rows with one key the last wins; every row uses up an id, as one by one.
    A new row without a key is refused: the query fails when it meets one.
    """
    at = lambda name: F.col(f"{struct}.`{name}`") if struct else F.col(f"`{name}`")
    number = F.row_number().over(Window.partitionBy(at(key)).orderBy(F.desc("pos")))
    keyed = F.when(at(key).isNull(), F.raise_error(F.lit(f"a new row has no {key}"))).otherwise(F.lit(True))
    last = new.where(keyed).withColumn("_upsert_n", number).where("_upsert_n = 1")
    keys = last.select(at(key).alias("_upsert_key")).distinct()
    kept = df.withColumn("_upsert_key", at(key)).join(keys, "_upsert_key", "left_anti").drop("_upsert_key")
    fresh = last.withColumn("id", F.col("pos").cast("long") + next_id).select(*df.columns)
    return kept.select(*df.columns).unionByName(fresh)

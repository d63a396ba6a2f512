"""Feeding collections from streams, and following one's changes.

``ingest`` is a sink: each micro-batch becomes one logged change, committed once.
Structured Streaming hands a batch that may have been written before the same
number again; numbers are kept with the collection, so it is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Insert a stream's rows (vector, metadata, text) into a collection."""

    def write(batch: DataFrame, number: int) -> None:
        done = collection._state.get("batches", {})
        if done.get(name, -1) >= number:
            return
        with collection._db._lock:
            collection.insert_df(batch, batches={**done, name: number})

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changes(collection: Collection, since: int = 0) -> DataFrame:
    """Logged changes after a catalog version, since the last snapshot: seq, op, id, and the inserted record.

    A checkpoint may put a long log together under its last number, so a change may be seen again, never missed.
    """
    db, state = collection._db, collection._state
    out = db.spark.createDataFrame([], "seq long, op string, id long")
    for x in state["log"]:
        if x["seq"] > since:
            rows = db.spark.read.parquet(db._at(x["path"]))
            out = out.unionByName(rows.select(F.lit(x["seq"]).cast("long").alias("seq"), F.lit(x["op"]).alias("op"), *rows.columns), allowMissingColumns=True)
    return out

"""Connected components over a table of links, by alternating large and small stars.

Every round joins small rows only, writes its links to the shared folder and
compares them with the last round's by number and hash; neither nodes nor links
come to the driver.  Links end as stars around each component's least node.
That node is the key of all of a large component's links; its least neighbour is
aggregated before it is shuffled and joined back from a written table, so that
adaptive execution splits the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of every node in ``links`` (a, b) that is not the least itself."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = staged(now, "links")
    last = _print(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l"))
        now = staged(small.select("l.u", "l.v").where("u <> v").distinct(), "links")
        this = _print(now)
        if this == last:
            break
        last = this
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))

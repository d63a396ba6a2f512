import pyarrow as pa
from pyspark.sql import functions as F

from vecloom.llm import common


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])


def test_batches_of_texts_are_bounded(spark):
    key, before = common._BATCH, spark.conf.get(common._BATCH, None)
    rows = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("text"))  # 20 MB
    try:
        spark.conf.unset(key)
        got = [r["n"] for r in common.map_texts(rows, sizes, "n long").collect()]
        assert sum(got) == 2000 and max(got) * 10_000 <= 2 * common.BATCH_BYTES
        spark.conf.set(key, str(64 << 20))  # a setting of the session's own stays
        assert [r["n"] for r in common.map_texts(rows, sizes, "n long").collect()] == [2000]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

"""Long texts reach Python a few at a time, whatever their number of rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import common


def test_batches_end_at_their_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    common.small_batches(spark)
    assert int(spark.conf.get(common._BYTES).rstrip("bB")) <= common.BATCH_BYTES
    texts = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    got = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 300 and max(r["bytes"] for r in got) < 2 * common.BATCH_BYTES
    # a smaller bound that was set stays
    spark.conf.set(common._BYTES, "1000000")
    common.small_batches(spark)
    assert spark.conf.get(common._BYTES).rstrip("bB") == "1000000"
    spark.conf.set(common._BYTES, str(common.BATCH_BYTES))

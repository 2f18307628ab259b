"""Files of the deduplicated rows: about one per hour and batch, not one per task and hour."""

import glob

from pyspark.sql import functions as F

from tickforge.streaming import late


def test_hours_are_written_side_by_side(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with data that fills every task
    try:
        rows = spark.range(4000, numPartitions=4).select(F.col("id").alias("trade_id"), (F.col("id") % 48 * 3600).alias("ts"))
        late.dedup_with_late_rows(str(tmp_path), ["trade_id"])(rows.union(rows), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert late.read_deduped(spark, str(tmp_path)).count() == 4000
    assert len(glob.glob(f"{tmp_path}/rows/batch=0/hour=*/*.parquet")) == 48

"""A running leakage census: batches of scored pairs merged into one table of best scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def best_scores(crossing: DataFrame) -> DataFrame:
    """Per test item the best cosine and the least Hamming distance so far; works on streams and tables."""
    return crossing.groupBy("test").agg(F.max("cosine").alias("cosine"), F.min("hamming").alias("hamming"))


def windowed_counts(events: DataFrame, time_col: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped from state."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def keep_running(crossing: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the running census after each batch; a reader counts the rows over its thresholds."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return best_scores(crossing).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).start()

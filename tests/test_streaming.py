"""The running census over batches of scored pairs: an extension, the reference has no streams."""

import datetime as dt

from pyspark.sql import functions as F

from veriset.streaming import census


def test_running_census_keeps_the_best_scores(spark, tmp_path):
    schema = "test long, train long, cosine double, hamming int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([[(1, 5, 0.2, 9), (2, 5, 0.9, 20)], [(1, 6, 0.5, 12)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = census.keep_running(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
        got = {r.test: (r.cosine, r.hamming) for r in spark.read.parquet(f"{out}/batch={k}").collect()}
        assert got == [{1: (0.2, 9), 2: (0.9, 20)}, {1: (0.5, 9), 2: (0.9, 20)}][k]


def test_windowed_counts(spark):
    rows = [(dt.datetime(2024, 1, 1, h, m), e) for h, m, e in ((0, 5, "a"), (0, 50, "a"), (1, 0, "a"), (1, 30, "b"))]
    table = spark.createDataFrame(rows, "ts timestamp, event_type string")
    got = sorted((r.start.hour, r.event_type, r.n) for r in census.windowed_counts(table).select(F.col("start"), "event_type", "n").collect())
    assert got == [(0, "a", 2), (1, "a", 1), (1, "b", 1)]

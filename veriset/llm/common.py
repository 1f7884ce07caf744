"""What the training-data operators share: inputs, Arrow batches and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriset.operators.shipping import prepare  # noqa: F401 - what every kernel needs first

#: ASCII white space of every contract: the space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a kernel holds at once.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(x: Column) -> Column:
    """Lower-case A to Z only; ``lower`` does just that where a text is ASCII."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``id`` and ``body`` (UTF-8 bytes; a null text is empty): nothing else of the table is read."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"), *more)


def chunks(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose ``body`` holds about ``most`` bytes; a longer text comes alone."""
    for batch in batches:
        body = batch.column(batch.schema.get_field_index("body"))
        sizes = np.diff(np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]) if len(body) else np.zeros(0, int)
        at = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(batch):
            yield batch.slice(at)


def raw(body: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array and the offsets of its values in them."""
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = body.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt by range, each with the number ``_pid`` of its partition; lower ranges have lower numbers."""
    return df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())


def prefix_sums(placed: DataFrame, order: list[Column], measures: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """For each measure its sum before the row (``name``) and in all (``name_total``), by ``keys``.

    ``placed`` comes from ``in_ranges`` and was written, so that its partition
    numbers are fixed.  Only one row per partition and key is ever brought
    together; rows themselves are summed within their own partition.
    """
    totals = placed.groupBy("_pid", *keys).agg(*(F.sum(m).alias(k) for k, m in measures.items()))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    bases = totals.select("_pid", *keys, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}_base") for k in measures), *(F.sum(k).over(whole).alias(f"{k}_total") for k in measures))
    inner = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(bases, ["_pid", *keys])
    return rows.select(*placed.columns, *(f"{k}_total" for k in measures), *((F.col(f"_{k}_base") + F.coalesce(F.sum(m).over(inner), F.lit(0))).alias(k) for k, m in measures.items()))

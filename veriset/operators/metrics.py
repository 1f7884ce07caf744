"""Confusion counts to dataset metrics: ratios of sums per class, then means over present classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions.columns import ratio

IGNORE = 255


def confusion(rows: DataFrame, keys: tuple[str, ...] = ("item",), classes: int = 116, count: str | None = None) -> DataFrame:
    """Rows ``keys, label, pred`` (each as often as ``count`` says) -> ``keys, class_id, inter, uni, n_pred, n_label``; ignored labels drop from both sides."""
    counted = rows.where(F.col("label") != IGNORE).groupBy(*keys, "label", "pred").agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"))  # cells, not rows, are spread
    same = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    both = F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("l"), zero.alias("p"), same.alias("s")), F.struct(F.col("pred").alias("c"), zero.alias("l"), F.col("n").alias("p"), zero.alias("s")))
    sides = counted.select(*keys, F.explode(both).alias("s")).where((F.col("s.c") >= 0) & (F.col("s.c") < classes))
    out = sides.groupBy(*keys, F.col("s.c").alias("class_id")).agg(F.sum("s.s").alias("inter"), F.sum("s.p").alias("n_pred"), F.sum("s.l").alias("n_label"))
    return out.select(*keys, "class_id", "inter", (F.col("n_pred") + F.col("n_label") - F.col("inter")).alias("uni"), "n_pred", "n_label")


def class_sums(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return parts.groupBy(*keys, "class_id").agg(*(F.sum(c).alias(c) for c in ("inter", "uni", "n_pred", "n_label")))


def scores(sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean IoU and accuracy with and without class 0 in one pass; absent classes count nowhere."""
    iou, acc, fore = ratio(F.col("inter"), F.col("uni")), ratio(F.col("inter"), F.col("n_label")), F.col("class_id") > 0
    pick = lambda x, name: F.round(F.avg(x), 6).alias(name)
    return sums.groupBy(*keys).agg(pick(iou, "miou_all"), pick(F.when(fore, iou), "miou_fore"), pick(acc, "macc_all"), pick(F.when(fore, acc), "macc_fore"))


def boundary(tp: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, tp, fp, fn`` rows -> boundary IoU and F1 of their sums, null where undefined."""
    s = tp.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return s.select(*keys, ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("boundary_iou"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("boundary_f1"))


def relabel(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Non-zero labels of the listed items become the item's target (a small table of items)."""
    return rows.join(targets.select("item", "target"), "item", "left").withColumn("label", F.when((F.col("label") > 0) & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("label"))).drop("target")


def label_range(rows: DataFrame, key: str = "item") -> DataFrame:
    """``key, low, high, n_values`` of the labels of each item."""
    return rows.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_distinct("label").alias("n_values"))

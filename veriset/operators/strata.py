"""Strata of items by cuts fitted on the training items, and metrics within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.functions.columns import ratio

LEVELS = ("low", "mid", "high")
AXES = ("size", "chr", "edge", "frequency")


def tertiles(values: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the cuts at a third and two thirds, interpolated."""
    q = F.percentile(column, F.array(F.lit(1.0) / 3, F.lit(2.0) / 3))
    return values.agg(q.alias("q")).select(F.col("q")[0].alias(f"{prefix}_0"), F.col("q")[1].alias(f"{prefix}_1"))


def level(value: Column, low: Column, high: Column) -> Column:
    """How many cuts the value exceeds, by name; a value at a cut belongs below it."""
    return F.when(value > high, LEVELS[2]).when(value > low, LEVELS[1]).otherwise(LEVELS[0])


def class_frequencies(pixels: DataFrame, train: DataFrame, classes: int = 115) -> DataFrame:
    """``item, class_id, n`` -> ``class_id, frequency`` over the training items, 0 for classes that none of them holds."""
    known = pixels.join(train.select("item"), "item", "left_semi").groupBy("class_id").agg(F.sum("n").alias("f"))
    every = pixels.sparkSession.range(1, classes + 1).select(F.col("id").alias("class_id"))
    return every.join(known, "class_id", "left").select("class_id", F.coalesce("f", F.lit(0)).cast("long").alias("frequency"))


def rarest(pixels: DataFrame, frequencies: DataFrame, items: DataFrame) -> DataFrame:
    """``item, rarest``: the least training frequency among the classes an item holds; 0 for an item that holds none."""
    met = pixels.where("n > 0").join(frequencies, "class_id").groupBy("item").agg(F.min("frequency").alias("f"))
    return items.select("item").join(met, "item", "left").select("item", F.coalesce("f", F.lit(0)).cast("long").alias("rarest"))


def strata(features: DataFrame, pixels: DataFrame, train: DataFrame, classes: int = 115) -> DataFrame:
    """``item, size_ratio, chr_value, edge_contact`` and class pixels -> ``item`` and its level on each axis.

    All cuts are fitted on the training items; frequency cuts on the classes that they hold.
    """
    frequencies = class_frequencies(pixels, train, classes)
    fitted = features.join(train.select("item"), "item", "left_semi")
    cuts = tertiles(fitted, "size_ratio", "size").join(tertiles(fitted, "chr_value", "chr")).join(tertiles(frequencies.where("frequency > 0"), "frequency", "freq"))  # one row each
    rows = features.join(rarest(pixels, frequencies, features), "item").join(F.broadcast(cuts))
    return rows.select(
        "item", level(F.col("size_ratio"), F.col("size_0"), F.col("size_1")).alias("size"), level(F.col("chr_value"), F.col("chr_0"), F.col("chr_1")).alias("chr"),
        F.when(F.col("edge_contact"), "edge").otherwise("interior").alias("edge"), level(F.col("rarest"), F.col("freq_0"), F.col("freq_1")).alias("frequency"))


def by_stratum(parts: DataFrame, items: DataFrame) -> DataFrame:
    """Every cell once for the whole and once for its level on each axis: ``axis, level`` beside its columns."""
    whole = F.struct(F.lit("overall").alias("axis"), F.lit("all").alias("level"))
    each = F.array(whole, *(F.struct(F.lit(a).alias("axis"), F.col(a).alias("level")) for a in AXES))
    return parts.join(items, "item").withColumn("_at", F.explode(each)).select(*parts.columns, "_at.axis", "_at.level")


def report(parts: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Per run, axis and level: items, and the four means of ratios of sums.  Each cell is summed by class before it is spread."""
    rows = parts.join(items, "item")
    cells = rows.groupBy(*keys, *AXES, "class_id").agg(*(F.sum(c).alias(c) for c in ("inter", "uni", "n_label")))
    spread = lambda df: df.withColumn("_at", F.explode(F.array(F.struct(F.lit("overall").alias("axis"), F.lit("all").alias("level")), *(F.struct(F.lit(a).alias("axis"), F.col(a).alias("level")) for a in AXES)))).select("*", "_at.axis", "_at.level")
    sums = spread(cells).groupBy(*keys, "axis", "level", "class_id").agg(*(F.sum(c).alias(c) for c in ("inter", "uni", "n_label")))
    iou, acc, fore = ratio(F.col("inter"), F.col("uni")), ratio(F.col("inter"), F.col("n_label")), F.col("class_id") > 0
    mean = lambda x, name: F.round(F.avg(x), 6).alias(name)
    scores = sums.groupBy(*keys, "axis", "level").agg(mean(iou, "miou_all"), mean(F.when(fore, iou), "miou_fore"), mean(acc, "macc_all"), mean(F.when(fore, acc), "macc_fore"))
    counts = spread(rows.select(*keys, *AXES, "item").distinct()).groupBy(*keys, "axis", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(scores, [*keys, "axis", "level"])

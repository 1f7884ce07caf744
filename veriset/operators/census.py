"""Leakage census: which test items have a training partner, by any threshold, from one table of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.functions.columns import wilson


def across(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs between test and train, either way round: ``test, train, cosine, hamming``; val is ignored."""
    side = lambda c: items.select(F.col("id").alias(c), F.col("split").alias(f"s_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("(s_a = 'test' and s_b = 'train') or (s_a = 'train' and s_b = 'test')")
    first = F.col("s_a") == "test"
    return met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("test"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("train"), "cosine", "hamming")


def leaked(crossing: DataFrame, items: DataFrame, where: Column) -> DataFrame:
    """The test items with at least one partner (a semi join)."""
    return items.where("split = 'test'").join(crossing.where(where).select(F.col("test").alias("id")), "id", "left_semi")


def rate(crossing: DataFrame, items: DataFrame, where: Column) -> DataFrame:
    """``n_test, n_leaked, rate`` and the Wilson interval in one row."""
    hit = crossing.where(where).select(F.col("test").alias("id")).distinct().withColumn("hit", F.lit(1))
    found = items.where("split = 'test'").join(hit, "id", "left").agg(F.count(F.lit(1)).alias("n_test"), F.count("hit").alias("n_leaked"))
    low, high = wilson(F.col("n_leaked"), F.col("n_test"))
    return found.select("n_test", "n_leaked", F.round(F.try_divide("n_leaked", "n_test"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def grid(crossing: DataFrame, n_test: DataFrame, cosines: list[float], hammings: list[int]) -> DataFrame:
    """The leakage rate at every pair of thresholds from the same edges: a small table of thresholds, no further join of items."""
    best = crossing.groupBy("test").agg(F.max("cosine").alias("c"), F.min("hamming").alias("h"))
    points = F.array(*(F.struct(F.lit(h).alias("ham"), F.lit(c).alias("cos")) for h in hammings for c in cosines))
    hits = best.select("c", "h", F.explode(points).alias("p")).groupBy("p").agg(F.count_if((F.col("c") >= F.col("p.cos")) | (F.col("h") <= F.col("p.ham"))).alias("n_leaked"))
    return hits.join(F.broadcast(n_test)).select(F.col("p.ham").alias("ham"), F.col("p.cos").alias("cos"), "n_leaked", F.round(F.try_divide("n_leaked", "n_test"), 6).alias("rate"))

"""Blind audits of candidate pairs: sampling, sealed keys, adjudication, agreement, precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriset.functions.columns import hex_draw, wilson
from veriset.operators.gates import GateError, expect_all, expect_same_keys, expect_unique

ANSWERS = ("duplicate", "non-duplicate")


def tagged_union(**edges: DataFrame) -> DataFrame:
    """Edge tables ``a, b`` one under the other, each row with the name of its table as ``kind``."""
    out = None
    for kind, rows in edges.items():
        part = rows.select(F.lit(kind).alias("kind"), "a", "b")
        out = part if out is None else out.unionByName(part)
    return out


def blind_sample(edges: DataFrame, most: int = 100, seed: int = 0) -> DataFrame:
    """``kind, a, b`` -> ``pair_id, kind, a, b, image_1, image_2``: at most ``most`` of each kind, shuffled, sides swapped by lot.

    Lots are hashes of the seed and the pair, so any engine draws the same ones.  Only
    the rows drawn, ``most`` of each kind, are numbered in one task.
    """
    name = F.concat_ws(":", F.lit(str(seed)), F.col("kind"), F.col("a").cast("string"), F.col("b").cast("string"))
    lots = edges.select("kind", "a", "b", F.md5(name).alias("lot"))
    drawn = lots.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("lot", "a", "b"))).where(F.col("nth") <= most)
    numbered = drawn.withColumn("number", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("order"), "lot")), "kind", "a", "b")))
    swap = hex_draw(F.md5(F.concat(F.lit("side"), "lot"))) % 2 == 1
    return numbered.select(
        F.format_string("PAIR-%04d", "number").alias("pair_id"), "kind", "a", "b",
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("image_1"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("image_2"))


def reviewer_sheet(sample: DataFrame, path_of: DataFrame | None = None) -> DataFrame:
    """What a reviewer may see: pair and blind file names (with the extension that ``path_of``, ``key, path``, knows), nothing of kinds and keys."""
    if path_of is None:
        names = [F.concat("pair_id", F.lit(f"_{k}")).alias(f"image_{k}") for k in (1, 2)]
        return sample.select("pair_id", *names, F.lit("").alias("verdict"), F.lit("").alias("notes"))
    out = sample
    for k in (1, 2):
        side = path_of.select(F.col("key").alias(f"image_{k}"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias(f"ext_{k}"))
        out = out.join(side, f"image_{k}")
    names = [F.concat("pair_id", F.lit(f"_{k}"), F.col(f"ext_{k}")).alias(f"image_{k}") for k in (1, 2)]
    return out.select("pair_id", *names, F.lit("").alias("verdict"), F.lit("").alias("notes"))


def sealed_key(sample: DataFrame) -> DataFrame:
    """What is opened after the review: kind and the true keys of both sides."""
    return sample.select("pair_id", F.col("kind").alias("candidate_kind"), F.create_map(F.lit("1"), F.col("image_1"), F.lit("2"), F.col("image_2")).alias("mapping"))


def _said(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def adjudicate(reviews: DataFrame) -> DataFrame:
    """``pair_id, first, second, consensus`` -> also ``verdict, disputed``.

    Agreeing reviewers win; a consensus that contradicts them raises, as do a missing
    verdict and a dispute without a consensus.
    """
    one, two, agreed = _said("first"), _said("second"), _said("consensus")
    valid = one.isin(*ANSWERS) & two.isin(*ANSWERS)
    same = one == two
    problem = (
        F.when(~valid, F.lit("both verdicts are required"))
        .when(same & (agreed != "") & (agreed != one), F.lit("consensus contradicts agreeing reviewers"))
        .when(~same & ~agreed.isin(*ANSWERS), F.lit("a dispute needs a consensus"))
    )
    told = reviews.select("*", F.when(same, one).otherwise(agreed).alias("verdict"), (~same).alias("disputed"), problem.alias("_problem"))
    expect_all(told.select("pair_id", "_problem"), F.col("_problem").isNull(), "review")
    return told.drop("_problem")


def join_reviews(first: DataFrame, second: DataFrame, key: DataFrame, adjudication: DataFrame) -> DataFrame:
    """Two reviewers' sheets, the sealed key and the adjudications: ``pair_id, kind, first, second, consensus``.

    All must hold the same pairs once each, and exactly the disputed ones are adjudicated.
    """
    for rows in (first, second, key, adjudication):
        expect_unique(rows, "pair_id")
    expect_same_keys(first, second, "pair_id")
    expect_same_keys(first, key, "pair_id")
    both = first.select("pair_id", _said("verdict").alias("first")).join(second.select("pair_id", _said("verdict").alias("second")), "pair_id")
    expect_same_keys(both.where(F.col("first") != F.col("second")), adjudication, "pair_id")
    told = both.join(key.select("pair_id", F.lower(F.trim("candidate_kind")).alias("kind")), "pair_id")
    return told.join(adjudication.select("pair_id", _said("consensus_verdict").alias("consensus")), "pair_id", "left").withColumn("consensus", F.coalesce("consensus", F.lit("")))


def agreement(reviews: DataFrame, one: str = "first", two: str = "second") -> DataFrame:
    """``n_pairs, n_disagreements, raw_agreement, kappa`` of two raters with any number of answers; kappa is null where chance alone agrees."""
    total = reviews.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(one) == F.col(two)).alias("same"))
    shares = lambda c, name: reviews.groupBy(F.col(c).alias("answer")).agg(F.count(F.lit(1)).alias(name))
    chance = shares(one, "x").join(shares(two, "y"), "answer").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    n, e = F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    raw = F.col("same") / n
    told = total.join(chance)  # one row each
    return told.select(n.alias("n_pairs"), (n - F.col("same")).alias("n_disagreements"), F.round(raw, 6).alias("raw_agreement"), F.round(F.when(e < 1, (raw - e) / (1 - e)), 6).alias("kappa"))


def precision(verdicts: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind ``duplicates, n, precision`` and the Wilson interval."""
    counted = verdicts.groupBy(kind).agg(F.count_if(F.col("verdict") == ANSWERS[0]).alias("duplicates"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("duplicates"), F.col("n"))
    return counted.select(kind, "duplicates", "n", F.round(F.col("duplicates") / F.col("n"), 6).alias("precision"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def require_final(found: DataFrame, final: DataFrame, kind: str = "kind", most: float = 1e-6) -> DataFrame:
    """The precision recomputed equals the one reported: counts exactly, the interval's lower end nearly."""
    expect_same_keys(found, final, kind)
    b = final.select(kind, *(F.col(c).alias(f"{c}2") for c in ("duplicates", "n", "low")))
    same = (F.col("duplicates") == F.col("duplicates2")) & (F.col("n") == F.col("n2")) & (F.abs(F.col("low") - F.col("low2")) <= most)
    if bad := found.join(b, kind).where(~F.coalesce(same, F.lit(False))).take(1):
        raise GateError(f"audit differs from its report: {bad[0]}")
    return found

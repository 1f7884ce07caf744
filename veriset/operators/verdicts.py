"""Pre-registered verdicts over tables of point estimates, intervals and p-values.

Each takes one row per baseline and gives one row per baseline or one in all; names
of verdicts are fixed values.  Effects are shares (0.005 is half a point).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.functions.columns import excludes_zero
from veriset.operators.gates import GateError
from veriset.operators.inference import holm

CONFIRMED, PARTIAL, REJECTED = "CONFIRMED", "PARTIALLY_SUPPORTED", "REJECTED"


def leakage(rate: Column, least: float = 0.01) -> Column:
    """Confirmed if the rate itself reaches ``least``; its interval only describes."""
    return F.when(rate >= least, CONFIRMED).otherwise(REJECTED)


def attribution(leak: Column, leak_low: Column, leak_high: Column, attr: Column, attr_low: Column, attr_high: Column, margin: float = 0.005) -> Column:
    """Confirmed if the leak effect reaches the margin and the attributed one is positive, neither interval holding 0; partial if the leak effect alone is surely positive."""
    sure, sure_attr = excludes_zero(leak_low, leak_high), excludes_zero(attr_low, attr_high)
    return F.when((leak >= margin) & sure & (attr > 0) & sure_attr, CONFIRMED).when((leak > 0) & sure, PARTIAL).otherwise(REJECTED)


def conjunctive_p(*p: Column) -> Column:
    """The p-value of all effects together is the largest; null if one is missing."""
    return F.when(F.greatest(*(x.isNull().cast("int") for x in p)) == 0, F.greatest(*p))


def downgrade(verdict: Column, rejected: Column) -> Column:
    """What the corrected test does not reject is no more than partial."""
    return F.when((verdict == CONFIRMED) & ~F.coalesce(rejected, F.lit(False)), PARTIAL).otherwise(verdict)


def by_baseline(effects: DataFrame, margin: float = 0.005, alpha: float = 0.05) -> DataFrame:
    """``baseline, leak, leak_low, leak_high, leak_p, attr, attr_low, attr_high, attr_p`` -> also ``p, adjusted, rejected, verdict``.

    Holm's correction runs over the baselines' conjunctive p-values.
    """
    with_p = effects.withColumn("p", conjunctive_p(F.col("leak_p"), F.col("attr_p")))
    corrected = holm(with_p.select(F.col("baseline").alias("name"), "p"), alpha).withColumnRenamed("name", "baseline")
    first = attribution(*(F.col(c) for c in ("leak", "leak_low", "leak_high", "attr", "attr_low", "attr_high")), margin)
    return with_p.join(corrected, "baseline").withColumn("verdict", downgrade(first, F.col("rejected")))


def over_baselines(verdicts: DataFrame) -> DataFrame:
    """One verdict: confirmed if all are, partial if any is at least partial."""
    v = F.col("verdict")
    all_, any_ = F.bool_and(v == CONFIRMED), F.bool_or(v.isin(CONFIRMED, PARTIAL))
    return verdicts.agg(F.when(all_, CONFIRMED).when(any_, PARTIAL).otherwise(REJECTED).alias("verdict"))


def background(effects: DataFrame, required: list[str], mixed_policy: str = "halt", alpha: float = 0.05) -> DataFrame:
    """``baseline, bg, bg_low, bg_high, bg_p`` -> one verdict: all baselines inflated, some, or none.

    A baseline counts if its effect is positive, its interval lacks 0 and Holm's test
    rejects.  Where some count and others do not, ``partial`` says so and ``halt`` raises.
    """
    if mixed_policy not in ("halt", "partial"):
        raise ValueError("mixed_policy is 'halt' or 'partial'")
    found = {r.baseline for r in effects.select("baseline").distinct().collect()}  # a row per baseline
    if found != set(required):
        raise GateError(f"baselines {sorted(found)} instead of {sorted(required)}")
    corrected = holm(effects.select(F.col("baseline").alias("name"), F.col("bg_p").alias("p")), alpha).withColumnRenamed("name", "baseline")
    holds = (F.col("bg") > 0) & excludes_zero(F.col("bg_low"), F.col("bg_high")) & F.col("rejected")
    told = effects.join(corrected, "baseline").agg(F.bool_and(holds).alias("every"), F.bool_or(holds).alias("any"))
    if mixed_policy == "halt" and (row := told.first()).any and not row.every:
        raise GateError("mixed outcome over baselines")
    return told.select(F.when(F.col("every"), CONFIRMED).when(F.col("any"), PARTIAL).otherwise(REJECTED).alias("verdict"))


def cross_check(one: DataFrame, other: DataFrame, point: float = 1e-9, interval: float = 0.003, p: float = 1e-12) -> DataFrame:
    """Two implementations' ``name, point, low, high, excludes_zero, p``: what agrees, by name; a name on one side only agrees in nothing."""
    b = other.toDF(*(f"{c}2" if c != "name" else c for c in other.columns))
    near = lambda c, most: F.coalesce(F.abs(F.col(c) - F.col(f"{c}2")) <= most, F.lit(False))
    no_p = F.col("p").isNull() | F.col("p2").isNull()
    both = F.col("point").isNotNull() & F.col("point2").isNotNull()
    return one.join(b, "name", "full_outer").select(
        "name", near("point", point).alias("point_ok"), (near("low", interval) & near("high", interval)).alias("interval_ok"),
        F.coalesce(F.col("excludes_zero") == F.col("excludes_zero2"), F.lit(False)).alias("gate_ok"), (both & (no_p | near("p", p))).alias("p_ok"))


def require_agreement(checks: DataFrame) -> DataFrame:
    """Raises where point, gate or p disagree (an interval may differ: it is reported)."""
    if bad := checks.where("not (point_ok and gate_ok and p_ok)").take(1):
        raise GateError(f"implementations disagree: {bad[0]}")
    return checks


def locked_digest(hypotheses: list[Mapping]) -> str:
    """``sha256:`` of the locked blocks of a register, as canonical JSON."""
    blocks = [{"hypothesis_id": h.get("hypothesis_id"), "locked": h["locked"]} for h in hypotheses if "locked" in h]
    if not blocks:
        raise GateError("no locked block")
    return "sha256:" + hashlib.sha256(json.dumps(blocks, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def require_locked(hypotheses: list[Mapping], expected: str) -> None:
    """No verdict is given on hypotheses that changed since they were locked."""
    if (found := locked_digest(hypotheses)) != expected:
        raise GateError(f"hypotheses changed: {found} instead of {expected}")

"""Runs of an evaluation: their registry, pairing of their items, comparisons between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.functions.columns import ratio
from veriset.operators.gates import GateError, expect_unique

COUNTS = ("inter", "uni")


def run_for(registry: DataFrame, family: str, arm: str, seed: int) -> str:
    """The id of one run; none or several raise."""
    found = registry.where((F.col("family") == family) & (F.col("arm") == arm) & (F.col("seed") == seed)).select("run").take(2)
    if len(found) != 1:
        raise GateError(f"{len(found)} runs of {family}, {arm}, seed {seed}")
    return found[0].run


def look_up(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """``family, arm, seed`` rows with their run id; a row without a run raises."""
    keys = ["family", "arm", "seed"]
    expect_unique(registry, *keys)
    out = wanted.join(registry.select(*keys, "run"), keys, "left")
    if missing := out.where("run is null").take(1):
        raise GateError(f"no such run: {missing[0]}")
    return out


def of_class(registry: DataFrame, run_class: str) -> DataFrame:
    """Evidence and sensitivity runs are reported apart."""
    return registry.where(F.col("run_class") == run_class)


def pairing(parts: DataFrame, reference: str) -> DataFrame:
    """``run, n_items, n_missing, n_extra`` against the items of one run."""
    items = parts.select("run", "item").distinct()
    own = items.where(F.col("run") == reference).select("item", F.lit(1).alias("known"))
    total = own.agg(F.count(F.lit(1)).alias("total"))  # one row
    met = items.join(own, "item", "left").groupBy("run").agg(F.count(F.lit(1)).alias("n_items"), F.count("known").alias("n_known"))
    return met.join(total).select("run", "n_items", (F.col("total") - F.col("n_known")).alias("n_missing"), (F.col("n_items") - F.col("n_known")).alias("n_extra"))


def require_pairing(parts: DataFrame, reference: str, n: int | None = None) -> DataFrame:
    """Every run must hold the same items (``n`` of them)."""
    if bad := pairing(parts, reference).where((F.col("n_missing") > 0) | (F.col("n_extra") > 0) | ((F.col("n_items") != n) if n is not None else F.lit(False))).take(1):
        raise GateError(f"items differ: {bad[0]}")
    return parts


def require_arms(parts: DataFrame, arms: tuple[str, ...] = ("default", "sanitized", "sizectrl")) -> DataFrame:
    """The arms must share their seeds, and all their runs the items."""
    seeds = {r.arm: r.seeds for r in parts.groupBy("arm").agg(F.sort_array(F.collect_set("seed")).alias("seeds")).collect()}  # a row per arm
    if len({tuple(seeds.get(a, ())) for a in arms}) != 1 or not seeds.get(arms[0]):
        raise GateError(f"arms must share their seeds: { {a: seeds.get(a) for a in arms} }")
    runs = parts.where(F.col("arm").isin(*arms)).select(F.concat_ws("/", "arm", F.col("seed").cast("string")).alias("run"), "item")
    require_pairing(runs, f"{arms[0]}/{seeds[arms[0]][0]}")
    return parts


def aligned(one: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of the items that both runs hold: ``item, class_id`` and both runs' counts, 0 where a run has no such cell.

    Cohorts may differ in size; items of one of them alone are left out.
    """
    shared = one.select("item").distinct().join(other.select("item").distinct(), "item")
    side = lambda rows, k: rows.join(shared, "item", "left_semi").select("item", "class_id", *(F.col(c).alias(f"{c}{k}") for c in COUNTS))
    met = side(one, 1).join(side(other, 2), ["item", "class_id"], "full_outer")
    return met.select("item", "class_id", *(F.coalesce(f"{c}{k}", F.lit(0)).cast("long").alias(f"{c}{k}") for k in (1, 2) for c in COUNTS))


def difference_floor(one: DataFrame, other: DataFrame) -> DataFrame:
    """``n_items, n_differ`` of the shared items: whole arrays are compared, so a class that one run lacks counts."""
    differ = reduce_or(*(F.col(f"{c}1") != F.col(f"{c}2") for c in COUNTS))
    by_item = aligned(one, other).groupBy("item").agg(F.bool_or(differ).alias("differs"))
    return by_item.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("differs").alias("n_differ"))


def reduce_or(*rules: Column) -> Column:
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def shared_scores(one: DataFrame, other: DataFrame) -> DataFrame:
    """Mean IoU without class 0 of both runs on the items they share, and the difference."""
    sums = aligned(one, other).groupBy("class_id").agg(*(F.sum(f"{c}{k}").alias(f"{c}{k}") for k in (1, 2) for c in COUNTS)).where("class_id > 0")
    a, b = (F.avg(ratio(F.col(f"inter{k}"), F.col(f"uni{k}"))) for k in (1, 2))
    return sums.agg(F.round(a, 6).alias("first"), F.round(b, 6).alias("second"), F.round(a - b, 6).alias("difference"))


def named(rows: DataFrame, names: DataFrame, default: str = "") -> DataFrame:
    """``class_id`` rows with ``class_name``, the default where a class has none."""
    return rows.join(names.select("class_id", F.col("name").alias("class_name")), "class_id", "left").withColumn("class_name", F.coalesce("class_name", F.lit(default)))


def defect_targets(defects: DataFrame, items: DataFrame) -> DataFrame:
    """``id, target`` of known defects by the key under which the item is listed; a defect that is not listed raises."""
    out = defects.join(items.select("id", F.col("key").alias("item")), "id", "left")
    if missing := out.where("item is null").take(1):
        raise GateError(f"defect without an item: {missing[0]}")
    return out.select("item", "target")


def class_of(keys: DataFrame, classes: DataFrame, require: bool = False) -> DataFrame:
    """``key, id`` rows with the class listed under the key, or else under the canonical id; without either null, or an error."""
    by_key = classes.select(F.col("name").alias("key"), F.col("class_id").alias("c1"))
    by_id = classes.select(F.col("name").alias("id"), F.col("class_id").alias("c2"))
    out = keys.join(by_key, "key", "left").join(by_id, "id", "left").withColumn("class_id", F.coalesce("c1", "c2")).drop("c1", "c2")
    if require and (missing := out.where("class_id is null").take(1)):
        raise GateError(f"item without a class: {missing[0]}")
    return out


def per_class_delta(parts: DataFrame, leaked: DataFrame | None = None, first: str = "default", second: str = "sanitized") -> DataFrame:
    """``class_id, delta``: IoU of one arm less the other's, averaged over the seeds where both have it; null where none has.

    ``leaked`` (``class_id, n_leaked``) keeps the classes of which at least one item leaked, also those that no run holds.
    """
    arms = parts.where(F.col("arm").isin(first, second))
    sums = arms.groupBy("arm", "seed", "class_id").agg(F.sum("inter").alias("i"), F.sum("uni").alias("u"))
    of = lambda arm: F.max(F.when(F.col("arm") == arm, ratio(F.col("i"), F.col("u"))))
    by_seed = sums.groupBy("seed", "class_id").agg((of(first) - of(second)).alias("d"))
    out = by_seed.groupBy("class_id").agg(F.round(F.avg("d"), 6).alias("delta"))
    return out if leaked is None else leaked.where("n_leaked > 0").select("class_id").join(out, "class_id", "left")


def newest(files: DataFrame, by: str = "folder", preferred: str = "last_checkpoint") -> DataFrame:
    """Per folder the path to load: one of the preferred name if there is any, else the newest; ties by path."""
    order = F.struct((F.col("name") == preferred).alias("p"), F.col("modified").alias("m"), F.col("path").alias("path"))
    return files.groupBy(by).agg(F.max(order)["path"].alias("path"))

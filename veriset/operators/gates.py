"""Validation gates that fail closed: a broken rule raises before its table is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A validation rule does not hold."""


def expect_count(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    if (found := df.count()) != n:
        raise GateError(f"{what}: {found} instead of {n}")
    return df


def expect_unique(df: DataFrame, *keys: str) -> DataFrame:
    if twice := df.groupBy(*keys).count().where("count > 1").take(1):
        raise GateError(f"{', '.join(keys)} stands twice: {twice[0]}")
    return df


def expect_all(df: DataFrame, rule: Column, what: str) -> DataFrame:
    """Every row keeps the rule; null breaks it."""
    if bad := df.where(~F.coalesce(rule, F.lit(False))).take(1):
        raise GateError(f"{what}: {bad[0]}")
    return df


def expect_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if shared := a.select(key).join(b.select(key), key, "left_semi").take(1):
        raise GateError(f"{key} on both sides: {shared[0]}")


def expect_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    for x, y in ((a, b), (b, a)):
        if alone := x.select(key).join(y.select(key), key, "left_anti").take(1):
            raise GateError(f"{key} on one side only: {alone[0]}")


def expect_labels(rows: DataFrame, most: int = 115) -> DataFrame:
    """Labels of 0 to ``most`` only (255 must not occur)."""
    return expect_all(rows, F.col("label").between(0, most), "label out of range")


def expect_catalogue(names: list[str], results: DataFrame) -> DataFrame:
    """Every named probe was evaluated and passed; one that was not evaluated has failed."""
    passed = {r.probe for r in results.where("passed").select("probe").collect()}
    if missing := sorted(set(names) - passed):
        raise GateError(f"not passed: {missing}")
    return results


def expect_finite(df: DataFrame, *columns: str) -> DataFrame:
    """No value is null, NaN or infinite."""
    for c in columns:
        x = F.col(c).cast("double")
        expect_all(df, x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), f"{c} not finite")
    return df


def expect_same_counts(a: DataFrame, b: DataFrame, key: str = "split") -> None:
    """Both tables have as many rows of each key."""
    counts = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    if bad := counts(a, "n").join(counts(b, "m"), key, "full_outer").where("n is null or m is null or n <> m").take(1):
        raise GateError(f"counts differ: {bad[0]}")


def expect_cohort(df: DataFrame, excluded: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` without the excluded keys, which must leave ``n`` rows."""
    return expect_count(df.join(excluded.select(key), key, "left_anti"), n, f"{key} after exclusion")


def expect_near(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], most: float = 1e-12) -> float:
    """The greatest deviation of two tables of metrics by key; a key on one side only, null against a number, or more than ``most`` raises."""
    met = a.select(*keys, *(F.col(c).alias(f"{c}1") for c in columns), F.lit(1).alias("_a")).join(b.select(*keys, *(F.col(c).alias(f"{c}2") for c in columns), F.lit(1).alias("_b")), keys, "full_outer")
    if alone := met.where("_a is null or _b is null").take(1):
        raise GateError(f"on one side only: {alone[0]}")
    gap = [F.when(F.col(f"{c}1").isNull() & F.col(f"{c}2").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.abs(F.col(f"{c}1") - F.col(f"{c}2")), F.lit(float("inf")))) for c in columns]
    worst = met.agg(F.max(F.greatest(*gap) if len(gap) > 1 else gap[0]).alias("d")).first().d or 0.0
    if worst > most:
        raise GateError(f"deviation of {worst}")
    return worst


def expect_grid_point(grid: DataFrame, primary: DataFrame, ham: int, cos: float, most: float = 1e-15) -> None:
    """The grid's rate at the operating point is the primary rate."""
    found = grid.where((F.col("ham") == ham) & (F.abs(F.col("cos") - cos) < 1e-9)).select("rate").collect()
    if len(found) != 1 or abs(found[0].rate - primary.first().rate) > most:
        raise GateError(f"grid point {found} is not the primary rate")


def expect_disjoint_splits(items: DataFrame, key: str = "id", split: str = "split") -> DataFrame:
    """No key stands in two splits."""
    if bad := items.groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1").take(1):
        raise GateError(f"in several splits: {bad[0]}")
    return items


def expect_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    if df.columns != columns:
        raise GateError(f"columns {df.columns} instead of {columns}")
    return df


def expect_artifact(parts: DataFrame, n: int, columns: tuple[str, ...] = ("item", "class_id", "inter", "uni")) -> DataFrame:
    """A run's contributions: the columns are there, ``n`` items, no cell twice."""
    if missing := set(columns) - set(parts.columns):
        raise GateError(f"missing columns {sorted(missing)}")
    expect_count(parts.select("item").distinct(), n, "items")
    return expect_unique(parts, "item", "class_id")


def expect_record(record: dict, expected: dict) -> dict:
    """A run record says what was planned."""
    if wrong := {k: record.get(k) for k, v in expected.items() if record.get(k) != v}:
        raise GateError(f"record says {wrong}")
    return record


def expect_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, sha256, bytes`` of the files that are there against those of a manifest: all there, unchanged, each once, none beside them."""
    expect_unique(manifest, "path")
    expect_same_keys(found, manifest, "path")
    changed = found.join(manifest.select("path", F.col("sha256").alias("s"), F.col("bytes").alias("b")), "path").where("sha256 <> s or bytes <> b").take(1)
    if changed:
        raise GateError(f"changed: {changed[0].path}")
    return found


def expect_outputs(files: DataFrame, expected: dict[str, int]) -> DataFrame:
    """As many files as expected match each pattern (of the file's name)."""
    for pattern, n in expected.items():
        expect_count(files.where(F.col("name").rlike(pattern)), n, pattern)
    return files

"""Column functions: identities, similarity, intervals and small-sample statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles for the supported confidence levels (fixed values).
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def canonical_id(split: Column, name: Column) -> Column:
    """``split/stem``: the split lower-cased, backslashes turned, the extension gone."""
    return F.concat_ws("/", F.lower(split), F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"\.[^./]+$", ""))


def split_name(raw: Column) -> Column:
    """``training`` and ``validation`` by their short names; anything else unchanged."""
    return F.when(raw == "training", "train").when(raw == "validation", "val").otherwise(raw)


def split_of(item: Column) -> Column:
    """The split of a driver-table id: 0 to 6 train, 7 val, 8 and 9 test."""
    r = F.pmod(item, F.lit(10))
    return F.when(r < 7, "train").when(r == 7, "val").otherwise("test")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length one; null for the zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def pack_signs(v: Column, first: int, n: int = 32) -> Column:
    """``n`` sign bits from ``first`` on, most significant first, as one long."""
    bits = F.transform(F.slice(v, first + 1, n), lambda x: F.when(x >= 0, 1).otherwise(0).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit patterns; their sign does not matter."""
    return F.bit_count(a.bitwiseXOR(b))


def hard(cos: Column, ham: Column, cos_least: float, ham_most: int) -> Column:
    return (cos >= cos_least) | (ham <= ham_most)


def soft(cos: Column, ham: Column, cos_least: float, ham_most: int, cos_low: float, ham_high: int) -> Column:
    """Near the thresholds of ``hard``, but not over them."""
    return (ham.between(ham_most + 1, ham_high) | ((cos >= cos_low) & (cos < cos_least))) & ~hard(cos, ham, cos_least, ham_most)


def wilson(k: Column, n: Column, level: float = 0.95, clamp: bool = True) -> tuple[Column, Column]:
    """Score interval of k of n; n of 0 or k outside 0..n raises."""
    if level not in Z:
        raise ValueError(f"no quantile for level {level}")
    z = Z[level]
    n = F.when((n <= 0) | (k < 0) | (k > n), F.raise_error(F.lit("not a share of a positive count")).cast("double")).otherwise(n.cast("double"))
    p, square = k / n, z * z
    centre, reach = p + square / (2 * n), z * F.sqrt(p * (1 - p) / n + square / (4 * n * n))
    low, high = (centre - reach) / (1 + square / n), (centre + reach) / (1 + square / n)
    return (F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)) if clamp else (low, high)


def two_sided_p(x: Column) -> Column:
    """Aggregate: twice the smaller tail around 0, one added to each count, at most 1."""
    n = F.count(x) + 1
    return F.least(F.lit(1.0), 2 * F.least((F.count_if(x <= 0) + 1) / n, (F.count_if(x >= 0) + 1) / n))


def interval(x: Column, alpha: float = 0.05) -> Column:
    """Aggregate: exact percentile interval with linear interpolation, nulls skipped."""
    return F.percentile(x, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def finite(x: Column) -> Column:
    """Null instead of NaN or an infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def hash_draw(replicate: Column, ordinal: Column, n: Column) -> Column:
    """A draw below ``n`` that any SQL engine repeats: the first 32 bits of md5('replicate:ordinal')."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", replicate.cast("string"), ordinal.cast("string"))), 1, 8), 16, 10).cast("long") % n


def six_digits(x: Column) -> Column:
    """``%.6f``, empty for null."""
    return F.coalesce(F.format_string("%.6f", x), F.lit(""))


def plain_id(name: Column) -> Column:
    """The other identity in use: the name up to its last dot, case and separators as they are."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def label_of_index(index: Column) -> Column:
    """Class indices count from 0, labels from 1 (0 is the background)."""
    return index + 1


def points(share: Column) -> Column:
    """A share as points of a hundred."""
    return share * 100


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def hex_draw(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def lookup(table: dict, key: Column, default: object = None) -> Column:
    """The value of a small literal table, ``default`` where it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)
    return found if default is None else F.coalesce(found, F.lit(default))


def entry_paths(key: Column, image_root: str, mask_root: str, image_suffix: str = ".jpg", mask_suffix: str = ".png") -> tuple[Column, Column]:
    """Image and mask path of a list entry ``split/name``; an entry of another form raises."""
    clean = F.replace(F.trim(key), F.lit("\\"), F.lit("/"))
    good = clean.contains("/") & clean.endswith(image_suffix)
    entry = F.when(good, clean).otherwise(F.raise_error(F.concat(F.lit("not a list entry: "), key)).cast("string"))
    split = F.split_part(entry, F.lit("/"), F.lit(1))
    name = F.substr(entry, F.length(split) + 2)  # all behind the first slash
    stem = F.left(name, F.length(name) - len(image_suffix))
    return F.concat_ws("/", F.lit(image_root), split, name), F.concat_ws("/", F.lit(mask_root), split, F.concat(stem, F.lit(mask_suffix)))


def projected_hours(runs: Column, iterations: Column, seconds: Column, reserve: float = 1.2) -> tuple[Column, Column]:
    """Hours that runs take, and the same with a reserve."""
    raw = runs * iterations * seconds / 3600
    return raw, raw * reserve

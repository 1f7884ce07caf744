"""Paired bootstrap, intervals, p-values, Holm's correction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veriset.functions.columns import hash_draw, interval, ratio, two_sided_p
from veriset.operators.shipping import prepare
from veriset.plans.scratch import Scratch


def weights(items: DataFrame, replicates: int) -> DataFrame:
    """How often each item is drawn in each replicate: ``r, item, k``, with draws that SQL repeats."""
    total = items.count()
    ordinal = items.select("item", (F.row_number().over(Window.orderBy("item")) - 1).cast("long").alias("i"))  # one row per item of a benchmark
    r = items.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "r")
    draws = r.join(items.sparkSession.range(total).withColumnRenamed("id", "j")).select("r", hash_draw(F.col("r"), F.col("j"), F.lit(total)).alias("i"))
    return draws.groupBy("r", "i").agg(F.count(F.lit(1)).alias("k")).join(ordinal, "i").select("r", "item", "k")


#: Replicates that the reference asks for at least.
FLOOR = 10_000
#: Counts (replicates x items) that a task holds at once.
MOST_CELLS = 20_000_000
#: Cells of a block of the contribution table.
BLOCK_CELLS = 1_000_000
#: Draws that are hashed at once: what a core's cache holds.
SLAB = 8192


def deltas(parts: DataFrame, replicates: int = FLOOR, floor: int = FLOOR, most_cells: int = MOST_CELLS) -> DataFrame:
    """Per replicate: ``leak`` = default - sanitized, ``size`` = default - size control, ``attr`` = leak - size, ``bg`` = with less without class 0.

    Seeds are averaged within a replicate; all runs share a replicate's draw.  The items x
    (run, class) table is dealt by range of the item into blocks.  Each task draws some
    replicates, at most ``most_cells`` counts of replicates x items at once, and multiplies
    them with the blocks that stream past it; the driver sees the sizes of the blocks only.
    Without ``most_cells`` draws and items are joined instead, which is slower by far.
    """
    if replicates < floor:
        raise ValueError(f"at least {floor} replicates")
    spark = parts.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "deltas")
    key = ["arm", "seed", "class_id"]
    cells = scratch.cut(parts.groupBy("item", *key).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("inter", "i"), ("uni", "u")))), "cells")
    n_items = cells.select("item").distinct().count()
    if not n_items or not most_cells:
        return _joined_deltas(parts, replicates)
    found = cells.select(*key).distinct()
    kinds = [tuple(r) for r in found.collect()]  # a row per run and class
    place = spark.createDataFrame([(*kind, k) for k, kind in enumerate(kinds)], T.StructType([*found.schema, T.StructField("k", T.IntegerType())]))
    rows = cells.join(F.broadcast(place.toDF("arm_", "seed_", "class_", "k")), F.expr("arm <=> arm_ and seed <=> seed_ and class_id <=> class_"))
    order, n_blocks = F.col("item").asc_nulls_last(), -(-2 * n_items * len(kinds) // BLOCK_CELLS)
    ranged = rows.select("item", "k", F.col("i").cast("double").alias("i"), F.col("u").cast("double").alias("u")).repartitionByRange(n_blocks, order).sortWithinPartitions(order)
    packed = scratch.cut(ranged.select(F.spark_partition_id().alias("block"), "*").mapInArrow(_packer(len(kinds)), "block int, n long, kind string, cells binary"), "blocks")
    firsts, total = {}, 0
    for block, n in sorted(packed.select("block", "n").collect()):
        firsts[block], total = total, total + n
    chunks = min(replicates, max(spark.sparkContext.defaultParallelism, -(-replicates // max(1, min(500, most_cells // total)))))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "*").repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "block")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "8")  # a row is a whole block here
        return scratch.cut(sent.mapInArrow(_drawer(kinds, firsts, total, chunks, replicates), "r long, leak double, size double, bg double, attr double"), "deltas")
    finally:
        spark.conf.set(batch, usual)


def _packer(n_kinds: int) -> Callable:
    """A partition's items, in their order, as one block: items x (run, class) x (inter, uni), in the least type that holds it; a null item counts as one and holds nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held).combine_chunks()
        item = part["item"].combine_chunks()
        at = item.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        known = item.is_valid().to_numpy(zero_copy_only=False)
        table = np.zeros((int(at.max()) + 1, n_kinds, 2))
        for side, name in enumerate(("i", "u")):
            table[at[known], part["k"].to_numpy()[known], side] = part[name].to_numpy()[known]
        if (table >= 0).all() and (table == np.floor(table)).all():
            table = table.astype(np.min_scalar_type(int(table.max())))
        cells = pa.array([table.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([part["block"].combine_chunks()[:1], pa.array([len(table)], pa.int64()), pa.array([table.dtype.str]), cells], names=["block", "n", "kind", "cells"])

    return pack


def _drawer(kinds: list[tuple], firsts: dict[int, int], total: int, chunks: int, replicates: int) -> Callable:
    """Rows of a task: the blocks of a chunk of replicates, by chunk and block."""
    runs = list(dict.fromkeys(kind[:2] for kind in kinds))
    classes = list(dict.fromkeys(kind[2] for kind in kinds))
    of_run, of_class = [runs.index(kind[:2]) for kind in kinds], [classes.index(kind[2]) for kind in kinds]
    arms, fore = np.array([arm or "" for arm, _ in runs]), np.array([c is not None and c > 0 for c in classes])

    def told(r: np.ndarray, summed: np.ndarray) -> pa.RecordBatch:
        iou = np.full((len(r), len(runs), len(classes)), np.nan)
        iou[:, of_run, of_class] = _ratio(summed[..., 0], summed[..., 1])
        of = lambda arm, which: _mean(_mean(iou[:, arms == arm][:, :, which], 2), 1)
        default = of("default", fore)
        leak, size, bg = default - of("sanitized", fore), default - of("sizectrl", fore), of("default", fore | True) - default
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), *(pa.array(x, pa.float64(), from_pandas=True) for x in (leak, size, bg, leak - size))], names=["r", "leak", "size", "bg", "attr"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = r = counts = summed = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != at:
                    if at is not None:
                        yield told(r, summed)
                    at = row["chunk"]
                    r = np.arange(at * replicates // chunks, (at + 1) * replicates // chunks) + 1
                    counts, summed = drawn_counts(r, total), np.zeros((len(r), len(kinds), 2))
                table = np.frombuffer(row["cells"], row["kind"]).reshape(row["n"], -1).astype(float)
                first = firsts[row["block"]]
                summed += (counts[:, first : first + len(table)].astype(float) @ table).reshape(summed.shape)
        if at is not None:
            yield told(r, summed)

    return draw


def drawn_counts(replicates: np.ndarray, n: int) -> np.ndarray:
    """How often each of ``n`` ordinals is drawn, replicates x ordinals: the draws of ``hash_draw``, a slab at a time."""
    out = np.zeros((len(replicates), n), np.int32)
    groups = [(d, min(n, 10**d)) for d in range(1, len(str(n - 1)) + 1)]  # ordinals by their number of digits, each up to an end
    digits = {r: len(str(r)) for r in replicates.tolist()}
    for width in sorted(set(digits.values())):
        places = np.array([k for k, r in enumerate(replicates.tolist()) if digits[r] == width])
        ends = []
        for d, end in groups:
            words = (width + 1 + d) // 4 + 1
            body = np.zeros((end - (10 ** (d - 1) if d > 1 else 0), 4 * words), np.uint8)
            body[:, width + 1 : width + 1 + d] = _digits(np.arange(end - len(body), end), d)
            body[:, width + 1 + d] = 0x80
            ends.append((end, d, np.ascontiguousarray(body.view("<u4").T)))
        step = max(1, SLAB // n)
        for a in range(0, len(places), step):
            some = places[a : a + step]
            drawn = np.zeros((len(some), n), np.uint32)
            for end, d, body in ends:
                head = np.zeros((len(some), 4 * len(body)), np.uint8)
                head[:, :width], head[:, width] = _digits(replicates[some], width), ord(":")
                head = head.view("<u4")
                for b in range(0, body.shape[1], SLAB):
                    piece = body[:, b : b + SLAB]
                    message = [(head[:, k, None] | piece[k]).reshape(-1) for k in range(len(piece))]
                    first = end - body.shape[1] + b
                    drawn[:, first : first + piece.shape[1]] = (_md5_head(message, width + 1 + d) % np.uint32(n)).reshape(len(some), -1)
            for k, place in enumerate(some):
                out[place] = np.bincount(drawn[k], minlength=n)
    return out


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    return (numbers[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + ord("0")).astype(np.uint8)


_SINES = (np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32)).astype(np.uint64).astype(np.uint32)
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_head(message: list[np.ndarray], length: int) -> np.ndarray:
    """The first four bytes, as one number, of the MD5 of texts of ``length`` bytes (55 at most): their little-endian words with the closing bit; words not given are zero."""
    a, b, c, d = (np.full(len(message[0]), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, spare = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps do not reach the first word
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if at < len(message):
            f += message[at]
        f += np.uint32((int(_SINES[i]) + (8 * length if at == 14 else 0)) & 0xFFFFFFFF)
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=spare)
        f <<= np.uint32(turn)
        f |= spare
        f += b
        a, d, c, b, f = d, c, b, f, a
    b += np.uint32(0x67452301)
    return b.byteswap()


def _joined_deltas(parts: DataFrame, replicates: int) -> DataFrame:
    """The same by a join of draws and items."""
    w = weights(parts.select("item").distinct(), replicates)
    summed = w.join(parts, "item").groupBy("r", "arm", "seed", "class_id").agg(F.sum(F.col("k") * F.col("inter")).cast("double").alias("i"), F.sum(F.col("k") * F.col("uni")).cast("double").alias("u"))
    iou = ratio(F.col("i"), F.col("u"))
    runs = summed.groupBy("r", "arm", "seed").agg(F.avg(iou).alias("every"), F.avg(F.when(F.col("class_id") > 0, iou)).alias("fore"))
    arms = runs.groupBy("r", "arm").agg(F.avg("every").alias("every"), F.avg("fore").alias("fore"))
    of = lambda arm, c="fore": F.max(F.when(F.col("arm") == arm, F.col(c)))
    wide = arms.groupBy("r").agg((of("default") - of("sanitized")).alias("leak"), (of("default") - of("sizectrl")).alias("size"), (of("default", "every") - of("default")).alias("bg"))
    return wide.withColumn("attr", F.col("leak") - F.col("size"))


def _long(wide: DataFrame) -> DataFrame:
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in ("leak", "attr", "bg")))).alias("x")).select("x.*")


def intervals(wide: DataFrame, alpha: float = 0.05) -> DataFrame:
    ci = _long(wide).groupBy("name").agg(interval(F.col("v"), alpha).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    return ci.select("name", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), ((low > 0) | (high < 0)).alias("excludes_zero"))


def p_values(wide: DataFrame) -> DataFrame:
    return _long(wide).groupBy("name").agg(F.round(two_sided_p(F.col("v")), 6).alias("p"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Step-down: adjusted p-values and rejections; a test is rejected only while all before it are.  One row per hypothesis."""
    by = Window.orderBy("p", "name")
    left = F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(by) + 1
    ranked = tests.select("name", "p", left.alias("left"))
    return ranked.select("name", F.round(F.least(F.lit(1.0), F.max(F.col("left") * F.col("p")).over(by)), 6).alias("adjusted"), (F.min((F.col("p") <= alpha / F.col("left")).cast("int")).over(by) == 1).alias("rejected"))


METRICS = ("miou_all", "miou_fore", "macc_all", "macc_fore", "boundary_iou", "boundary_f1")


def stream(seed: int, n: int, replicates: int, block: int = 200) -> Iterator[np.ndarray]:
    """How often each of ``n`` items is drawn, replicates x items, in blocks: one PCG64 stream, one draw of n for each replicate."""
    rng = np.random.Generator(np.random.PCG64(seed))
    for at in range(0, replicates, block):
        yield np.stack([np.bincount(rng.integers(0, n, size=n), minlength=n) for _ in range(min(block, replicates - at))])


def _mean(x: np.ndarray, axis: int) -> np.ndarray:
    """Mean of what is not NaN; NaN where all is."""
    n = (~np.isnan(x)).sum(axis)
    return np.where(n > 0, np.nansum(x, axis) / np.maximum(n, 1), np.nan)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.where(b > 0, b, 1), np.nan)


def six_metrics(sums: np.ndarray, edges: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums ``... x classes x (inter, uni, label)`` and ``... x (tp, fp, fn)`` -> the six metrics, and IoU by class."""
    iou, acc = _ratio(sums[..., 0], sums[..., 1]), _ratio(sums[..., 0], sums[..., 2])
    last = [np.full(iou.shape[:-1], np.nan)] * 2
    if edges is not None:
        tp, fp, fn = np.moveaxis(edges, -1, 0)
        last = [_ratio(tp, tp + fp + fn), _ratio(2 * tp, 2 * tp + fp + fn)]
    axis = iou.ndim - 1
    return np.stack([_mean(iou, axis), _mean(iou[..., 1:], axis), _mean(acc, axis), _mean(acc[..., 1:], axis), *last], axis), iou


def _bounds(x: np.ndarray, level: float) -> tuple[float | None, float | None]:
    x = x[~np.isnan(x)]
    if not len(x):
        return None, None
    low, high = np.percentile(x, [50 * (1 - level), 50 * (1 + level)])
    return float(low), float(high)


def metric_intervals(parts: DataFrame, by: tuple[str, ...] = ("run",), edges: DataFrame | None = None, replicates: int = FLOOR, seed: int = 20260917, primary: int | None = None, level: float = 0.95, classes: int = 116, floor: int = FLOOR) -> DataFrame:
    """``by, n, metric, class_id, point, low, high``: the six metrics (class null) and IoU by class, with percentile intervals.

    Every group (a run, or a run's stratum) is resampled on its own, from the start of the
    stream: of ``seed``, or of ``seed + n`` for a run whose number of items is not
    ``primary``.  A group is one task: its items x classes table must fit there, as one
    benchmark run does; groups run side by side.  ``edges`` has ``by, item, tp, fp, fn``.
    """
    if replicates < floor:
        raise ValueError(f"at least {floor} replicates")
    prepare(parts.sparkSession)
    zero = [F.lit(0.0).alias(c) for c in ("tp", "fp", "fn")]
    rows = parts.select(*by, "item", F.col("class_id").cast("int").alias("class_id"), *(F.col(c).cast("double").alias(c) for c in ("inter", "uni", "n_label")), *zero)
    if edges is not None:
        none = [F.lit(0.0).alias(c) for c in ("inter", "uni", "n_label")]
        rows = rows.unionByName(edges.select(*by, "item", F.lit(-1).alias("class_id"), *none, *(F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn"))))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long, metric string, class_id int, point double, low double, high double"])
    types, with_edges = [rows.schema[c].dataType for c in by], edges is not None

    def resample(group: pa.Table) -> pa.Table:
        return _resampled(group, by, [to_arrow_type(t) for t in types], with_edges, replicates, seed, primary, level, classes)

    return rows.groupBy(*by).applyInArrow(resample, schema)


def _resampled(group: pa.Table, by: tuple[str, ...], types: list, with_edges: bool, replicates: int, seed: int, primary: int | None, level: float, classes: int) -> pa.Table:
    items = group["item"].combine_chunks().dictionary_encode()
    order = np.argsort(np.argsort(items.dictionary.to_numpy(zero_copy_only=False)))  # items ascending
    place = order[items.indices.to_numpy()]
    n, c = len(items.dictionary), group["class_id"].to_numpy()
    cell = c >= 0
    table, edge = np.zeros((n, classes, 3)), np.zeros((n, 3))
    for k, name in enumerate(("inter", "uni", "n_label")):
        np.add.at(table[..., k], (place[cell], c[cell]), group[name].to_numpy()[cell])
    for k, name in enumerate(("tp", "fp", "fn")):
        np.add.at(edge[:, k], place[~cell], group[name].to_numpy()[~cell])
    held = np.flatnonzero(table.any((0, 2)))  # absent classes are null in every replicate
    first = 0 if len(held) and held[0] == 0 else None
    used = np.r_[[0] if first is None else [], held].astype(int)
    flat = table[:, used].reshape(n, -1)
    point, iou = six_metrics(flat.sum(0).reshape(len(used), 3), edge.sum(0) if with_edges else None)
    drawn, drawn_iou = [], []
    start = seed if primary is None or n == primary else seed + n
    for counts in stream(start, n, replicates):
        metrics, by_class = six_metrics((counts @ flat).reshape(len(counts), len(used), 3), counts @ edge if with_edges else None)
        drawn.append(metrics)
        drawn_iou.append(by_class.astype(np.float32))
    drawn, drawn_iou = np.concatenate(drawn), np.concatenate(drawn_iou)
    number = lambda x: None if np.isnan(x) else float(x)
    out = [(m, None, number(point[k]), *_bounds(drawn[:, k], level)) for k, m in enumerate(METRICS)]
    where = {int(x): k for k, x in enumerate(used)}
    for x in range(classes):
        k = where.get(x)
        out.append(("iou", x, None, None, None) if k is None else ("iou", x, number(iou[k]), *_bounds(drawn_iou[:, k], level)))
    names, class_ids, points, lows, highs = zip(*out, strict=True)
    key = {b: pa.array([group[b][0].as_py()] * len(out), t) for b, t in zip(by, types, strict=True)}
    return pa.table({**key, "n": pa.array([n] * len(out), pa.int64()), "metric": pa.array(names), "class_id": pa.array(class_ids, pa.int32()), **{c: pa.array(v, pa.float64()) for c, v in zip(("point", "low", "high"), (points, lows, highs), strict=True)}})


EFFECTS = ("leak", "size", "attr", "bg")


def points_by_seed(parts: DataFrame) -> DataFrame:
    """``seed, leak, size, attr, bg`` of the whole cohort: what the arms differ by, seed by seed.  The arms must share seeds and items."""
    from veriset.operators.runs import require_arms

    require_arms(parts)
    sums = parts.groupBy("arm", "seed", "class_id").agg(F.sum("inter").alias("i"), F.sum("uni").alias("u"))
    iou = ratio(F.col("i"), F.col("u"))
    runs = sums.groupBy("arm", "seed").agg(F.avg(iou).alias("every"), F.avg(F.when(F.col("class_id") > 0, iou)).alias("fore"))
    of = lambda arm, c="fore": F.max(F.when(F.col("arm") == arm, F.col(c)))
    wide = runs.groupBy("seed").agg((of("default") - of("sanitized")).alias("leak"), (of("default") - of("sizectrl")).alias("size"), (of("default", "every") - of("default")).alias("bg"))
    return wide.withColumn("attr", F.col("leak") - F.col("size")).select("seed", *EFFECTS)


def effects(parts: DataFrame, replicates: int = FLOOR, alpha: float = 0.05, floor: int = FLOOR) -> DataFrame:
    """``name, point, low, high, excludes_zero, p, between_seed_sd, replicates`` of every effect.

    The point is the mean over seeds on the whole cohort, the deviation theirs (null for one seed).
    """
    parts = Scratch(parts.sparkSession, "effects").cut(parts.select("item", "arm", "seed", "class_id", "inter", "uni"), "parts")
    wide = deltas(parts, replicates, floor)
    spread = lambda df: df.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in EFFECTS))).alias("x")).select("x.*")
    drawn = spread(wide).groupBy("name").agg(interval(F.col("v"), alpha).alias("q"), two_sided_p(F.col("v")).alias("p"))
    known = spread(points_by_seed(parts)).groupBy("name").agg(F.avg("v").alias("point"), F.stddev_samp("v").alias("sd"))
    low, high = F.col("q")[0], F.col("q")[1]
    r6 = lambda x, name: F.round(x, 6).alias(name)
    return known.join(drawn, "name").select("name", r6(F.col("point"), "point"), r6(low, "low"), r6(high, "high"), ((low > 0) | (high < 0)).alias("excludes_zero"), r6(F.col("p"), "p"), r6(F.col("sd"), "between_seed_sd"), F.lit(replicates).alias("replicates"))

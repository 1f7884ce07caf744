"""Named reports and figure specs, built from the operators' tables; their queries and those of the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.functions import columns as C
from veriset.operators import census, inference, metrics, runs, verdicts
from veriset.plans import views as V
from veriset.plans.catalogue import BOOT, CROSS, HARD, SCORE, SUMS, COSINES, HAMMINGS, Z, _crossing, _grid, query, shared

R6 = lambda x: F.round(x, 6)


# Report builders ------------------------------------------------------------
def leakage_table(primary: DataFrame, soft: DataFrame, intra: DataFrame) -> DataFrame:
    """T01: ``quantity, value, low, high, n, of`` in points; intervals for the primary rate alone."""
    none = F.lit(None).cast("double")
    rows = [
        primary.select(F.lit("hard").alias("quantity"), "rate", "low", "high", F.col("n_leaked").alias("n"), F.col("n_test").alias("of")),
        soft.select(F.lit("soft"), "rate", none, none, "n_leaked", "n_test"),
        intra.select(F.lit("intra_train"), "rate", none, none, "n_affected", "n_train"),
    ]
    out = rows[0].unionAll(rows[1]).unionAll(rows[2])
    return out.select("quantity", *(R6(C.points(F.col(c))).alias(c) for c in ("rate", "low", "high")), "n", "of")


def intra_split(pairs: DataFrame, items: DataFrame, rule: str, split: str = "train") -> DataFrame:
    """``n_edges, n_affected, n_train, rate``: edges within a split, the items at their ends, and their share of the split."""
    own = items.where(F.col("split") == split).select("id")
    inside = pairs.where(rule).join(own.toDF("a"), "a", "left_semi").join(own.toDF("b"), "b", "left_semi")
    ends = inside.select(F.explode(F.array("a", "b")).alias("v"))
    told = inside.agg(F.count(F.lit(1)).alias("n_edges")).join(ends.agg(F.count_distinct("v").alias("n_affected"))).join(own.agg(F.count(F.lit(1)).alias("n_train")))  # one row each
    return told.withColumn("rate", F.try_divide("n_affected", "n_train"))


def ablation_table(crossing: DataFrame, items: DataFrame, rules: dict[str, str]) -> DataFrame:
    """T02: ``detector, n_leaked, n_test, rate`` (points) of several rules, from one pass over the edges."""
    n_test = items.where("split = 'test'").agg(F.count(F.lit(1)).alias("n_test"))
    hits = crossing.agg(*(F.count_distinct(F.when(F.expr(rule), F.col("test"))).alias(name) for name, rule in rules.items()))
    long_ = hits.select(F.explode(F.array(*(F.struct(F.lit(n).alias("detector"), F.col(n).alias("n_leaked")) for n in rules))).alias("x")).select("x.*")
    return long_.join(n_test).select("detector", "n_leaked", "n_test", R6(C.points(F.try_divide("n_leaked", "n_test"))).alias("rate"))


def grid_table(grid: DataFrame, ham: int, cos: float) -> DataFrame:
    """T03: the grid's rates in points, the operating point marked."""
    return grid.select("ham", "cos", R6(C.points(F.col("rate"))).alias("rate"), ((F.col("ham") == ham) & (F.abs(F.col("cos") - cos) < 1e-9)).alias("operating_point"))


def class_table(leaks: DataFrame, names: DataFrame) -> DataFrame:
    """T04: per class its name, items, leaked items and rate in points, numbered by class."""
    return runs.named(leaks, names).select("class_id", "class_name", "n_test", "n_leaked", R6(C.points(F.try_divide("n_leaked", "n_test"))).alias("rate"))


def effect_table(found: DataFrame, margin: float = 0.005) -> DataFrame:
    """T06: effects in points, the conjunctive p-value beside the attributed one, and whether each gate is met."""
    p = found.agg(verdicts.conjunctive_p(F.max(F.when(F.col("name") == "leak", F.col("p"))), F.max(F.when(F.col("name") == "attr", F.col("p")))).alias("both"))
    gate = F.when(F.col("name") == "leak", (F.col("point") >= margin) & (F.col("low") > 0)).when(F.col("name") == "attr", (F.col("point") > 0) & (F.col("low") > 0))
    return found.where("name <> 'bg'").join(p).select("name", *(R6(C.points(F.col(c))).alias(c) for c in ("point", "low", "high")), "p", F.when(F.col("name") == "attr", F.col("both")).alias("p_conjunctive"), gate.alias("gate_met"))


def run_table(intervals: DataFrame, registry: DataFrame) -> DataFrame:
    """T10: per run the six metrics in points with their intervals, side by side."""
    scalar = intervals.where("class_id is null")
    wide = scalar.groupBy("run", "n").agg(*(F.max(F.when(F.col("metric") == m, C.points(F.col(c)))).alias(f"{m}_{c}") for m in inference.METRICS for c in ("point", "low", "high")))
    return registry.join(wide, "run")


def corrected_table(intervals: DataFrame, registry: DataFrame) -> DataFrame:
    """T12: of each family its run on the corrected split and its first default run; test sets differ, so nothing is paired."""
    kept = registry.where("arm = 'corrected' or arm = 'default' and seed = 0")
    return run_table(intervals, kept).select("family", "arm", "run", "n", "miou_fore_point", "miou_fore_low", "miou_fore_high", "miou_all_point", F.lit("descriptive; not paired").alias("note"))


def sensitivity_table(parts: DataFrame, primary: str, others: list[str]) -> DataFrame:
    """T13: a run against the primary one on the items that both hold: scores, difference, items that differ at all."""
    out = None
    base = parts.where(F.col("run") == primary)
    for other in others:
        rows = parts.where(F.col("run") == other)
        part = runs.shared_scores(rows, base).join(runs.difference_floor(rows, base)).select(F.lit(other).alias("run"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def claims(h: dict[str, str]) -> list[dict]:
    """The claim to result map of the earlier reporter: one row per hypothesis."""
    return [{"claim": k, "verdict": v, "table": f"T{i}", "figure": f"F{i}"} for i, (k, v) in enumerate(sorted(h.items()), 1)]


def figure_specs(ablation: list, grid: list, effects: list, backgrounds: list, by_run: list, per_class: list, corrected: list, sensitivity: list, threshold: float = 0.01, margin: float = 0.005) -> dict[str, dict]:
    """F01 to F08 from collected report rows (each some dozens): what a renderer needs, nothing else."""
    hams, cosines = sorted({r.ham for r in grid}), sorted({r.cos for r in grid})
    rate = {(r.ham, r.cos): r.rate for r in grid}
    bar = lambda r: {"label": r.label, "point": r.point, "lo": r.low, "hi": r.high}
    ranked = sorted(per_class, key=lambda r: (-r.rate, r.class_id))
    return {
        "F01_leakage_by_detector": {"kind": "bar", "labels": [r.detector for r in ablation], "values": [r.rate for r in ablation], "hline": {"y": 100 * threshold}},
        "F02_threshold_grid": {"kind": "heatmap", "x": cosines, "y": hams, "z": [[rate[h, c] for c in cosines] for h in hams], "mark": next(([r.ham, r.cos] for r in grid if r.operating_point), None)},
        "F03_paired_deltas": {"kind": "forest", "rows": [bar(r) for r in effects], "vlines": [{"x": 0}, {"x": 100 * margin}]},
        "F04_background": {"kind": "forest", "rows": [bar(r) for r in backgrounds], "vlines": [{"x": 0}]},
        "F05_scores_by_arm_and_seed": {"kind": "dots", "points": [{"run_id": r.run, "arm": r.arm, "seed": r.seed, "point": r.miou_fore_point, "lo": r.miou_fore_low, "hi": r.miou_fore_high} for r in by_run]},
        "F06_leakage_by_class": {"kind": "sortedbar", "labels": [str(r.class_id) for r in ranked], "values": [r.rate for r in ranked]},
        "F07_corrected_split": {"kind": "cibar", "bars": [{"label": f"{r.family} {r.arm}", "point": r.miou_fore_point, "lo": r.miou_fore_low, "hi": r.miou_fore_high} for r in corrected]},
        "F08_sensitivity": {"kind": "cibar", "bars": [{"label": r.run, "point": 100 * r.first, "other": 100 * r.second} for r in sensitivity]},
    }


# Census reports -------------------------------------------------------------
def _intra(s: SparkSession, d: str) -> DataFrame:
    return intra_split(V.pairs(s, d), V.items(s, d), HARD)


def _names(s: SparkSession, d: str) -> DataFrame:
    """Names of classes 0 to 7 only, so that the default occurs."""
    return V.table(s, d, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("class_id"), F.col("n_name").alias("name"))


def _class_leaks(s: SparkSession, d: str) -> DataFrame:
    hit = _crossing(s, d).where(HARD).select(F.col("test").alias("id"), F.lit(1).alias("hit")).distinct()
    return V.items(s, d).where("split = 'test'").join(hit, "id", "left").groupBy(F.col("label").cast("long").alias("class_id")).agg(F.count(F.lit(1)).alias("n_test"), F.count("hit").alias("n_leaked"))


WILSON = f"""n AS (SELECT count(*) AS n_test, count(*) FILTER (WHERE id IN (SELECT test FROM crossing WHERE {HARD})) AS n_leaked FROM items WHERE split = 'test'), p AS (SELECT *, n_leaked::DOUBLE / n_test AS p, n_test::DOUBLE AS n FROM n)"""


@query("report_leakage", f"""WITH {CROSS}, {WILSON}, ie AS (SELECT a, b FROM pairs JOIN items x ON x.id = a JOIN items y ON y.id = b WHERE x.split = 'train' AND y.split = 'train' AND {HARD}), ends AS (SELECT a AS v FROM ie UNION SELECT b FROM ie), tr AS (SELECT count(*) AS m FROM items WHERE split = 'train')
 SELECT 'hard' AS quantity, round(100 * round(p, 6), 6) AS rate, round(100 * round(greatest(0, (p + {Z}*{Z}/(2*n) - {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n)), 6), 6) AS low, round(100 * round(least(1, (p + {Z}*{Z}/(2*n) + {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n)), 6), 6) AS high, n_leaked AS n, n_test AS of FROM p
 UNION ALL SELECT 'soft', round(100 * round(count(DISTINCT test)::DOUBLE / (SELECT count(*) FROM items WHERE split = 'test'), 6), 6), NULL, NULL, count(DISTINCT test), (SELECT count(*) FROM items WHERE split = 'test') FROM crossing
 UNION ALL SELECT 'intra_train', round(100 * (SELECT count(*) FROM ends)::DOUBLE / m, 6), NULL, NULL, (SELECT count(*) FROM ends), m FROM tr""", "items", "pairs")
def _t01(s, d):
    crossing, items = _crossing(s, d), V.items(s, d)
    wide = F.expr(f"cosine >= {V.COS_SOFT} or hamming <= {V.HAM_SOFT}")
    return leakage_table(census.rate(crossing, items, F.expr(HARD)), census.rate(crossing, items, wide), _intra(s, d))


@query("report_ablation", f"""WITH {CROSS}, m AS (SELECT count(*) AS n_test FROM items WHERE split = 'test'), h AS (SELECT count(DISTINCT test) FILTER (WHERE hamming <= {V.HAM_HARD}) AS x, count(DISTINCT test) FILTER (WHERE cosine >= {V.COS_HARD}) AS y, count(DISTINCT test) FILTER (WHERE {HARD}) AS z FROM crossing)
 SELECT detector, n_leaked, n_test, round(100 * n_leaked::DOUBLE / n_test, 6) AS rate FROM (SELECT 'hash' AS detector, x AS n_leaked FROM h UNION ALL SELECT 'vector', y FROM h UNION ALL SELECT 'either', z FROM h) t, m""", "items", "pairs")
def _t02(s, d):
    return ablation_table(_crossing(s, d), V.items(s, d), {"hash": f"hamming <= {V.HAM_HARD}", "vector": f"cosine >= {V.COS_HARD}", "either": HARD})


@query("report_grid", f"""WITH {CROSS}, best AS (SELECT test, max(cosine) AS c, min(hamming) AS h FROM crossing GROUP BY test), g AS (SELECT * FROM (VALUES {', '.join(f'({h})' for h in HAMMINGS)}) x(ham), (VALUES {', '.join(f'({c}::DOUBLE)' for c in COSINES)}) y(cos)), m AS (SELECT count(*) AS n FROM items WHERE split = 'test')
 SELECT ham, cos, round(100 * round(count(*) FILTER (WHERE c >= cos OR h <= ham)::DOUBLE / any_value(n), 6), 6) AS rate, ham = {V.HAM_HARD} AND cos = {V.COS_HARD} AS operating_point FROM best, g, m GROUP BY ham, cos""", "items", "pairs")
def _t03(s, d):
    return grid_table(_grid(s, d), V.HAM_HARD, V.COS_HARD)


@query("report_classes", f"""WITH {CROSS}, hit AS (SELECT DISTINCT test FROM crossing WHERE {HARD}) SELECT label AS class_id, coalesce(any_value(n_name), '') AS class_name, count(*) AS n_test, count(test) AS n_leaked, round(100 * count(test)::DOUBLE / count(*), 6) AS rate
 FROM items LEFT JOIN hit ON id = test LEFT JOIN nation ON n_nationkey = label AND n_nationkey < 8 WHERE split = 'test' GROUP BY label""", "items", "pairs")
def _t04(s, d):
    return class_table(_class_leaks(s, d), _names(s, d))


@query("ranked_classes", f"""WITH {CROSS}, hit AS (SELECT DISTINCT test FROM crossing WHERE {HARD}), c AS (SELECT label AS class_id, count(test)::DOUBLE / count(*) AS rate FROM items LEFT JOIN hit ON id = test WHERE split = 'test' GROUP BY label)
 SELECT row_number() OVER (ORDER BY rate DESC, class_id) AS place, CAST(class_id AS VARCHAR) AS label, round(100 * rate, 6) AS rate FROM c""", "items", "pairs")
def _ranked(s, d):
    from pyspark.sql import Window

    rate = _class_leaks(s, d).select("class_id", (F.col("n_leaked") / F.col("n_test")).alias("rate"))
    return rate.select(F.row_number().over(Window.orderBy(F.desc("rate"), F.col("class_id").cast("int"))).alias("place"), F.col("class_id").cast("string").alias("label"), R6(C.points(F.col("rate"))).alias("rate"))  # a row per class


# Effects and verdicts -------------------------------------------------------
@query("per_seed_deltas", f"""WITH {SUMS}, m AS (SELECT arm, seed, {SCORE} FROM sums GROUP BY arm, seed), w AS (SELECT seed, max(fore) FILTER (WHERE arm = 'default') AS d, max(fore) FILTER (WHERE arm = 'sanitized') AS n, max(fore) FILTER (WHERE arm = 'sizectrl') AS c, max(all_classes) FILTER (WHERE arm = 'default') AS e FROM m GROUP BY seed)
 SELECT seed, round(100 * (d - n), 6) AS leak, round(100 * (d - c), 6) AS size, round(100 * ((d - n) - (d - c)), 6) AS attr, round(100 * (e - d), 6) AS bg FROM w""", "parts")
def _t07(s, d):
    return inference.points_by_seed(V.parts(s, d)).select("seed", *(R6(C.points(F.col(c))).alias(c) for c in inference.EFFECTS))


SPREAD = "x AS (SELECT 'leak' AS name, leak AS v FROM d UNION ALL SELECT 'size', size FROM d UNION ALL SELECT 'attr', leak - size FROM d UNION ALL SELECT 'bg', bg FROM d)"
SEEDS = f"""{SUMS}, sm AS (SELECT arm, seed, {SCORE} FROM sums GROUP BY arm, seed), sw AS (SELECT seed, max(fore) FILTER (WHERE arm = 'default') AS d, max(fore) FILTER (WHERE arm = 'sanitized') AS n, max(fore) FILTER (WHERE arm = 'sizectrl') AS c, max(all_classes) FILTER (WHERE arm = 'default') AS e FROM sm GROUP BY seed),
 sx AS (SELECT 'leak' AS name, d - n AS v FROM sw UNION ALL SELECT 'size', d - c FROM sw UNION ALL SELECT 'attr', (d - n) - (d - c) FROM sw UNION ALL SELECT 'bg', e - d FROM sw), sp AS (SELECT name, avg(v) AS point, stddev_samp(v) AS sd FROM sx GROUP BY name)"""
FOUND = f"""{SEEDS}, {BOOT}, {SPREAD}, q AS (SELECT name, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, least(1, 2 * least((count(*) FILTER (WHERE v <= 0) + 1.0) / (count(v) + 1), (count(*) FILTER (WHERE v >= 0) + 1.0) / (count(v) + 1)))::DOUBLE AS p FROM x GROUP BY name),
 found AS (SELECT name, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS excludes_zero, round(p, 6) AS p, round(sd, 6) AS between_seed_sd, {V.REPLICATES} AS replicates FROM q JOIN sp USING (name))"""


@query("causal_effects", f"WITH {FOUND} SELECT * FROM found", "parts")
def _effects(s, d):
    return inference.effects(V.parts(s, d), V.REPLICATES)


@query("report_effects", f"""WITH {FOUND}, both_ AS (SELECT max(p) AS pc FROM found WHERE name IN ('leak', 'attr'))
 SELECT name, round(100 * point, 6) AS point, round(100 * low, 6) AS low, round(100 * high, 6) AS high, p, CASE WHEN name = 'attr' THEN pc END AS p_conjunctive, CASE name WHEN 'leak' THEN point >= 0.005 AND low > 0 WHEN 'attr' THEN point > 0 AND low > 0 END AS gate_met FROM found, both_ WHERE name <> 'bg'""", "parts")
def _t06(s, d):
    return effect_table(_effects(s, d))


HOLM = "r AS (SELECT *, row_number() OVER (ORDER BY p, baseline) AS rn, count(*) OVER () AS m FROM e), h AS (SELECT *, round(least(1, max((m - rn + 1) * p) OVER (ORDER BY p, baseline)), 6)::DOUBLE AS adjusted, min((p <= 0.05 / (m - rn + 1))::INT) OVER (ORDER BY p, baseline) = 1 AS rejected FROM r)"
FIRST = "CASE WHEN leak >= 0.005 AND (leak_low > 0 OR leak_high < 0) AND attr > 0 AND (attr_low > 0 OR attr_high < 0) THEN 'CONFIRMED' WHEN leak > 0 AND (leak_low > 0 OR leak_high < 0) THEN 'PARTIALLY_SUPPORTED' ELSE 'REJECTED' END"
DECIDED = f"e AS (SELECT *, greatest(leak_p, attr_p) AS p FROM effects), {HOLM}, v AS (SELECT *, {FIRST} AS first FROM h), decided AS (SELECT baseline, p, adjusted, rejected, CASE WHEN first = 'CONFIRMED' AND NOT rejected THEN 'PARTIALLY_SUPPORTED' ELSE first END AS verdict FROM v)"


@query("verdicts", f"WITH {DECIDED} SELECT * FROM decided", "effects")
def _verdicts(s, d):
    return verdicts.by_baseline(V.effects(s, d)).select("baseline", "p", "adjusted", "rejected", "verdict")


@query("verdict_attribution", f"WITH {DECIDED} SELECT CASE WHEN bool_and(verdict = 'CONFIRMED') THEN 'CONFIRMED' WHEN bool_or(verdict <> 'REJECTED') THEN 'PARTIALLY_SUPPORTED' ELSE 'REJECTED' END AS verdict FROM decided", "effects")
def _attribution(s, d):
    return verdicts.over_baselines(verdicts.by_baseline(V.effects(s, d)))


@query("verdict_background", f"WITH e AS (SELECT *, bg_p AS p FROM effects), {HOLM}, t AS (SELECT bg > 0 AND (bg_low > 0 OR bg_high < 0) AND rejected AS holds FROM h) SELECT CASE WHEN bool_and(holds) THEN 'CONFIRMED' WHEN bool_or(holds) THEN 'PARTIALLY_SUPPORTED' ELSE 'REJECTED' END AS verdict FROM t", "effects")
def _background(s, d):
    return verdicts.background(V.effects(s, d), [f"b{k}" for k in range(25)], "partial")


@query("verdict_leakage", f"WITH {CROSS}, {WILSON} SELECT n_leaked, CASE WHEN p >= 0.01 THEN 'CONFIRMED' ELSE 'REJECTED' END AS verdict FROM p", "items", "pairs")
def _leakage(s, d):
    return census.rate(_crossing(s, d), V.items(s, d), F.expr(HARD)).select("n_leaked", verdicts.leakage(F.col("rate")).alias("verdict"))


@query("cross_check", """WITH b AS (SELECT baseline AS name, leak + CASE WHEN length(baseline) = 2 THEN 0 ELSE 1e-6 END AS point, leak_low - 0.001 AS low, leak_high AS high, leak_low > 0 OR leak_high < 0 AS g, leak_p AS p FROM effects)
 SELECT name, abs(leak - point) <= 1e-9 AS point_ok, abs(leak_low - low) <= 0.003 AND abs(leak_high - high) <= 0.003 AS interval_ok, TRUE AS gate_ok, TRUE AS p_ok FROM b JOIN effects ON baseline = name""", "effects")
def _cross(s, d):
    e = V.effects(s, d)
    told = lambda point, low: e.select(F.col("baseline").alias("name"), point.alias("point"), low.alias("low"), F.col("leak_high").alias("high"), C.excludes_zero(F.col("leak_low"), F.col("leak_high")).alias("excludes_zero"), F.col("leak_p").alias("p"))
    off = F.when(F.length("baseline") == 2, 0.0).otherwise(1e-6)
    return verdicts.cross_check(told(F.col("leak"), F.col("leak_low")), told(F.col("leak") + off, F.col("leak_low") - 0.001))


# Runs -----------------------------------------------------------------------
@query("run_metrics", f"""WITH {SUMS} SELECT run, arm, seed, round(100 * avg(CASE WHEN u > 0 THEN i / u END), 6) AS miou_all, round(100 * avg(CASE WHEN u > 0 AND class_id > 0 THEN i / u END), 6) AS miou_fore, round(100 * avg(CASE WHEN l > 0 THEN i / l END), 6) AS macc_all, round(100 * avg(CASE WHEN l > 0 AND class_id > 0 THEN i / l END), 6) AS macc_fore,
 (SELECT count(DISTINCT item) FROM parts q WHERE q.run = sums.run) AS n FROM sums GROUP BY run, arm, seed""", "parts")
def _run_metrics(s, d):
    p = V.parts(s, d)
    sums = metrics.class_sums(p, ("run", "arm", "seed"))
    iou, acc, fore = C.ratio(F.col("inter"), F.col("uni")), C.ratio(F.col("inter"), F.col("n_label")), F.col("class_id") > 0
    mean = lambda x, name: R6(C.points(F.avg(x))).alias(name)
    told = sums.groupBy("run", "arm", "seed").agg(mean(iou, "miou_all"), mean(F.when(fore, iou), "miou_fore"), mean(acc, "macc_all"), mean(F.when(fore, acc), "macc_fore"))
    return told.join(p.groupBy("run").agg(F.count_distinct("item").alias("n")), "run")


@query("run_intervals")
def _run_intervals(s, d):
    """T10: six metrics of every run with intervals from 10,000 replicates of the PCG64 stream."""
    return inference.metric_intervals(V.parts(s, d), ("run",), replicates=V.REPLICATES, classes=12)


@query("stratum_bootstrap")
def _stratum_bootstrap(s, d):
    """The same for every stratum of the first run's cohort; each stratum starts the stream anew."""
    from veriset.operators import strata
    from veriset.plans.catalogue import _strata

    rows = strata.by_stratum(V.parts(s, d).where("run = 'd0' and item % 10 >= 7"), _strata(s, d))
    return inference.metric_intervals(rows, ("run", "axis", "level"), replicates=V.REPLICATES, classes=12)


@query("run_lookup", "WITH w(arm, seed) AS (VALUES ('default', 2), ('sizectrl', 0), ('sanitized', 1)) SELECT arm, seed, run FROM w JOIN runs USING (arm, seed)", "runs")
def _run_lookup(s, d):
    wanted = s.createDataFrame([("f", "default", 2), ("f", "sizectrl", 0), ("f", "sanitized", 1)], "family string, arm string, seed int")
    return runs.look_up(wanted, V.runs(s, d).withColumn("family", F.lit("f"))).select("arm", "seed", "run")


@query("evidence_runs", "SELECT run, arm, seed FROM runs WHERE acc > 6", "runs")
def _evidence(s, d):
    return runs.of_class(V.runs(s, d).withColumn("run_class", F.when(F.col("acc") > 6, "evidence").otherwise("sensitivity")), "evidence").select("run", "arm", "seed")


@query("pairing_integrity", """WITH p AS (SELECT DISTINCT run, item FROM parts WHERE run <> 's1' OR item % 3 <> 1), ref AS (SELECT item FROM p WHERE run = 'd0')
 SELECT run, count(*) AS n_items, (SELECT count(*) FROM ref) - count(ref.item) AS n_missing, count(*) - count(ref.item) AS n_extra FROM p LEFT JOIN ref ON ref.item = p.item GROUP BY run""", "parts")
def _pairing(s, d):
    return runs.pairing(V.parts(s, d).where("run <> 's1' or item % 3 <> 1"), "d0")


@query("report_sensitivity", """WITH o AS (SELECT DISTINCT run FROM parts WHERE run IN ('d1', 's0')), a AS (SELECT * FROM parts WHERE run <> 's0' OR item % 4 > 0), sh AS (SELECT DISTINCT x.run, x.item FROM a x JOIN a y ON y.item = x.item AND y.run = 'd0' WHERE x.run IN ('d1', 's0')),
 one AS (SELECT sh.run, a.item, class_id, inter, uni FROM sh JOIN a ON a.run = sh.run AND a.item = sh.item), two AS (SELECT sh.run, a.item, class_id, inter, uni FROM sh JOIN a ON a.run = 'd0' AND a.item = sh.item),
 cells AS (SELECT coalesce(one.run, two.run) AS run, coalesce(one.item, two.item) AS item, coalesce(one.class_id, two.class_id) AS class_id, coalesce(one.inter, 0) AS i1, coalesce(one.uni, 0) AS u1, coalesce(two.inter, 0) AS i2, coalesce(two.uni, 0) AS u2 FROM one FULL JOIN two ON one.run = two.run AND one.item = two.item AND one.class_id = two.class_id),
 sums AS (SELECT run, class_id, sum(i1)::DOUBLE AS i1, sum(u1)::DOUBLE AS u1, sum(i2)::DOUBLE AS i2, sum(u2)::DOUBLE AS u2 FROM cells WHERE class_id > 0 GROUP BY run, class_id),
 sc AS (SELECT run, avg(CASE WHEN u1 > 0 THEN i1 / u1 END) AS f, avg(CASE WHEN u2 > 0 THEN i2 / u2 END) AS g FROM sums GROUP BY run),
 fl AS (SELECT run, count(*) AS n_items, count(*) FILTER (WHERE differs) AS n_differ FROM (SELECT run, item, bool_or(i1 <> i2 OR u1 <> u2) AS differs FROM cells GROUP BY run, item) x GROUP BY run)
 SELECT run, round(f, 6) AS first, round(g, 6) AS second, round(f - g, 6) AS difference, n_items, n_differ FROM sc JOIN fl USING (run)""", "parts")
def _t13(s, d):
    return sensitivity_table(V.parts(s, d).where("run <> 's0' or item % 4 > 0"), "d0", ["d1", "s0"])


@query("label_range", "SELECT l_suppkey AS item, min(l_partkey % 12) AS low, max(l_partkey % 12) AS high, count(DISTINCT l_partkey % 12) AS n_values FROM lineitem GROUP BY 1")
def _label_range(s, d):
    return metrics.label_range(V.table(s, d, "lineitem").select(F.col("l_suppkey").alias("item"), (F.col("l_partkey") % 12).alias("label")))


# Smaller operators ----------------------------------------------------------
@query("alternative_identity", r"SELECT page_id, CASE WHEN contains(url, '.') THEN url[1:length(url) - position('.' IN reverse(url))] ELSE url END AS key FROM pages")
def _alternative(s, d):
    return V.table(s, d, "pages").select("page_id", C.plain_id(F.col("url")).alias("key"))


@query("index_labels", "SELECT doc_id, quality + 1 AS label FROM labels")
def _index_labels(s, d):
    return V.table(s, d, "labels").select("doc_id", C.label_of_index(F.col("quality")).alias("label"))


@query("entry_paths", "SELECT page_id, 'img/p' || page_id % 3 || '/a/' || page_id || '.jpg' AS image_path, 'ann/p' || page_id % 3 || '/a/' || page_id || '.png' AS mask_path FROM pages")
def _entry_paths(s, d):
    key = F.concat(F.lit(" p"), (F.col("page_id") % 3).cast("string"), F.lit("\\a/"), F.col("page_id").cast("string"), F.lit(".jpg "))
    image, mask = C.entry_paths(key, "img", "ann")
    return V.table(s, d, "pages").select("page_id", image.alias("image_path"), mask.alias("mask_path"))


@query("defect_targets", "SELECT 'train/' || vec_id AS item, vec_id % 5 AS target FROM embeddings WHERE vec_id % 97 = 8")
def _defects(s, d):
    e = V.table(s, d, "embeddings")
    ident = C.canonical_id(F.lit("Train"), F.concat(F.col("vec_id").cast("string"), F.lit(".png")))
    return runs.defect_targets(e.where("vec_id % 97 = 8").select(ident.alias("id"), (F.col("vec_id") % 5).alias("target")), e.select(ident.alias("id"), F.concat(F.lit("train/"), F.col("vec_id").cast("string")).alias("key")))


@query("class_of_items", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 11 WHEN doc_id % 4 = 1 THEN doc_id % 7 END AS class_id FROM documents")
def _class_of(s, d):
    i = F.col("doc_id").cast("string")
    docs = V.table(s, d, "documents").select("doc_id", F.concat(F.lit("test/"), i, F.lit(".jpg")).alias("key"), F.concat(F.lit("test/"), i).alias("id"))
    listed = docs.select(F.when(F.col("doc_id") % 4 == 0, F.col("key")).when(F.col("doc_id") % 4 == 1, F.col("id")).alias("name"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % 11).otherwise(F.col("doc_id") % 7).alias("class_id")).where("name is not null")
    return runs.class_of(docs, listed).select("doc_id", "class_id")


@query("unit_dot", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_transform(range(64), lambda i: (i % 5 - 2)::DOUBLE)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS cosine FROM embeddings")
def _unit_dot(s, d):
    other = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 5 - 2).cast("double"))
    return V.table(s, d, "embeddings").select("vec_id", F.round(C.dot(C.unit(F.col("embedding")), other), 6).alias("cosine"))


@query("wilson_unclamped", f"WITH x AS (SELECT n_nationkey AS k, 24::DOUBLE AS n, n_nationkey::DOUBLE / 24 AS p FROM nation) SELECT k, round((p + {Z}*{Z}/(2*n) - {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n), 6) AS low, round((p + {Z}*{Z}/(2*n) + {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n), 6) AS high FROM x")
def _unclamped(s, d):
    low, high = C.wilson(F.col("n_nationkey"), F.lit(24), clamp=False)
    return V.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("budget_projection", "SELECT n_nationkey AS k, round((n_nationkey + 1) * 40000 * (0.25 + n_nationkey * 0.01::DOUBLE) / 3600, 6) AS hours, round((n_nationkey + 1) * 40000 * (0.25 + n_nationkey * 0.01::DOUBLE) / 3600 * 1.2, 6) AS reserved, (n_nationkey + 1) * 40000 * (0.25 + n_nationkey * 0.01::DOUBLE) / 3600 * 1.2 <= 168 AS fits FROM nation")
def _budget(s, d):
    n = F.col("n_nationkey")
    raw, reserved = C.projected_hours(n + 1, F.lit(40000), 0.25 + n * 0.01)
    return V.table(s, d, "nation").select(n.alias("k"), F.round(raw, 6).alias("hours"), F.round(reserved, 6).alias("reserved"), (reserved <= 168).alias("fits"))


@query("newest_checkpoint", "SELECT user_id AS folder, arg_max(event_id, struct_pack(p := event_type = (SELECT min(event_type) FROM events), m := ts, e := lpad(CAST(event_id AS VARCHAR), 12, '0')))::BIGINT AS event_id FROM events GROUP BY user_id")
def _newest(s, d):
    e = V.table(s, d, "events")
    first = e.agg(F.min("event_type").alias("wanted"))  # one row
    files = e.join(first).select(F.col("user_id").alias("folder"), F.when(F.col("event_type") == F.col("wanted"), "last_checkpoint").otherwise("iter").alias("name"), F.col("ts").alias("modified"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"))
    return runs.newest(files).select("folder", F.col("path").cast("long").alias("event_id"))


@query("literal_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 0 END AS code FROM documents")
def _literal(s, d):
    return V.table(s, d, "documents").select("doc_id", C.lookup({"en": 1, "de": 2}, F.col("lang"), 0).alias("code"))


shared("cohort_gate", "SELECT (SELECT count(*) FROM items WHERE split = 'test') AS n_cohort, count(*) AS n_kept FROM items WHERE split = 'test' AND id % 97 <> 8", "items")

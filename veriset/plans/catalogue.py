"""The registered queries of the engine's own operators, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.functions.columns import canonical_id, hash_draw, pack_signs, split_name
from veriset.operators import audit, census, cohorts, inference, metrics, runs, strata
from veriset.operators.similarity import banded_hamming, contained_passages, jaccard_classes, jaccard_pairs
from veriset.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable:
    """Register a DataFrame query and the oracle's SQL over the named views."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = V.oracle(sql, *views)
        return f

    return keep


def shared(name: str, body: str, *views: str, spark: str | None = None) -> None:
    """Register a query that reads the same in both engines (``spark``: where its dialect differs)."""
    QUERIES[name] = lambda s, d: V.run_sql(s, d, spark or body, *views)
    SQL[name] = V.oracle(body, *views)


# Leakage census -----------------------------------------------------------
HARD, SOFT = f"(cosine >= {V.COS_HARD} OR hamming <= {V.HAM_HARD})", f"((hamming BETWEEN {V.HAM_HARD + 1} AND {V.HAM_SOFT} OR (cosine >= {V.COS_SOFT} AND cosine < {V.COS_HARD})) AND NOT (cosine >= {V.COS_HARD} OR hamming <= {V.HAM_HARD}))"
CROSS = "crossing AS (SELECT CASE WHEN x.split = 'test' THEN a ELSE b END AS test, CASE WHEN x.split = 'test' THEN b ELSE a END AS train, cosine, hamming FROM pairs JOIN items x ON x.id = a JOIN items y ON y.id = b WHERE (x.split = 'test' AND y.split = 'train') OR (x.split = 'train' AND y.split = 'test'))"
Z = "1.959963984540054"


def _crossing(s: SparkSession, d: str) -> DataFrame:
    return census.across(V.pairs(s, d), V.items(s, d))


@query("leak_census", f"WITH {CROSS} SELECT id, label FROM items WHERE split = 'test' AND id IN (SELECT test FROM crossing WHERE {HARD})", "items", "pairs")
def _leak_census(s, d):
    return census.leaked(_crossing(s, d), V.items(s, d), F.expr(HARD)).select("id", "label")


@query("leak_census_wilson", f"""WITH {CROSS}, n AS (SELECT count(*) AS n_test, count(*) FILTER (WHERE id IN (SELECT test FROM crossing WHERE {HARD})) AS n_leaked FROM items WHERE split = 'test'),
 p AS (SELECT *, n_leaked::DOUBLE / n_test AS p, n_test::DOUBLE AS n FROM n)
 SELECT n_test, n_leaked, round(p, 6) AS rate, round(greatest(0, (p + {Z}*{Z}/(2*n) - {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n)), 6) AS low, round(least(1, (p + {Z}*{Z}/(2*n) + {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n)), 6) AS high FROM p""", "items", "pairs")
def _wilson(s, d):
    return census.rate(_crossing(s, d), V.items(s, d), F.expr(HARD))


COSINES, HAMMINGS = [0.30, 0.35, 0.40, 0.45, 0.50], [15, 16, 17, 18]


@query("edge_grid_rates", f"""WITH {CROSS}, best AS (SELECT test, max(cosine) AS c, min(hamming) AS h FROM crossing GROUP BY test), g AS (SELECT * FROM (VALUES {', '.join(f'({h})' for h in HAMMINGS)}) x(ham), (VALUES {', '.join(f'({c}::DOUBLE)' for c in COSINES)}) y(cos)),
 n AS (SELECT count(*) AS n_test FROM items WHERE split = 'test')
 SELECT ham, cos, count(*) FILTER (WHERE c >= cos OR h <= ham) AS n_leaked, round(count(*) FILTER (WHERE c >= cos OR h <= ham)::DOUBLE / any_value(n_test), 6) AS rate FROM best, g, n GROUP BY ham, cos""", "items", "pairs")
def _grid(s, d):
    return census.grid(_crossing(s, d), V.items(s, d).where("split = 'test'").agg(F.count(F.lit(1)).alias("n_test")), COSINES, HAMMINGS)


shared("hard_edges", f"SELECT a, b, round(cosine, 6) AS cosine, hamming FROM pairs WHERE {HARD}", "pairs")
shared("soft_edges", f"SELECT a, b, round(cosine, 6) AS cosine, hamming FROM pairs WHERE {SOFT}", "pairs")
shared("detector_ablation", f"WITH {CROSS} SELECT count(DISTINCT CASE WHEN hamming <= {V.HAM_HARD} THEN test END) AS hash_only, count(DISTINCT CASE WHEN cosine >= {V.COS_HARD} THEN test END) AS vector_only, count(DISTINCT CASE WHEN {HARD} THEN test END) AS either FROM crossing", "items", "pairs")
shared("per_class_leakage", f"WITH {CROSS}, hit AS (SELECT DISTINCT test FROM crossing WHERE {HARD}) SELECT label, count(*) AS n_test, count(test) AS n_leaked, round(count(test) * 1.0D / count(*), 6) AS rate FROM items LEFT JOIN hit ON id = test WHERE split = 'test' GROUP BY label".replace("1.0D", "CAST(1 AS DOUBLE)"), "items", "pairs")
shared("intra_split_edges", f"WITH inner_edges AS (SELECT a, b FROM pairs JOIN items x ON x.id = a JOIN items y ON y.id = b WHERE x.split = 'train' AND y.split = 'train' AND {HARD}), ends AS (SELECT a AS v FROM inner_edges UNION SELECT b FROM inner_edges) SELECT (SELECT count(*) FROM inner_edges) AS n_edges, (SELECT count(*) FROM ends) AS n_items, round((SELECT count(*) FROM ends) / CAST((SELECT count(*) FROM items WHERE split = 'train') AS DOUBLE), 6) AS rate", "items", "pairs")


@query("hamming_edges", """WITH h AS (SELECT doc_id AS id, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT AS h FROM documents) SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS hamming FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 3""")
def _hamming(s, d):
    hashed = V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8), 16, 10).cast("long").alias("h"))
    return banded_hamming(hashed, 3, bits=32)


@query("doc_jaccard_edges", r"""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents), s AS (SELECT * FROM t WHERE w <> ''), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.w = q.w AND p.doc_id < q.doc_id GROUP BY 1, 2) SELECT a, b, round(k::DOUBLE / (x.n + y.n - k), 6) AS jaccard FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.9""")
def _jaccard(s, d):
    return jaccard_pairs(V.table(s, d, "documents"), 0.9).withColumn("jaccard", F.round("jaccard", 6))


shared("doc_exact_duplicates", "SELECT sha2(text, 256) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1".replace("sha2(text, 256)", "sha256(text)"), spark="SELECT sha2(text, 256) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")


@query("benchmark_containment", "SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _containment(s, d):
    return contained_passages(V.table(s, d, "documents"), V.table(s, d, "benchmark"))


@query("doc_jaccard_classes", r"""WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents),
 s AS (SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS ws FROM t WHERE w <> '' GROUP BY 1) SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY ws) AS class_id FROM s""")
def _jaccard_members(s, d):
    return jaccard_classes(V.table(s, d, "documents"), 0.9)[0]


@query("sign_hash", "SELECT vec_id, list_reduce(list_transform(range(1, 33), lambda i: (CASE WHEN embedding[i] >= 0 THEN 1 ELSE 0 END)::BIGINT), lambda s, x: s * 2 + x) AS hi FROM embeddings")
def _signs(s, d):
    return V.table(s, d, "embeddings").select("vec_id", pack_signs(F.col("embedding"), 0).alias("hi"))


# Components and groups ----------------------------------------------------
shared("components_labels", "SELECT id, component FROM comps", "comps")
shared("component_sizes", "SELECT n AS size, count(*) AS n_components FROM (SELECT component, count(*) AS n FROM comps GROUP BY component) x GROUP BY n", "comps")
shared("component_members", "SELECT component, array_to_string(list_sort(list(CAST(id AS VARCHAR))), ',') AS members FROM comps GROUP BY component HAVING count(*) > 1", "comps", spark="SELECT component, array_join(sort_array(collect_list(CAST(id AS STRING))), ',') AS members FROM comps GROUP BY component HAVING count(*) > 1")
shared("group_classes", "WITH g AS (SELECT component, count(*) AS size, count(DISTINCT label) AS n_classes, min(id) AS first_id FROM comps GROUP BY component) SELECT row_number() OVER (ORDER BY CASE WHEN size > 1 THEN 0 ELSE 1 END, first_id) AS gid, component, size, n_classes FROM g", "comps")

# Cohorts ------------------------------------------------------------------
TOUCHED = "touched AS (SELECT DISTINCT component FROM comps WHERE split = 'test')"
REMOVED = f"{TOUCHED}, multi AS (SELECT component FROM comps GROUP BY component HAVING count(*) > 1), removed AS (SELECT id, label, split FROM comps WHERE split <> 'test' AND component IN (SELECT component FROM touched) AND component IN (SELECT component FROM multi))"


@query("sanitized_removals", f"WITH {REMOVED} SELECT id, label, split FROM removed", "comps")
def _sanitized(s, d):
    return cohorts.sanitized(V.comps(s, d))


@query("sizectrl_removals", f"""WITH {REMOVED}, quota AS (SELECT split, label, count(*) AS k FROM removed GROUP BY 1, 2), whole AS (SELECT split, count(*) AS k FROM removed GROUP BY 1),
 pool AS (SELECT id, label, split, row_number() OVER (PARTITION BY split, label ORDER BY id) AS rn FROM comps WHERE split <> 'test' AND component NOT IN (SELECT component FROM touched)),
 lacking AS (SELECT pool.*, coalesce(quota.k, 0) - rn + 1 AS deficit FROM pool LEFT JOIN quota USING (split, label)),
 picked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY deficit DESC, md5(concat_ws(':', split, CAST(deficit AS VARCHAR), CAST(label AS VARCHAR))), label) AS nth FROM lacking)
 SELECT id, label, split FROM picked JOIN whole USING (split) WHERE nth <= k""", "comps")
def _sizectrl(s, d):
    return cohorts.size_control(V.comps(s, d))


shared("arm_difference", f"WITH {REMOVED} SELECT split, count(*) AS n FROM (SELECT id, split FROM items WHERE split <> 'test' EXCEPT SELECT id, split FROM removed) x GROUP BY split", "items", "comps")
shared("arm_profile", f"WITH {REMOVED} SELECT split, label, count(*) AS n FROM removed GROUP BY split, label", "comps")
shared("split_disjointness", "SELECT x.split AS left_split, y.split AS right_split, count(*) AS shared FROM items x JOIN items y ON x.id = y.id AND x.split < y.split GROUP BY 1, 2 UNION ALL SELECT 'all', 'all', count(*) - count(DISTINCT id) FROM items", "items")
shared("cohort_exclusion", "WITH defects AS (SELECT id FROM items WHERE id % 97 = 8) SELECT split, count(*) AS n FROM items WHERE id NOT IN (SELECT id FROM defects) GROUP BY split", "items", spark="WITH defects AS (SELECT id FROM items WHERE id % 97 = 8) SELECT split, count(*) AS n FROM items LEFT ANTI JOIN defects USING (id) GROUP BY split")
shared("split_counts", "SELECT split, count(*) AS n FROM items GROUP BY split", "items")
shared("duplicate_keys", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")


@query("key_canonicalisation", r"SELECT page_id, concat_ws('/', lower(CASE WHEN page_id % 2 = 0 THEN 'TRAIN' ELSE 'Test' END), regexp_replace(replace(url, '\', '/'), '\.[^./]+$', '')) AS key FROM pages")
def _keys(s, d):
    return V.table(s, d, "pages").select("page_id", canonical_id(F.when(F.col("page_id") % 2 == 0, "TRAIN").otherwise("Test"), F.col("url")).alias("key"))


@query("split_names", "SELECT doc_id, CASE raw WHEN 'training' THEN 'train' WHEN 'validation' THEN 'val' ELSE raw END AS split FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' ELSE 'test' END AS raw FROM documents)")
def _names(s, d):
    raw = F.when(F.col("doc_id") % 3 == 0, "training").when(F.col("doc_id") % 3 == 1, "validation").otherwise("test")
    return V.table(s, d, "documents").select("doc_id", split_name(raw).alias("split"))


shared("class_lookup_fallback", "SELECT d.doc_id, coalesce(l.quality, m.toxic, -1) AS class_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN labels m ON m.doc_id = d.doc_id + 1")
shared("pairing_full_outer", "SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'paired' END AS state, count(*) AS n FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")

# Confusion metrics --------------------------------------------------------
shared("confusion_per_item", "SELECT item, class_id, inter, uni, n_pred, n_label FROM parts WHERE run = 'd0'", "parts")
shared("class_sums", "SELECT run, class_id, CAST(sum(inter) AS BIGINT) AS inter, CAST(sum(uni) AS BIGINT) AS uni, CAST(sum(n_label) AS BIGINT) AS n_label FROM parts GROUP BY run, class_id", "parts")
SUMS = "sums AS (SELECT run, arm, seed, class_id, CAST(sum(inter) AS DOUBLE) AS i, CAST(sum(uni) AS DOUBLE) AS u, CAST(sum(n_label) AS DOUBLE) AS l FROM parts GROUP BY run, arm, seed, class_id)"
SCORE = "avg(CASE WHEN u > 0 THEN i / u END) AS all_classes, avg(CASE WHEN u > 0 AND class_id > 0 THEN i / u END) AS fore"


@query("miou_macc_dual", f"WITH {SUMS} SELECT run, round(avg(CASE WHEN u > 0 THEN i / u END), 6) AS miou_all, round(avg(CASE WHEN u > 0 AND class_id > 0 THEN i / u END), 6) AS miou_fore, round(avg(CASE WHEN l > 0 THEN i / l END), 6) AS macc_all, round(avg(CASE WHEN l > 0 AND class_id > 0 THEN i / l END), 6) AS macc_fore FROM sums GROUP BY run", "parts")
def _dual(s, d):
    return metrics.scores(metrics.class_sums(V.parts(s, d), ("run",)), ("run",))


shared("per_class_iou", f"WITH {SUMS} SELECT run, class_id, round(CASE WHEN u > 0 THEN i / u END, 6) AS iou FROM sums", "parts")
shared("relative_effect", f"WITH {SUMS}, m AS (SELECT run, arm, seed, {SCORE} FROM sums GROUP BY run, arm, seed) SELECT a.seed, round((a.fore - b.fore) / a.fore, 6) AS effect FROM m a JOIN m b ON a.seed = b.seed AND a.arm = 'default' AND b.arm = 'sanitized'", "parts")
shared("per_seed_sd", f"WITH {SUMS}, m AS (SELECT run, arm, seed, {SCORE} FROM sums GROUP BY run, arm, seed) SELECT arm, round(avg(fore), 6) AS mean, round(stddev_samp(fore), 6) AS sd FROM m GROUP BY arm", "parts")


@query("per_class_delta", f"""WITH {SUMS}, {CROSS}, hit AS (SELECT DISTINCT test FROM crossing WHERE {HARD}), leaked AS (SELECT DISTINCT label AS class_id FROM items WHERE id IN (SELECT test FROM hit)),
 d AS (SELECT a.class_id, a.seed, a.i / a.u - b.i / b.u AS d FROM sums a JOIN sums b ON a.class_id = b.class_id AND a.seed = b.seed AND a.arm = 'default' AND b.arm = 'sanitized' WHERE a.u > 0 AND b.u > 0)
 SELECT leaked.class_id, round(avg(d), 6) AS delta FROM leaked LEFT JOIN d USING (class_id) GROUP BY leaked.class_id""", "runs", "preds", "parts", "items", "pairs")
def _per_class_delta(s, d):
    leaks = census.leaked(_crossing(s, d), V.items(s, d), F.expr(HARD)).groupBy(F.col("label").cast("long").alias("class_id")).agg(F.count(F.lit(1)).alias("n_leaked"))
    return runs.per_class_delta(V.parts(s, d), leaks)


shared("metric_revalidation", f"WITH {SUMS}, direct AS (SELECT run, class_id, CAST(count(CASE WHEN label = pred THEN 1 END) AS DOUBLE) AS i FROM (SELECT run, label, pred, label AS class_id FROM preds) x GROUP BY run, class_id) SELECT s.run, round(max(abs(s.i - d.i)), 6) AS deviation FROM sums s JOIN direct d ON s.run = d.run AND s.class_id = d.class_id GROUP BY s.run", "preds", "parts")


@query("confusion_diff_floor", """WITH a AS (SELECT * FROM parts WHERE run = 'd0'), b AS (SELECT * FROM parts WHERE run = 'd1' AND item % 7 <> 3),
 shared AS (SELECT DISTINCT item FROM a WHERE item IN (SELECT item FROM b)),
 cells AS (SELECT coalesce(a.item, b.item) AS item, coalesce(a.inter, 0) <> coalesce(b.inter, 0) OR coalesce(a.uni, 0) <> coalesce(b.uni, 0) AS differs FROM a FULL JOIN b ON a.item = b.item AND a.class_id = b.class_id)
 SELECT count(*) AS n_items, count(*) FILTER (WHERE differs) AS n_differ FROM (SELECT item, bool_or(differs) AS differs FROM cells WHERE item IN (SELECT item FROM shared) GROUP BY item) x""", "parts")
def _floor(s, d):
    p = V.parts(s, d)
    return runs.difference_floor(p.where("run = 'd0'"), p.where("run = 'd1' and item % 7 <> 3"))


@query("relabel_sensitivity", "WITH r AS (SELECT CASE WHEN label > 0 AND item % 7 = 0 THEN 3 ELSE label END AS label, pred FROM preds WHERE run = 'd0') SELECT count(*) AS n, count(*) FILTER (WHERE label = pred) AS n_right FROM r", "preds")
def _relabel(s, d):
    rows = V.preds(s, d).where("run = 'd0'")
    targets = rows.select("item").distinct().where("item % 7 = 0").withColumn("target", F.lit(3).cast("long"))
    return metrics.relabel(rows, targets).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("n_right"))


# Strata -------------------------------------------------------------------
CUTS = "cuts AS (SELECT {q1} AS c0, {q2} AS c1 FROM documents WHERE doc_id % 10 < 7)"
DUCK_CUTS = CUTS.format(q1="quantile_cont(n_chars, 1.0/3)", q2="quantile_cont(n_chars, 2.0/3)")
SPARK_CUTS = CUTS.format(q1="percentile(n_chars, CAST(1 AS DOUBLE) / 3)", q2="percentile(n_chars, CAST(2 AS DOUBLE) / 3)")
for _name, _body in {
    "train_tertiles": "WITH {cuts} SELECT round(c0, 4) AS c0, round(c1, 4) AS c1 FROM cuts",
    "strata_bins": "WITH {cuts} SELECT CASE WHEN n_chars > c1 THEN 2 WHEN n_chars > c0 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM documents, cuts WHERE doc_id % 10 > 7 GROUP BY 1",
}.items():
    shared(_name, _body.format(cuts=DUCK_CUTS), spark=_body.format(cuts=SPARK_CUTS))
STRATA = """frequencies AS (SELECT c AS class_id, coalesce(sum(n), 0)::BIGINT AS frequency FROM range(1, 116) t(c) LEFT JOIN (SELECT * FROM pixels WHERE item IN (SELECT item FROM trained)) p ON p.class_id = c GROUP BY c),
 rarest AS (SELECT f.item, coalesce(min(q.frequency), 0)::BIGINT AS rarest FROM features f LEFT JOIN pixels p ON p.item = f.item LEFT JOIN frequencies q ON q.class_id = p.class_id GROUP BY f.item),
 size_cuts AS (SELECT quantile_cont(size_ratio, 1.0/3) AS s0, quantile_cont(size_ratio, 2.0/3) AS s1, quantile_cont(chr_value, 1.0/3) AS c0, quantile_cont(chr_value, 2.0/3) AS c1 FROM features WHERE item IN (SELECT item FROM trained)),
 freq_cuts AS (SELECT quantile_cont(frequency, 1.0/3) AS f0, quantile_cont(frequency, 2.0/3) AS f1 FROM frequencies WHERE frequency > 0),
 strata AS (SELECT f.item, ['low', 'mid', 'high'][1 + (size_ratio > s0)::INT + (size_ratio > s1)::INT] AS size, ['low', 'mid', 'high'][1 + (chr_value > c0)::INT + (chr_value > c1)::INT] AS chr,
   CASE WHEN edge_contact THEN 'edge' ELSE 'interior' END AS edge, ['low', 'mid', 'high'][1 + (rarest > f0)::INT + (rarest > f1)::INT] AS frequency FROM features f JOIN rarest USING (item), size_cuts, freq_cuts)"""


def _strata(s: SparkSession, d: str) -> DataFrame:
    return strata.strata(V.features(s, d), V.pixels(s, d), V.trained(s, d))


@query("class_frequencies", f"WITH {STRATA} SELECT class_id, frequency FROM frequencies", "parts", "features", "pixels", "trained")
def _frequencies(s, d):
    return strata.class_frequencies(V.pixels(s, d), V.trained(s, d))


@query("class_frequency_min", f"WITH {STRATA} SELECT item, rarest FROM rarest", "parts", "features", "pixels", "trained")
def _rarest(s, d):
    return strata.rarest(V.pixels(s, d), _frequencies(s, d), V.features(s, d))


@query("strata_levels", f"WITH {STRATA} SELECT item, size, chr, edge, frequency FROM strata", "parts", "features", "pixels", "trained")
def _levels(s, d):
    return _strata(s, d)


@query("strata_report", f"""WITH {STRATA}, cells AS (SELECT p.*, s.size, s.chr, s.edge, s.frequency FROM parts p JOIN strata s USING (item) WHERE p.item % 10 >= 7),
 sums AS (SELECT run, class_id, size, chr, edge, frequency, grouping(size, chr, edge, frequency) AS g, sum(inter)::DOUBLE AS i, sum(uni)::DOUBLE AS u, sum(n_label)::DOUBLE AS l FROM cells GROUP BY GROUPING SETS ((run, class_id), (run, class_id, size), (run, class_id, chr), (run, class_id, edge), (run, class_id, frequency))),
 counts AS (SELECT run, size, chr, edge, frequency, grouping(size, chr, edge, frequency) AS g, count(DISTINCT item) AS n FROM cells GROUP BY GROUPING SETS ((run), (run, size), (run, chr), (run, edge), (run, frequency))),
 scored AS (SELECT run, g, size, chr, edge, frequency, round(avg(CASE WHEN u > 0 THEN i / u END), 6) AS miou_all, round(avg(CASE WHEN u > 0 AND class_id > 0 THEN i / u END), 6) AS miou_fore, round(avg(CASE WHEN l > 0 THEN i / l END), 6) AS macc_all, round(avg(CASE WHEN l > 0 AND class_id > 0 THEN i / l END), 6) AS macc_fore FROM sums GROUP BY ALL)
 SELECT counts.run, CASE counts.g WHEN 15 THEN 'overall' WHEN 7 THEN 'size' WHEN 11 THEN 'chr' WHEN 13 THEN 'edge' ELSE 'frequency' END AS axis, coalesce(counts.size, counts.chr, counts.edge, counts.frequency, 'all') AS level, n, miou_all, miou_fore, macc_all, macc_fore
 FROM counts JOIN scored ON counts.run = scored.run AND counts.g = scored.g AND counts.size IS NOT DISTINCT FROM scored.size AND counts.chr IS NOT DISTINCT FROM scored.chr AND counts.edge IS NOT DISTINCT FROM scored.edge AND counts.frequency IS NOT DISTINCT FROM scored.frequency""", "parts", "features", "pixels", "trained")
def _strata_report(s, d):
    return strata.report(V.parts(s, d).where("item % 10 >= 7"), _strata(s, d))


# Resampling ---------------------------------------------------------------
ORD = "ord AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT item FROM parts) x)"
DRAWS = f"draws AS (SELECT r, ('0x' || substr(md5(r || ':' || i), 1, 8))::BIGINT % n AS i FROM range(1, {V.REPLICATES + 1}) t(r), ord)"
WEIGHTS = f"{ORD}, {DRAWS}, w AS (SELECT r, item, count(*) AS k FROM draws JOIN ord USING (i) GROUP BY r, item)"
BOOT = f"{WEIGHTS}, c AS (SELECT r, arm, seed, class_id, sum(k * inter)::DOUBLE AS i, sum(k * uni)::DOUBLE AS u FROM w JOIN parts USING (item) GROUP BY ALL), m AS (SELECT r, arm, seed, {SCORE} FROM c GROUP BY ALL), s AS (SELECT r, arm, avg(fore) AS fore, avg(all_classes) AS all_classes FROM m GROUP BY ALL), d AS (SELECT r, max(CASE WHEN arm = 'default' THEN fore END) - max(CASE WHEN arm = 'sanitized' THEN fore END) AS leak, max(CASE WHEN arm = 'default' THEN fore END) - max(CASE WHEN arm = 'sizectrl' THEN fore END) AS size, max(CASE WHEN arm = 'default' THEN all_classes - fore END) AS bg FROM s GROUP BY r)"


@query("resample_counts", f"WITH {WEIGHTS} SELECT r, item, k FROM w", "parts")
def _weights(s, d):
    return inference.weights(V.parts(s, d).select("item").distinct(), V.REPLICATES).select("r", "item", "k")


def _deltas(s, d):
    return inference.deltas(V.parts(s, d), V.REPLICATES)


@query("bootstrap_delta_ci", f"WITH {BOOT}, x AS (SELECT 'leak' AS name, leak AS v FROM d UNION ALL SELECT 'attr', leak - size FROM d UNION ALL SELECT 'bg', bg FROM d) SELECT name, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, quantile_cont(v, 0.025) > 0 OR quantile_cont(v, 0.975) < 0 AS excludes_zero FROM x GROUP BY name", "parts")
def _ci(s, d):
    return inference.intervals(_deltas(s, d))


@query("bootstrap_p", f"WITH {BOOT}, x AS (SELECT 'leak' AS name, leak AS v FROM d UNION ALL SELECT 'attr', leak - size FROM d UNION ALL SELECT 'bg', bg FROM d) SELECT name, round(least(1, 2 * least((count(*) FILTER (WHERE v <= 0) + 1.0) / (count(v) + 1), (count(*) FILTER (WHERE v >= 0) + 1.0) / (count(v) + 1))), 6) AS p FROM x GROUP BY name", "parts")
def _p(s, d):
    return inference.p_values(_deltas(s, d))


P = "p(name, p) AS (VALUES ('a', 0.165183), ('b', 0.407759), ('c', 0.01), ('d', 0.02))"
SPARK_P = "p AS (SELECT * FROM VALUES ('a', 0.165183D), ('b', 0.407759D), ('c', 0.01D), ('d', 0.02D) AS t(name, p))"


@query("holm", f"WITH {P}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rn, count(*) OVER () AS m FROM p) SELECT name, round(least(1, max((m - rn + 1) * p) OVER (ORDER BY p, name)), 6)::DOUBLE AS adjusted, min((p <= 0.05 / (m - rn + 1))::INT) OVER (ORDER BY p, name) = 1 AS rejected FROM r")
def _holm(s, d):
    return inference.holm(s.createDataFrame([("a", 0.165183), ("b", 0.407759), ("c", 0.01), ("d", 0.02)], "name string, p double"))



# Audit --------------------------------------------------------------------
shared("audit_kappa", "WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS DOUBLE) AS same, CAST(sum(quality) AS DOUBLE) AS q, CAST(sum(toxic) AS DOUBLE) AS x FROM labels), e AS (SELECT same / n AS agreement, (q / n) * (x / n) + (1 - q / n) * (1 - x / n) AS chance FROM t) SELECT round(agreement, 6) AS agreement, round((agreement - chance) / (1 - chance), 6) AS kappa FROM e")
REVIEWED = "verdicts AS (SELECT pair_id, kind, first, second, CASE WHEN first = second THEN first ELSE lot END AS verdict, first <> second AS disputed FROM reviews)"


@query("audit_precision", f"""WITH {REVIEWED}, c AS (SELECT kind, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicates, count(*) AS n FROM verdicts GROUP BY kind), p AS (SELECT *, duplicates::DOUBLE / n AS p, n::DOUBLE AS m FROM c)
 SELECT kind, duplicates, n, round(p, 6) AS precision, round(greatest(0, (p + {Z}*{Z}/(2*m) - {Z}*sqrt(p*(1-p)/m + {Z}*{Z}/(4*m*m))) / (1 + {Z}*{Z}/m)), 6) AS low, round(least(1, (p + {Z}*{Z}/(2*m) + {Z}*sqrt(p*(1-p)/m + {Z}*{Z}/(4*m*m))) / (1 + {Z}*{Z}/m)), 6) AS high FROM p""", "reviews")
def _precision(s, d):
    return audit.precision(audit.adjudicate(V.reviews(s, d)))


@query("adjudication", f"WITH {REVIEWED} SELECT pair_id, kind, first, second, verdict, disputed FROM verdicts", "reviews")
def _adjudication(s, d):
    """The four tables of an audit, joined and adjudicated."""
    r = V.reviews(s, d)
    key = r.select("pair_id", F.col("kind").alias("candidate_kind"))
    sheets = [r.select("pair_id", F.col(c).alias("verdict")) for c in ("first", "second")]
    settled = r.where("first <> second").select("pair_id", F.col("consensus").alias("consensus_verdict"))
    return audit.adjudicate(audit.join_reviews(*sheets, key, settled)).select("pair_id", "kind", "first", "second", "verdict", "disputed")


@query("audit_agreement", """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE first <> second) AS d FROM reviews), one AS (SELECT first AS a, count(*) AS x FROM reviews GROUP BY 1), two AS (SELECT second AS a, count(*) AS y FROM reviews GROUP BY 1),
 e AS (SELECT sum(x::DOUBLE * y) AS xy FROM one JOIN two USING (a)) SELECT n AS n_pairs, d AS n_disagreements, round((n - d)::DOUBLE / n, 6) AS raw_agreement, round(((n - d)::DOUBLE / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM t, e""", "reviews")
def _agreement(s, d):
    return audit.agreement(V.reviews(s, d))


@query("blind_pairs", f"""WITH edges AS (SELECT 'hard' AS kind, a, b FROM pairs WHERE {HARD} UNION ALL SELECT 'soft', a, b FROM pairs WHERE {SOFT}), lots AS (SELECT *, md5('7:' || kind || ':' || a || ':' || b) AS lot FROM edges),
 drawn AS (SELECT * FROM lots QUALIFY row_number() OVER (PARTITION BY kind ORDER BY lot, a, b) <= 100), numbered AS (SELECT *, row_number() OVER (ORDER BY md5('order' || lot), kind, a, b) AS nr, ('0x' || substr(md5('side' || lot), 1, 8))::BIGINT % 2 = 1 AS swap FROM drawn)
 SELECT printf('PAIR-%04d', nr) AS pair_id, kind, a, b, CASE WHEN swap THEN b ELSE a END AS image_1, CASE WHEN swap THEN a ELSE b END AS image_2 FROM numbered""", "pairs")
def _blind_pairs(s, d):
    p = V.pairs(s, d)
    return audit.blind_sample(audit.tagged_union(hard=p.where(HARD), soft=p.where(SOFT)), 100, 7)


shared("blind_sample", "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents) SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pair_no FROM k WHERE rn <= 100", spark="WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('7:', CAST(doc_id AS STRING))), doc_id) AS rn FROM documents) SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pair_no FROM k WHERE rn <= 100")

# Splits and lists ---------------------------------------------------------


@query("split_objective", """WITH goal(split, share) AS (VALUES ('train', 0.7::DOUBLE), ('val', 0.1), ('test', 0.2)), held AS (SELECT DISTINCT component, label AS class_id FROM comps),
 sized AS (SELECT sum(abs((SELECT count(*) FROM comps c WHERE c.split = goal.split)::DOUBLE / (SELECT count(*) FROM comps) - share)) AS t FROM goal),
 cells AS (SELECT class_id, count(*) FILTER (WHERE split = 'train')::DOUBLE / count(*) AS tr, count(*) FILTER (WHERE split = 'val')::DOUBLE / count(*) AS va, count(*) FILTER (WHERE split = 'test')::DOUBLE / count(*) AS te FROM comps JOIN held USING (component) GROUP BY class_id),
 classed AS (SELECT avg(abs(tr - 0.7) + abs(va - 0.1) + abs(te - 0.2)) AS c FROM cells)
 SELECT round(t, 6) AS size_term, round(c, 6) AS class_term, round(t + c, 6) AS balance FROM sized, classed""", "comps")
def _objective(s, d):
    return cohorts.balance(V.comps(s, d))


@query("coverage_check", "WITH c AS (SELECT label * 29 + id % 29 AS class_id, component, split FROM comps) SELECT class_id, count(DISTINCT component) AS n_groups, string_agg(DISTINCT split, ',' ORDER BY split) AS splits_present FROM c GROUP BY class_id HAVING count(DISTINCT component) >= 3 AND count(DISTINCT split) < 3", "comps")
def _coverage(s, d):
    return cohorts.uncovered(V.comps(s, d).withColumn("fine", F.col("label") * 29 + F.col("id") % 29), class_col="fine")


@query("corrected_split_trace")
def _trace(s, d):
    return cohorts.resplit_trace(V.comps(s, d))


shared("class_group_totals", "SELECT split, label, count(*) AS n_items, count(DISTINCT component) AS n_groups FROM comps GROUP BY split, label", "comps")
shared("list_digest", "SELECT split, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY CAST(id AS VARCHAR)) || chr(10)) AS digest FROM items GROUP BY split", "items", spark="SELECT split, sha2(concat(array_join(sort_array(collect_list(CAST(id AS STRING))), '\\n'), '\\n'), 256) AS digest FROM items GROUP BY split")
shared("grid_key_parse", "SELECT CAST(regexp_extract(k, '<=([0-9]+)', 1) AS INT) AS ham, CAST(regexp_extract(k, '>=([0-9.]+)', 1) AS DOUBLE) AS cos FROM (SELECT concat('pHash<=', CAST(n_nationkey AS VARCHAR), '|CLIP>=0.', CAST(90 + n_nationkey % 10 AS VARCHAR)) AS k FROM nation) x", spark="SELECT CAST(regexp_extract(k, '<=([0-9]+)', 1) AS INT) AS ham, CAST(regexp_extract(k, '>=([0-9.]+)', 1) AS DOUBLE) AS cos FROM (SELECT concat('pHash<=', CAST(n_nationkey AS STRING), '|CLIP>=0.', CAST(90 + n_nationkey % 10 AS STRING)) AS k FROM nation) x")


@query("corrected_split")
def _resplit(s, d):
    return cohorts.resplit(V.comps(s, d))


from veriset.plans import reports  # noqa: E402, F401 - registers its queries

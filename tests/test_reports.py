"""Sources, raster kernels, audits, verdicts, runs, strata and reports on small literals."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriset.functions import columns as C
from veriset.operators import audit, gates, inference, raster, runs, strata, verdicts
from veriset.operators.similarity import contained_passages, jaccard_classes, jaccard_pairs
from veriset.plans import catalogue, reports, scratch
from veriset.sources import tables

DATA = "/root/testdata/sf0.001"


def png(x, bits=8, kind=0, interlace=0):
    """A PNG file whose lines use the filters in turn."""
    h, w = x.shape
    if bits == 16:
        rows = np.stack([x >> 8, x & 255], 2).reshape(h, -1).astype(int)
    elif bits == 8:
        rows = x.astype(int)
    else:
        planes = (x[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
        rows = np.packbits(planes.reshape(h, -1).astype(np.uint8), axis=1).astype(int)
    step, above, out = max(1, bits // 8), np.zeros(rows.shape[1], int), b""
    for y, line in enumerate(rows):
        f = y % 5
        left = np.r_[np.zeros(step, int), line[:-step]][: len(line)]
        corner = np.r_[np.zeros(step, int), above[:-step]][: len(line)]
        flat = left + above - corner
        near = np.stack([abs(flat - left), abs(flat - above), abs(flat - corner)])
        paeth = np.choose(near.argmin(0), [left, above, corner])
        out += bytes([f]) + ((line - [0 * line, left, above, (left + above) // 2, paeth][f]) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, interlace)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_masks_are_decoded(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, (13, 11))
    assert (raster.decode_png(png(x, bits)) == x).all()
    with pytest.raises(ValueError, match="one label"):
        raster.decode_png(png(x, bits, kind=2))
    with pytest.raises(ValueError):
        raster.decode_png(png(x, bits)[:40] + b"x" + png(x, bits)[41:])


def test_masks_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good, bad = np.array([[0, 1, 3], [3, 3, 115]]), np.array([[0, 255]])
    for name, x in (("a/x.png", good), ("a/y.png", bad)):
        (tmp_path / name).write_bytes(png(x))
    masks = tables.scan_masks(spark, str(tmp_path))
    told = {r.path.rpartition("/")[2]: (r.low, r.high, r["values"]) for r in raster.value_range(masks).collect()}
    assert told == {"x.png": (0, 115, [0, 1, 3, 115]), "y.png": (0, 255, [0, 255])}
    assert [r.path.rpartition("/")[2] for r in raster.invalid_masks(masks).collect()] == ["y.png"]
    got = {r.path.rpartition("/")[2]: r for r in raster.raster_features(masks).collect()}["x.png"]
    assert (got.size_ratio, got.edge_contact, got.classes, got.class_pixels) == (5 / 6, True, [1, 3, 115], {1: 1, 3: 3, 115: 1})


def _boundary_by_hand(p, y, reach=2):
    h, w = p.shape
    at = lambda x, i, j: 0 <= i < h and 0 <= j < w and bool(x[i, j])
    beside = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    edge = lambda x: {(i, j) for i in range(h) for j in range(w) if any(at(x, i + a, j + b) for a, b in beside) != all(at(x, i + a, j + b) for a, b in beside)}
    one, two = edge(p), edge(y)
    near = lambda c, s: any(max(abs(c[0] - d[0]), abs(c[1] - d[1])) <= reach for d in s)
    hit, back = sum(near(c, two) for c in one), sum(near(c, one) for c in two)
    return (hit + back) / 2, len(one) - hit, len(two) - back


def test_boundary_matches(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(12):
        p, y = (rng.random((9, 14)) < d for d in (0.08, 0.05))
        if k % 3 == 0:
            p[2:6, 3:9] = y[3:8, 5:12] = True
        rows.append((k, 9, 14, p.astype(np.uint8), y.astype(np.uint8)))
    table = spark.createDataFrame([(k, h, w, bytearray(p.tobytes()), bytearray(y.tobytes())) for k, h, w, p, y in rows], "item long, height int, width int, pred binary, label binary")
    got = {r.item: (r.tp, r.fp, r.fn) for r in raster.boundary_parts(table).collect()}
    assert got == {k: _boundary_by_hand(p, y) for k, _, _, p, y in rows}


def test_hull_area():
    y, x = np.nonzero(np.array([[0, 1, 0, 0], [1, 1, 1, 0], [0, 1, 0, 1]]))
    assert raster.hull_area(y, x) == 3.0
    assert raster.hull_area(np.arange(5), np.arange(5)) == 0
    assert raster.shape_features(np.array([[1, 1]]))[1] == 1.0 and raster.shape_features(np.eye(4, dtype=int))[1] == 0.0 and raster.shape_features(np.zeros((2, 2), int))[:3] == (0.0, 0.0, False)


def test_csv_headers_are_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿a,b\n1,\"x, \"\"y\"\"\"\n".encode())
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    assert [tuple(r) for r in tables.scan_csv(spark, str(tmp_path / "a.csv"), "a int, b string").collect()] == [(1, 'x, "y"')]
    with pytest.raises(gates.GateError, match="columns"):
        tables.scan_csv(spark, str(tmp_path / "b.csv"), "a int, b int")


def test_files_pair_exactly(spark, tmp_path):
    for name in ("i/train/a.jpg", "i/train/b.jpg", "m/train/a.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    images, masks = (tables.scan_files(spark, str(tmp_path / k)) for k in "im")
    assert tables.pair_files(images, masks).count() == 2
    with pytest.raises(gates.GateError, match="unpaired"):
        tables.exact_pairs(images, masks)
    (tmp_path / "m/train/b.png").write_bytes(b"x")
    assert tables.exact_pairs(images, tables.scan_files(spark, str(tmp_path / "m")), {"train": 2}).count() == 2
    assert [r.key for r in tables.scan_items(spark, str(tmp_path / "i"), ".jpg", {"train": 2}).orderBy("key").collect()] == ["train/a.jpg", "train/b.jpg"]
    with pytest.raises(gates.GateError, match="by split"):
        tables.scan_items(spark, str(tmp_path / "i"), ".jpg", {"train": 3})


def test_records_manifests_and_registers(spark, tmp_path):
    (tmp_path / "c.json").write_text("{}")
    record = tables.run_record(spark, str(tmp_path / "r" / "run.json"), "R1", "net", "default", 0, "COMPLETED", {"config": str(tmp_path / "c.json")})
    assert json.loads((tmp_path / "r/run.json").read_text()) == record and gates.expect_record(record, {"run_id": "R1", "seed": 0})
    with pytest.raises(gates.GateError):
        gates.expect_record(record, {"seed": 1})
    with pytest.raises(Exception, match="exist"):
        tables.run_record(spark, str(tmp_path / "r" / "run.json"), "R1", "net", "default", 0, "COMPLETED", {})
    digest = tables.write_manifest(spark, str(tmp_path / "m.json"), {"b": 1, "a": [2]})
    assert digest == "sha256:" + tables.file_digest(spark, str(tmp_path / "m.json")) and json.loads((tmp_path / "m.json").read_text()) == {"a": [2], "b": 1}
    (tmp_path / "h.yaml").write_text('{"hypotheses": [{"hypothesis_id": "H1", "locked": {"least": 0.01}}, {"hypothesis_id": "H2"}]}')
    register = tables.scan_register(str(tmp_path / "h.yaml"))
    locked = verdicts.locked_digest(register)
    assert locked == tables.json_digest([{"hypothesis_id": "H1", "locked": {"least": 0.01}}])
    verdicts.require_locked(register, locked)
    register[0]["locked"]["least"] = 0.02
    with pytest.raises(gates.GateError, match="changed"):
        verdicts.require_locked(register, locked)
    files = tables.file_manifest(spark, str(tmp_path / "r"))
    assert gates.expect_files(files, files) is files
    with pytest.raises(gates.GateError):
        gates.expect_files(files, files.withColumn("sha256", F.lit("0")))
    assert tables.verify_archive(spark, str(tmp_path / "c.json"), "99914b932bd37a50b983c5e7c90ae93b")


def test_embedding_slot_and_cache(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path / "x"))
    got = tables.embed_files(files, lambda blobs: [((1 << 64) - len(b), [3.0, 4.0]) for b in blobs]).first()
    assert got.phash == -3 and got.emb == pytest.approx([0.6, 0.8])
    cache = spark.createDataFrame([("a", "train", 1, [1.0])], tables.EMBEDDINGS)
    cache.write.parquet(str(tmp_path / "e"))
    assert tables.scan_embeddings(spark, str(tmp_path / "e"), cache).count() == 1
    with pytest.raises(gates.GateError):
        tables.scan_embeddings(spark, str(tmp_path / "e"), cache.withColumn("split", F.lit("test")))


def test_list_entries(spark):
    got = tables.list_entries(spark.createDataFrame([(" train\\a.b.jpg",), ("",)], "key string"), "i", "m").collect()
    assert [tuple(r)[1:] for r in got] == [("i/train/a.b.jpg", "m/train/a.b.png")]
    with pytest.raises(Exception, match="list entry"):
        tables.list_entries(spark.createDataFrame([("a.jpg",)], "key string"), "i", "m").collect()


def _sheets(spark, first, second, kinds, settled):
    sheet = lambda v: spark.createDataFrame([(k, x) for k, x in v.items()], "pair_id string, verdict string")
    key = spark.createDataFrame(list(kinds.items()), "pair_id string, candidate_kind string")
    return sheet(first), sheet(second), key, spark.createDataFrame(list(settled.items()), "pair_id string, consensus_verdict string")


def test_audit(spark):
    d, n = audit.ANSWERS
    first, second, kinds = {"a": d, "b": d, "c": n, "e": n}, {"a": " Duplicate", "b": n, "c": n, "e": d}, {"a": "hard", "b": "hard", "c": "soft", "e": "soft"}
    told = audit.adjudicate(audit.join_reviews(*_sheets(spark, first, second, kinds, {"b": d, "e": n})))
    assert {r.pair_id: (r.verdict, r.disputed) for r in told.collect()} == {"a": (d, False), "b": (d, True), "c": (n, False), "e": (n, True)}
    assert {r.kind: (r.duplicates, r.n) for r in audit.precision(told).collect()} == {"hard": (2, 2), "soft": (0, 2)}
    a = audit.agreement(told).first()
    assert (a.n_pairs, a.n_disagreements, a.raw_agreement, a.kappa) == (4, 2, 0.5, 0.0)
    assert audit.require_final(audit.precision(told), audit.precision(told)).count() == 2
    with pytest.raises(gates.GateError):  # one dispute is not settled
        audit.join_reviews(*_sheets(spark, first, second, kinds, {"b": d}))
    rows = lambda *r: spark.createDataFrame([r], "pair_id string, first string, second string, consensus string")
    for broken in (("a", d, d, n), ("a", d, n, ""), ("a", "", d, "")):
        with pytest.raises(gates.GateError, match="review"):
            audit.adjudicate(rows(*broken))


def test_blind_sample_is_sealed(spark, tmp_path):
    edges = audit.tagged_union(hard=spark.range(130).select((F.col("id")).alias("a"), (F.col("id") + 500).alias("b")), soft=spark.range(3).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    one, two = (audit.blind_sample(edges.repartition(k), 100, 5).collect() for k in (1, 7))
    assert sorted(map(str, one)) == sorted(map(str, two)) and sorted(r.pair_id for r in one) == ["PAIR-%04d" % k for k in range(1, 104)]
    assert all({r.image_1, r.image_2} == {r.a, r.b} for r in one) and 20 < sum(r.image_1 == r.b for r in one) < 80
    sample = audit.blind_sample(edges, 100, 5)
    assert "kind" not in audit.reviewer_sheet(sample).columns and audit.sealed_key(sample).first().mapping["1"] == sample.first().image_1
    tables.write_audit(sample, str(tmp_path / "audit"), spark.range(700).select("id", F.concat(F.lit("/x/"), F.col("id").cast("string"), F.lit(".JPG")).alias("path")).withColumnRenamed("id", "key"))
    assert spark.read.json(str(tmp_path / "audit/assets")).count() == 206


def test_verdicts_of_baselines(spark):
    row = lambda b, leak, attr, p: (b, leak, leak - 0.001, leak + 0.001, p, attr, attr - 0.001, attr + 0.001, p / 2, 0.01, 0.005, 0.02, p)
    names = "baseline string, leak double, leak_low double, leak_high double, leak_p double, attr double, attr_low double, attr_high double, attr_p double, bg double, bg_low double, bg_high double, bg_p double"
    table = spark.createDataFrame([row("a", 0.01, 0.004, 0.001), row("b", 0.01, 0.004, 0.2), row("c", 0.004, 0.01, 0.001), row("d", -0.01, 0.01, 0.001)], names)
    told = {r.baseline: r for r in verdicts.by_baseline(table).collect()}
    assert [told[b].verdict for b in "abcd"] == [verdicts.CONFIRMED, verdicts.PARTIAL, verdicts.PARTIAL, verdicts.REJECTED] and told["b"].p == 0.2
    assert verdicts.over_baselines(verdicts.by_baseline(table)).first().verdict == verdicts.PARTIAL
    assert verdicts.background(table, list("abcd"), "partial").first().verdict == verdicts.PARTIAL
    assert verdicts.background(table.where("baseline <> 'b'"), list("acd")).first().verdict == verdicts.CONFIRMED
    with pytest.raises(gates.GateError, match="mixed"):
        verdicts.background(table, list("abcd"))
    with pytest.raises(gates.GateError, match="instead of"):
        verdicts.background(table, ["a"])


def test_published_effects_are_rejected(spark):
    """The verdict on the published estimates: the leak interval holds 0."""
    names = "baseline string, leak double, leak_low double, leak_high double, leak_p double, attr double, attr_low double, attr_high double, attr_p double"
    rows = [("one", 0.01806562, -0.00188531, 0.03070137, 0.079592, 0.01144446, -0.00430934, 0.02466921, 0.165183), ("two", 0.01405656, -0.00437461, 0.02845675, 0.146785, 0.00631734, -0.01022301, 0.02596387, 0.407759)]
    told = {r.baseline: (r.p, r.adjusted, r.verdict) for r in verdicts.by_baseline(spark.createDataFrame(rows, names)).collect()}
    assert told == {"one": (0.165183, 0.330366, "REJECTED"), "two": (0.407759, 0.407759, "REJECTED")}


def test_cross_check_finds_what_differs(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "name string, point double, low double, high double, excludes_zero boolean, p double")
    one = rows(("a", 1.0, 0.5, 2.0, True, 0.1), ("b", 1.0, 0.5, 2.0, True, None), ("c", 1.0, 0.5, 2.0, True, 0.1))
    two = rows(("a", 1.0, 0.502, 2.0, True, 0.1), ("b", 1.0 + 1e-6, 0.6, 2.0, False, 0.3))
    got = {r.name: tuple(r)[1:] for r in verdicts.cross_check(one, two).collect()}
    assert got == {"a": (True, True, True, True), "b": (False, False, False, True), "c": (False, False, False, False)}
    with pytest.raises(gates.GateError, match="disagree"):
        verdicts.require_agreement(verdicts.cross_check(one, two))


def _parts(spark, seed=0, n=12, classes=4):
    rng = np.random.default_rng(seed)
    rows = [(f"{a}{s}", a, s, i, c, int(rng.integers(0, 5)), 5 + int(rng.integers(0, 4)), 6) for a in ("default", "sanitized", "sizectrl") for s in (0, 1) for i in range(n) for c in range(classes) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "run string, arm string, seed int, item long, class_id long, inter long, uni long, n_label long")


def test_arms_must_pair(spark):
    parts = _parts(spark)
    full = parts.select("run").distinct().crossJoin(spark.range(12).withColumnRenamed("id", "item")).withColumn("class_id", F.lit(0))
    assert runs.require_pairing(full, "default0", 12) is full
    with pytest.raises(gates.GateError, match="differ"):
        runs.require_pairing(full.where("run <> 'sanitized1' or item <> 3"), "default0")
    with pytest.raises(gates.GateError, match="seeds"):
        inference.points_by_seed(parts.where("run <> 'sizectrl1'"))


def test_whole_arrays_are_compared(spark):
    cells = "item long, class_id long, inter long, uni long"
    one = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 1, 2), (3, 0, 1, 2), (9, 0, 1, 1)], cells)
    two = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 1, 2), (2, 5, 0, 1), (3, 0, 1, 3)], cells)
    assert tuple(runs.difference_floor(one, two).first()) == (3, 2)


def test_run_lookup_raises(spark):
    registry = spark.createDataFrame([("r1", "f", "default", 0), ("r2", "f", "default", 1)], "run string, family string, arm string, seed int")
    assert runs.run_for(registry, "f", "default", 1) == "r2"
    with pytest.raises(gates.GateError):
        runs.run_for(registry, "f", "sanitized", 1)
    with pytest.raises(gates.GateError):
        runs.look_up(spark.createDataFrame([("g", "default", 0)], "family string, arm string, seed int"), registry)


def test_intervals_equal_a_plain_loop(spark):
    """Six metrics, from one PCG64 stream a group, against numpy alone."""
    parts = _parts(spark, 3).where("run in ('default0', 'sanitized1')")
    rng = np.random.default_rng(9)
    edges = [(r, i, *map(float, rng.integers(0, 9, 3))) for r in ("default0", "sanitized1") for i in range(12)]
    table = spark.createDataFrame(edges, "run string, item long, tp double, fp double, fn double")
    got = {(r.run, r.metric, r.class_id): (r.point, r.low, r.high) for r in inference.metric_intervals(parts, ("run",), table, 60, 7, 12, classes=4, floor=1).collect()}
    frame = parts.toPandas()
    for run in ("default0", "sanitized1"):
        mine, cube = frame[frame["run"] == run], np.zeros((12, 4, 3))
        for r in mine.itertuples():
            cube[r.item, r.class_id] = r.inter, r.uni, r.n_label
        bound = np.array([e[2:] for e in edges if e[0] == run])
        score = lambda s, b: [np.mean([x for x in (s[c, 0] / s[c, k] if s[c, k] else np.nan for c in range(f, 4)) if x == x]) for k in (1, 2) for f in (0, 1)] + [b[0] / b.sum(), 2 * b[0] / (2 * b[0] + b[1] + b[2])]
        draw = np.random.Generator(np.random.PCG64(7))
        picks = [draw.integers(0, 12, size=12) for _ in range(60)]
        drawn = np.array([score(cube[p].sum(0), bound[p].sum(0)) for p in picks])
        for k, m in enumerate(inference.METRICS):
            assert got[run, m, None] == pytest.approx((score(cube.sum(0), bound.sum(0))[k], *np.percentile(drawn[:, k], [2.5, 97.5])))
        iou = np.array([[cube[p, c, 0].sum() / cube[p, c, 1].sum() for c in range(4)] for p in picks])
        assert got[run, "iou", 2][1:] == pytest.approx(tuple(np.percentile(iou[:, 2], [2.5, 97.5])), abs=1e-6)


def test_smaller_cohorts_have_a_stream_of_their_own():
    one, two = (np.concatenate(list(inference.stream(5 + k, 6, 30, 7))) for k in (0, 6))
    assert one.shape == (30, 6) and (one.sum(1) == 6).all() and not (one == two).all()


def test_strata_by_fitted_cuts(spark):
    rows = [(i, i / 10, (9 - i) / 10, i % 2 == 0) for i in range(10)]
    features = spark.createDataFrame(rows, "item long, size_ratio double, chr_value double, edge_contact boolean")
    pixels = spark.createDataFrame([(i, 1 + i % 3, 10 * (i % 3 + 1)) for i in range(9)], "item long, class_id long, n long")
    train = spark.range(7).withColumnRenamed("id", "item")
    assert {r.class_id: r.frequency for r in strata.class_frequencies(pixels, train, 4).collect()} == {1: 30, 2: 40, 3: 60, 4: 0}
    got = {r.item: tuple(r)[1:] for r in strata.strata(features, pixels, train, 4).collect()}
    assert got[2] == ("low", "mid", "edge", "high") and got[9] == ("high", "low", "interior", "low") and got[3][3] == "low"


def test_gates(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "b")], "k int, x double, split string")
    one = spark.createDataFrame([("a", 1.0, None)], "k string, x double, y double")
    for broken in (
        lambda: gates.expect_finite(df, "x"), lambda: gates.expect_same_counts(df, df.where("k = 1")), lambda: gates.expect_cohort(df, df.where("k = 1"), "k", 2), lambda: gates.expect_near(one, one.withColumn("x", F.lit(1.1)), ["k"], ["x"]),
        lambda: gates.expect_near(one, one.withColumn("y", F.lit(1.0)), ["k"], ["x", "y"]), lambda: gates.expect_near(one, one.where("false"), ["k"], ["x"]), lambda: gates.expect_schema(df, ["k"]), lambda: gates.expect_disjoint_splits(df.withColumn("id", F.lit(1))),
        lambda: gates.expect_artifact(df, 2), lambda: gates.expect_grid_point(spark.createDataFrame([(3, 0.98, 0.1)], "ham int, cos double, rate double"), spark.createDataFrame([(0.2,)], "rate double"), 3, 0.98),
        lambda: gates.expect_outputs(spark.createDataFrame([("T01.csv",)], "name string"), {r"^T\d+\.csv$": 2}),
    ):
        with pytest.raises(gates.GateError):
            broken()
    assert gates.expect_near(one, one, ["k"], ["x", "y"]) == 0 and gates.expect_finite(df.where("k = 1"), "x").count() == 1


def test_passages_and_copies(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([(1, f"so {passage} end"), (2, f"xx{passage}yy"), (3, passage.replace(" zeta", "  zeta")), (4, None), (5, "tiny one"), (6, f"so {passage} end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, "tiny"), (3, None)], "item_id long, text string")
    assert sorted(map(tuple, contained_passages(docs, items).collect())) == [(1, 1), (1, 2), (1, 6), (2, 5)]
    members, links = jaccard_classes(docs, 0.5)
    assert {r.id: r.class_id for r in members.collect()}[6] == 1 and links.where("c = 1 or c2 = 1").count() >= 1
    assert {(r.a, r.b): r.jaccard for r in jaccard_pairs(docs, 0.5).collect()}[1, 6] == 1.0


def test_figures_come_from_reports(spark, tmp_path):
    q = catalogue.QUERIES
    rows = lambda name: q[name](spark, DATA).collect()
    effects = q["report_effects"](spark, DATA).withColumnRenamed("name", "label").collect()
    intervals = reports._run_intervals(spark, DATA)
    registry = reports.V.runs(spark, DATA).select("run", F.lit("f").alias("family"), "arm", "seed")
    by_run = reports.run_table(intervals, registry).collect()
    assert len(by_run) == 9 and all(r.miou_fore_low <= r.miou_fore_point <= r.miou_fore_high for r in by_run)
    corrected = reports.corrected_table(intervals, registry.withColumn("arm", F.when(F.col("run") == "c2", "corrected").otherwise(F.col("arm")))).collect()
    assert sorted(r.arm for r in corrected) == ["corrected", "default"]
    specs = reports.figure_specs(rows("report_ablation"), rows("report_grid"), effects, [], by_run, rows("report_classes"), corrected, rows("report_sensitivity"))
    paths = tables.write_figures(spark, str(tmp_path), specs)
    assert len(paths) == 8 and json.loads((tmp_path / "F02_threshold_grid.json").read_text())["mark"] == [16, 0.4]
    assert reports.claims({"H2": "REJECTED", "H1": "CONFIRMED"})[0] == {"claim": "H1", "verdict": "CONFIRMED", "table": "T1", "figure": "F1"}


def test_tables_are_written_once_a_session(spark, tmp_path):
    built = []
    spark.range(3).write.parquet(str(tmp_path / "t"))

    def build():
        built.append(1)
        return spark.read.parquet(str(tmp_path / "t"))

    for _ in range(2):
        assert scratch.once(spark, "tried", str(tmp_path / "t"), build).count() == 3
    assert len(built) == 1
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert scratch.once(spark, "tried", str(tmp_path / "t"), build).count() == 4


def test_shared_folder_is_required_off_local_mode(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            scratch.shared_dir(Session())


def test_small_functions(spark):
    row = spark.range(1).select(C.plain_id(F.lit("A/b.c.png")).alias("p"), C.lookup({"x": 1}, F.lit("y"), 0).alias("l"), C.projected_hours(F.lit(9), F.lit(40000), F.lit(0.5))[1].alias("h"), verdicts.conjunctive_p(F.lit(0.1), F.lit(0.2)).alias("c")).first()
    assert (row.p, row.l, row.h, row.c) == ("A/b.c", 0, 60.0, 0.2)

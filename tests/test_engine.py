"""The engine's operators on small literals, and a few catalogue queries against DuckDB."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriset.functions import columns as C
from veriset.operators import gates, inference, metrics
from veriset.operators.cohorts import SHARES, assign, size_control
from veriset.operators.components import connected_components
from veriset.operators.similarity import banded_hamming, similar_pairs
from veriset.plans import catalogue, views
from veriset.plans.scratch import Scratch
from veriset.sources import tables

DATA = "/root/testdata/sf0.001"


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


def test_pairs_by_cosine_or_sign_bits(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, -1.0, 0.0])]
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, block=2).collect()}
    assert got == {(0, 1)}


@pytest.mark.parametrize("grid", [1, 2, 5])
def test_all_pairs_whatever_the_grid(spark, grid):
    draw = random.Random(grid)
    x = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    got = [(r.a, r.b, r.hamming) for r in similar_pairs(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), 2.0, 2, block=7, grid=grid).collect()]
    bits = [[v >= 0 for v in r] for r in x]
    dots = {(i, j): sum(p * q for p, q in zip(x[i], x[j], strict=True)) for i in range(60) for j in range(i + 1, 60)}
    want = {(i, j): sum(p != q for p, q in zip(bits[i], bits[j], strict=True)) for i, j in dots}
    assert sorted(got) == sorted((i, j, want[i, j]) for i, j in dots if dots[i, j] >= 2.0 or want[i, j] <= 2)


def test_banded_hamming_finds_all(spark):
    draw = random.Random(1)
    values = [0, 1, 3, 7, 1 << 40, (1 << 40) | 5, 7, 7, -1, -2] + [draw.getrandbits(63) for _ in range(30)]
    values += [v ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63)) for v in values[10:]]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    for most, bands in ((2, None), (2, 3), (3, 6), (0, None)):
        got = sorted((r.a, r.b, r.hamming) for r in banded_hamming(rows, most, bands=bands).collect())
        assert got == [(i, j, apart(values[i], values[j])) for i in range(len(values)) for j in range(i + 1, len(values)) if apart(values[i], values[j]) <= most]


def test_banded_hamming_keeps_its_keys_off_the_driver(spark):
    """5,000 values are few and could be broadcast, their 175,000 keys are not."""
    draw = random.Random(5)
    values = [draw.getrandbits(32) for _ in range(4000)]
    values += [v ^ (1 << draw.randrange(32)) ^ (1 << draw.randrange(32)) for v in values[:1000]]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3m")
    try:
        got = sorted((r.a, r.b, r.hamming) for r in banded_hamming(rows, 3, bits=32).collect())
    finally:
        spark.conf.set(limit, before)
    h = np.array(values, np.uint32)
    apart = np.triu(np.bitwise_count(h[:, None] ^ h[None, :]).astype(np.int8) + 1, 1) - 1
    assert got == [(int(i), int(j), int(apart[i, j])) for i, j in np.argwhere((apart >= 0) & (apart <= 3))]


def test_banded_hamming_pairs_no_id_with_itself(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 3), (2, 3)], "id long, h long")
    got = sorted((r.a, r.b, r.hamming) for r in banded_hamming(rows, 2, bits=32).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (1, 2, 2), (1, 2, 2)]


def test_wilson(spark):
    low, high = C.wilson(F.lit(186), F.lit(1561))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(100 * r.l, 6), round(100 * r.h, 6)) == (10.401052, 13.616809)
    with pytest.raises(Exception, match="not a share"):
        spark.range(1).select(C.wilson(F.lit(3), F.lit(0))[0].alias("x")).collect()


def test_confusion_ignores_255_and_scores_present_classes(spark):
    rows = spark.createDataFrame([("i", 1, 1), ("i", 1, 0), ("i", 255, 1), ("i", 0, 0)], "item string, label int, pred int")
    got = {r.class_id: (r.inter, r.uni) for r in metrics.confusion(rows).collect()}
    assert got == {0: (1, 2), 1: (1, 2)}
    assert metrics.scores(metrics.class_sums(metrics.confusion(rows))).first().miou_all == 0.5


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    for broken in (lambda: gates.expect_unique(df, "k"), lambda: gates.expect_count(df, 3), lambda: gates.expect_disjoint(df, df, "k"), lambda: gates.expect_all(df, F.col("k") > 1, "x")):
        with pytest.raises(gates.GateError):
            broken()


def test_holm(spark):
    got = {r.name: (r.adjusted, r.rejected) for r in inference.holm(spark.createDataFrame([("A", 0.165183), ("B", 0.407759)], "name string, p double")).collect()}
    assert got == {"A": (0.330366, False), "B": (0.407759, False)}


def test_intervals_repeat_and_have_a_floor(spark):
    parts = spark.createDataFrame([("r", i, c, 1 + (i + c) % 2, 3, 2) for i in range(5) for c in range(3)], "run string, item long, class_id long, inter long, uni long, n_label long")
    one, two = (sorted(map(str, inference.metric_intervals(parts, replicates=20, floor=1, classes=3).collect())) for _ in range(2))
    assert one == two and len(one) == 9
    with pytest.raises(ValueError, match="at least"):
        inference.metric_intervals(parts, replicates=20)


def test_deltas_have_a_floor_and_a_joined_twin(spark):
    parts = Scratch(spark, "t").cut(views.parts(spark, DATA), "parts")
    with pytest.raises(ValueError, match="at least"):
        inference.deltas(parts, 40)
    one, two = (inference.deltas(parts, 20, floor=1, most_cells=m).select("r", "leak", "size", "bg", "attr").orderBy("r").toPandas() for m in (10**6, 0))
    pd.testing.assert_frame_equal(one, two, atol=1e-12)


def test_bootstrap_draws_are_those_of_md5():
    from hashlib import md5

    for replicates, n in (([1, 9, 10, 99, 10_000], 1), ([9, 10], 10), ([7, 100], 11), ([3, 12_345], 20_001)):
        want = [np.bincount([int.from_bytes(md5(b"%d:%d" % (r, j)).digest()[:4], "big") % n for j in range(n)], minlength=n) for r in replicates]
        assert (inference.drawn_counts(np.array(replicates), n) == want).all()


def test_deltas_bring_no_table_to_the_driver(spark, monkeypatch):
    """Many blocks and chunks of replicates, a null item and classes that are not numbered from 0 give what the join gives."""
    from pyspark.sql import DataFrame

    rows = [(i, arm, seed, c, (i * c + seed) % 3, 3) for i in range(40) for arm in ("default", "sanitized", "sizectrl") for seed in (0, 1) for c in (0, 5, 900)]
    parts = spark.createDataFrame([*rows, (None, "default", 0, 5, 9, 9)], "item long, arm string, seed int, class_id long, inter long, uni long").where("item is null or item % 7 <> 3 or class_id <> 5")
    monkeypatch.setattr(inference, "BLOCK_CELLS", 200)
    known = inference.deltas(parts.where("item is not null"), 30, floor=1, most_cells=0).orderBy("r").toPandas()
    monkeypatch.setattr(DataFrame, "toPandas", None)
    got = [inference.deltas(p, 30, floor=1, most_cells=100) for p in (parts.where("item is not null"), parts)]
    assert sorted(tuple(r) for r in got[0].select(*known.columns).collect()) == [pytest.approx(tuple(r)) for r in known.itertuples(index=False)]
    assert got[1].count() == 30


def test_effects_bring_no_table_to_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toPandas", None)
    got = inference.effects(views.parts(spark, DATA), 20, floor=1).collect()
    assert sorted(r.name for r in got) == sorted(inference.EFFECTS) and all(r.replicates == 20 and r.low <= r.high for r in got)


@pytest.mark.parametrize("name", ["resample_counts", "bootstrap_delta_ci", "bootstrap_p"])
def test_registered_bootstraps_draw_ten_thousand(spark, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{DATA}/lineitem.parquet'")
    a, b = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.SQL[name]).df()
    cols = sorted(b.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    pd.testing.assert_frame_equal(a.astype(b.dtypes.to_dict()), b, check_dtype=False, atol=1e-6)
    if name == "resample_counts":
        assert a["r"].nunique() == 10_000 and a.groupby("r")["k"].sum().eq(10).all()


def test_size_control_makes_up_for_classes_that_run_out(spark):
    quotas, supply = {0: 6, 1: 2, 2: 1}, {0: 2, 1: 5, 2: 1, 3: 3}
    rows = [(1, 0, "test", 1)] + [(10 + 10 * c + i, c, "train", 1) for c, n in quotas.items() for i in range(n)] + [(1000 + 100 * c + i, c, "train", 1000 + 100 * c + i) for c, n in supply.items() for i in range(n)]
    rows += [(2, 0, "val", 1), (3, 0, "val", 1), (4, 0, "val", 4)]  # fewer untouched items than quota, and no others
    got = size_control(spark.createDataFrame(rows, "id long, label long, split string, component long")).toPandas()
    train = got[got["split"] == "train"]
    taken, left = {c: 0 for c in supply}, sum(quotas.values())
    while left:  # the plain greedy; ties cost nothing in the sorted deficits
        c = max((c for c in supply if taken[c] < supply[c]), key=lambda c: quotas.get(c, 0) - taken[c])
        taken[c], left = taken[c] + 1, left - 1
    counts = train.groupby("label").size().to_dict()
    assert len(train) == 9 and sorted(quotas.get(c, 0) - counts.get(c, 0) for c in supply) == sorted(quotas.get(c, 0) - n for c, n in taken.items())
    assert all(sorted(g["id"]) == [1000 + 100 * c + i for i in range(len(g))] for c, g in train.groupby("label"))
    assert got[got["split"] == "val"]["id"].tolist() == [4]


def test_split_keeps_groups_and_covers_classes():
    groups = pd.DataFrame({"component": range(30), "size": [5] + [1] * 29, "classes": [[i % 3] for i in range(30)]})
    placed = assign(groups).merge(groups, on="component").explode("classes")
    assert placed.groupby("classes")["new_split"].nunique().eq(3).all()


@pytest.mark.parametrize("seed", range(4))
def test_no_swap_of_groups_improves_the_split(seed):
    draw = random.Random(seed)
    groups = pd.DataFrame({"component": range(40), "size": [draw.choice([1, 1, 2, 3, 5, 9]) for _ in range(40)], "classes": [sorted(draw.sample(range(5), draw.choice([1, 1, 2]))) for _ in range(40)]})
    placed = assign(groups)["new_split"].tolist()
    rows = list(zip(groups["size"], groups["classes"], strict=True))

    def look(where):
        total, out, covered = sum(n for n, _ in rows), 0.0, True
        for c in (None, *range(5)):
            mine = [(n, s) for (n, cs), s in zip(rows, where, strict=True) if c is None or c in cs]
            shares = [abs(sum(n for n, s in mine if s == x) / sum(n for n, _ in mine) - y) for x, y in SHARES.items()]
            out += sum(shares) / (1 if c is None else 5)
            covered &= len(mine) < 3 or len({s for _, s in mine}) == 3
        return out, covered

    base = look(placed)
    assert base[1]
    for i in range(40):
        for j in range(i):
            if placed[i] != placed[j]:
                other = placed.copy()
                other[i], other[j] = placed[j], placed[i]
                value, covered = look(other)
                assert not covered or value >= base[0] - 1e-11


def test_group_classes_count_every_item(spark):
    got = catalogue.QUERIES["group_classes"](spark, DATA).toPandas().sort_values("gid")
    comps = views.comps(spark, DATA).toPandas()
    want = comps.groupby("component").agg(size=("id", "size"), n_classes=("label", "nunique"), first_id=("id", "min")).reset_index()
    want = want.assign(alone=want["size"].eq(1)).sort_values(["alone", "first_id"])
    assert got["size"].sum() == len(comps)
    assert got[["component", "size", "n_classes"]].values.tolist() == want[["component", "size", "n_classes"]].values.tolist()


def test_coverage_is_repaired_and_every_step_is_told():
    groups = pd.DataFrame({"component": range(24), "size": [9, 8, 7] + [1] * 21, "classes": [[0, 1], [0], [1]] + [[2]] * 18 + [[0, 2], [1, 2], [3]]})
    trace = []
    placed = assign(groups, trace=trace)
    assert [t[0] for t in trace[:24]] == ["greedy"] * 24 and sorted(t[1] for t in trace[:24]) == list(range(24))
    both = placed.merge(groups, on="component").explode("classes")
    total, out = groups["size"].sum(), 0.0
    for s, share in SHARES.items():
        out += abs(both.drop_duplicates("component").query("new_split == @s")["size"].sum() / total - share)
    for c in range(4):
        mine = both[both["classes"] == c]
        out += sum(abs(mine[mine["new_split"] == s]["size"].sum() / mine["size"].sum() - share) for s, share in SHARES.items()) / 4
    assert trace[-1][4] == pytest.approx(out)


def test_lists_and_csv(spark, tmp_path):
    keys = spark.createDataFrame([("b",), ("a",)], "key string")
    digest = tables.write_list(keys, str(tmp_path / "l"))
    assert digest == tables.list_digest(keys) and [r.key for r in tables.scan_list(spark, str(tmp_path / "l")).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="twice"):
        tables.write_list(keys.union(keys), str(tmp_path / "m"))
    tables.write_csv(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).distinct().collect())[-1] == "x"


@pytest.mark.parametrize("name", ["leak_census_wilson", "edge_grid_rates", "miou_macc_dual", "strata_report", "sizectrl_removals", "holm"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in views.TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    a, b = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.SQL[name]).df()
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    pd.testing.assert_frame_equal(a.astype(b.dtypes.to_dict()), b, check_dtype=False, atol=1e-6)

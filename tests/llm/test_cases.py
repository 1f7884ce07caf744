"""Nulls, repeats, ties, very long texts, empty tables and clashing columns, through all operators and all stages."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriset.llm import hnsw, license_scan, line_dedup, minhash, mixing, packing, repetition, sharding, token_records, toxicity
from veriset.plans.scratch import Scratch

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

P = pytest.importorskip("public_tokenizers")
#: Names that helpers might use for themselves.
CLASHES = "id _id _row row _text body pos _pos _lines lines n size key node _pid copies _copies whole gone kept taken score x n_lines n_dropped h1 h2 label shard _source".split()
LINE = "a common line of more than twenty signs"
LONG = " ".join("word%d" % (k % 70_000) for k in range(250_000))  # some 2 MB
ROWS = [(1, f"{LINE}\nfirst"), (1, f"{LINE}\nsecond"), (1, f"{LINE}\nsecond"), (2, None), (None, f"{LINE}\nthird"), (None, ""), (3, LONG), (4, " \n\t "), (5, "x y z " * 50), (6, "x y z " * 50)]
IDS = Counter(i for i, _ in ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s%d" % (k % 2), len(t or ""), *["mine"] * len(CLASHES)) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.fixture(scope="module")
def words():
    return P.path("word_bpe_49k.json")


def _quality(docs):
    return repetition.quality(docs)


def _records(docs):
    folder = Scratch(docs.sparkSession, "cases").root
    return token_records.read_records(token_records.write_records(docs, folder, P.path("byte_bpe_50k.json")), folder)


PER_ROW = {
    "license scan": license_scan.scan,
    "shards": sharding.shard_by_bytes,
    "records": _records,
    "near copies": minhash.near_duplicates,
    "toxicity": lambda docs: toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))),
    "mix": lambda docs: mixing.mix(docs, mixing.n_words(F.col("text"))),
    "quality": _quality,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_its_result(docs, name):
    rows = PER_ROW[name](docs).collect()
    assert Counter(r.id for r in rows) == IDS
    assert PER_ROW[name](docs.where("false")).count() == 0


def test_license_scan_of_null_and_long_texts(docs):
    rows = {(r.id, r.n_words): r for r in license_scan.scan(docs).collect()}
    assert rows[2, 0].labels == "" and rows[2, 0].first_word is None and rows[3, 250_000].n_base == 0


def test_shards_hold_rows_alike_in_id_side_by_side(docs):
    rows = sorted(sharding.shard_by_bytes(docs, 3).collect(), key=lambda r: r.start_byte)
    assert [r.id for r in rows] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6]
    assert [r.start_byte for r in rows] == [sum(x.size for x in rows[:k]) for k in range(len(rows))]


def test_records_and_packing_repeat_themselves(docs, words):
    order = lambda rows: sorted(map(str, rows))
    assert order(_records(docs).collect()) == order(_records(docs.repartition(5)).collect())
    packed = packing.pack(docs, words, window=512).collect()
    assert order(packed) == order(packing.pack(docs.repartition(5), words, window=512).collect())
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert Counter(r.id for r in packed if r.start == 0) == IDS
    assert packing.pack(docs.where("false"), words).count() == 0


def test_packing_ids_are_the_librarys(docs, words):
    import zlib

    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(words)
    want = Counter()
    for i, t in ROWS:
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        if len(ids) <= 512:
            want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = Counter((r.id, r.doc_tokens, r.ids_crc32) for r in packing.pack(docs, words, window=1 << 20).collect() if r.doc_tokens <= 512 and r.length == r.doc_tokens)
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= len(ROWS) - 3


def test_near_copies_share_an_id_or_have_none(docs):
    rows = {r.id: r for r in minhash.near_duplicates(docs, shingle=2).collect()}
    assert rows[None].component_id is None and rows[None].kept and rows[2].component_id == 2
    assert (rows[5].component_id, rows[5].kept, rows[6].component_id, rows[6].kept) == (5, True, 5, False)


def test_lines_of_rows_alike_in_id(docs):
    out = line_dedup.marked_lines(docs).select("row.*", F.col("kept").alias("result"), F.col("n_dropped").alias("gone_lines")).collect()
    got = Counter((r.doc_id, r.result) for r in out)
    assert got == Counter([(1, f"{LINE}\nfirst"), (1, f"{LINE}\nsecond"), (1, f"{LINE}\nsecond"), (2, None), (None, "third"), (None, ""), (3, LONG), (4, " \n\t "), (5, ROWS[8][1]), (6, ROWS[9][1])])
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and all(r[c] == "mine" for r in kept.collect() for c in CLASHES)


def test_mix_of_few_words(docs):
    rows = mixing.mix(docs, mixing.n_words(F.col("text"))).collect()
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in rows)
    assert {r.source for r in rows} == {None, "s0", "s1"}


def test_quality_verdicts(docs):
    rows = {(r.id, r.n_words): r for r in _quality(docs).collect()}
    assert rows[2, 0].base_failed and not rows[2, 0].kept and rows[5, 150].n_repeat_words == 150 and not rows[5, 150].kept
    assert rows[3, 250_000].longest_repeat == 180_000 and not rows[3, 250_000].kept  # what follows 70,000 words repeats all that went before


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [], 0), (6, [0.0, 1.0], 0)]
    more = ["shard", "dim", "node", "copies", "links", "id", "h1", "ids"]
    table = spark.createDataFrame([(*r, *["mine"] * len(more)) for r in rows], "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in more))
    got = hnsw.near_vectors(table).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in rows)
    assert {(r.id, r.component_id) for r in got if r.id} >= {(1, 1), (2, 1), (3, 3), (4, 4), (6, 6)} and all(r.kept for r in got if r.id is None)
    assert hnsw.near_vectors(table.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_containment_equals_brute_force(seed):
    """All templates that reach the threshold in any line or paragraph, by plain sets of shingles."""
    rng = np.random.default_rng(seed)
    vocabulary = [b"w%d" % k for k in range(9)]
    templates = [("t%d" % k, list(rng.choice(vocabulary, rng.integers(3, 14)))) for k in range(12)]
    shingles = license_scan.Shingles(templates)
    index = license_scan.TemplateIndex(templates, shingles, {int(k): int(rng.integers(0, 5)) for k in range(len(shingles.codes))}, 0.7)
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    for _ in range(60):
        lines = [list(rng.choice([*vocabulary, b"other"], rng.integers(0, 12))) for _ in range(6)]
        if rng.random() < 0.7:
            lines[2] = templates[rng.integers(12)][1] + lines[2]
        body = b"\n".join(b" ".join(x) for x in lines)
        blocks, run = [grams(x) for x in lines], []
        for x in [*lines, []]:
            if not x:
                blocks.append(grams([w for y in run for w in y]))
                run = []
            else:
                run.append(x)
        want = {}
        for t, (_, w) in enumerate(templates):
            best = max(len(grams(w) & b) / len(grams(w)) for b in blocks)
            if best >= 0.7 - 1e-9:
                want[t] = best
        assert license_scan.contained(body, [w for x in lines for w in x], shingles, index) == pytest.approx(want)


def test_ordinary_prose_has_no_license(spark):
    texts = ["We reserved a table with all our friends and spoke of civil rights.", "All rights reserved.", "The software is provided by the work of a free public.", license_scan.NOTICES[0][1], "Licensed under CC BY-NC 4.0."]
    rows = {r.id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in range(5)] == ["", "", "", "mit", "cc-by-nc"] and rows[0].score == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A corpus with toxic documents, common lines, near copies, repeats, nulls and clashing columns."""
    rng = np.random.default_rng(0)
    words = np.array(["term%d" % k for k in range(3000)])
    rows, labels = [], []
    for i in range(400):
        body = " ".join(rng.choice(words, 60))
        toxic = i % 5 == 0
        rows.append((i, f"{LINE}\n{body} horrid vile" if toxic else f"{LINE}\n{body}" if i % 3 else body, "en", "s%d" % (i % 3)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + k, rows[1 + 5 * k][1] + " changed", "en", None) for k in range(20)]  # near copies
    rows += [(2000, "said twice " + rows[2][1], None, "s1")] * 3 + [(3000, None, None, None), (3001, "", "en", "s0"), (None, "a text without an id", "en", "s0")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    named = [(*r, len(r[1] or ""), "mine", "mine") for r in rows]
    spark.createDataFrame(named, "doc_id long, text string, lang string, source string, n_chars long, `copies` string, `row` string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _plain_dedup(rows, least=20):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(-1 if i is None else i)
    gone = lambda i, k: len(k) >= least and len(held[k]) >= 3 and (-1 if i is None else i) != max(held[k])
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, key(x)))) for i, t in rows)


def test_stages_one_after_the_other(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "stages")
    seen = [r for r in docs.collect()]
    assert list(stages) == ["toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]

    clean = scratch.cut(stages["toxicity"](spark, docs, corpus), "clean")
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in seen if r.text is None or "vile" not in r.text) and clean.columns == docs.columns

    lines = scratch.cut(stages["line dedup"](spark, clean, corpus), "lines")
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == _plain_dedup([(r.doc_id, r.text) for r in clean.collect()])
    assert all(r.n_chars == len(r.text or "") and r.row == "mine" for r in lines.collect()) and lines.columns == docs.columns

    unlike = scratch.cut(stages["MinHash near-dedup"](spark, lines, corpus), "unlike")
    sets = {}
    for r in lines.collect():
        w = (r.text or "").lower().split()
        sets.setdefault(r.doc_id, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    for _ in range(3):
        for a in ids:
            for b in ids:
                if a != b and near(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    assert Counter(r.doc_id for r in unlike.collect()) == Counter(r.doc_id for r in lines.collect() if r.doc_id is None or root[r.doc_id] == r.doc_id) and unlike.columns == docs.columns

    mixed = scratch.cut(stages["mixing sources to target weights"](spark, unlike, corpus), "mixed")
    took = mixing.mix(unlike, mixing.n_words(F.col("text"))).groupBy("id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.id: r.n for r in took}) and mixed.columns == docs.columns

    packed = stages["packing"](spark, mixed, corpus).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in mixed.collect())
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_stages_take_repeats_and_empty_tables(spark, docs, corpus):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        kept = Counter(r.doc_id for r in out.collect())
        assert set(kept) <= set(IDS), name
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.where("false"), corpus).count() == 0, name


def test_mix_takes_each_of_rows_alike(spark, docs):
    """Rows alike in everything share out their copies: none is multiplied by the others' number."""
    same = docs.where("doc_id = 1").limit(1)
    many = same
    for _ in range(5):
        many = many.unionByName(same)
    out = corpus_pipeline.mix_sources(spark, many, "").count()
    assert out == mixing.mix(many, mixing.n_words(F.col("text"))).agg(F.sum("copies")).first()[0]

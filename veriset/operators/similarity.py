"""Exact similarity joins: blocks of vectors against blocks, banded Hamming, token-set Jaccard, passages in texts.

The all-pairs join is one pass whatever the number of thresholds asked of it
later: census, grid and ablations are filters of its result.  Vectors are dealt
by hash into blocks.  Tasks form a grid of about the root of their number a side;
each takes a stripe of blocks from either side, so a block is sent that root of
times, not to every other block, and a task holds one block and what streams past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriset.operators.shipping import prepare
from veriset.plans.scratch import Scratch

#: Vectors of a block, and blocks that a task holds at most.
BLOCK, STRIPE = 1024, 16
PAIRS = "a long, b long, cosine double, hamming int"


def _pack(part: pa.Table) -> pa.Table:
    x = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ids = part["id"].to_numpy().astype(np.int64, copy=False)
    return pa.table({"block": part["block"].slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})


def _signs(x: np.ndarray) -> np.ndarray:
    """The first 64 sign bits as one number."""
    bits = np.zeros((len(x), 64), np.uint8)
    bits[:, : min(64, x.shape[1])] = x[:, :64] >= 0
    return np.packbits(bits, axis=1).view(np.uint64)[:, 0]


def _multiply(batches: Iterator[pa.RecordBatch], least: float, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task: its left blocks first, then the right ones, each of which meets every left block (of its own stripe those not after it)."""
    left: list[tuple] = []
    at = None
    for batch in batches:
        for r in batch.to_pylist():
            if (r["row"], r["col"]) != at:
                at, left = (r["row"], r["col"]), []
            ids = np.frombuffer(r["ids"], np.int64)
            x = np.frombuffer(r["x"]).reshape(len(ids), -1)
            side = (r["block"], ids, x, _signs(x))
            if r["side"] == 0:
                left.append(side)
                continue
            for number, p, own, signs in left:
                if r["row"] == r["col"] and number > side[0]:
                    continue
                cos = own @ x.T
                near = cos >= least
                ham = np.bitwise_count(signs[:, None] ^ side[3][None, :]) if most >= 0 else None
                if ham is not None:
                    near |= ham <= most
                i, j = np.nonzero(near & ((p[:, None] < ids[None, :]) if number == side[0] else (p[:, None] != ids[None, :])))
                if len(i):
                    bits = (ham[i, j] if ham is not None else np.bitwise_count(signs[i] ^ side[3][j])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p[i], ids[j])), pa.array(np.maximum(p[i], ids[j])), pa.array(cos[i, j]), pa.array(bits)], names=["a", "b", "cosine", "hamming"])


def similar_pairs(items: DataFrame, cos_least: float, ham_most: int = -1, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, grid: int | None = None) -> DataFrame:
    """All pairs ``a < b`` with ``cosine >= cos_least`` or sign ``hamming <= ham_most``: ``a, b, cosine, hamming``.

    Vectors are taken as they are (unit length makes the product a cosine) and must be of
    one length; null ids and vectors pair with nothing.  With g stripes a side there are
    about g * g / 2 tasks, each holding a g-th of the vectors at most in its left stripe;
    g grows until a stripe is ``STRIPE`` blocks.
    """
    spark = items.sparkSession
    prepare(spark)
    blocks = max(1, -(-items.count() // block))
    cores = spark.sparkContext.defaultParallelism
    g = grid or max(1, min(blocks, max(int((2 * cores) ** 0.5) + 1, -(-blocks // STRIPE))))
    dealt = items.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block")).where("id is not null and v is not null")
    blobs = dealt.groupBy("block").applyInArrow(lambda part: _pack(part), "block long, ids binary, x binary")
    # Stripes are block numbers modulo g; a task (row, col) has row <= col, and both orders of two blocks meet in it.
    stripe = F.pmod("block", F.lit(g))
    others = F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))
    sent = blobs.select("block", "ids", "x", stripe.alias("own"), F.explode(others).alias("other"))
    row, col = F.least("own", "other"), F.greatest("own", "other")
    # A block of the row's stripe is held, one of the column's streams past; on the diagonal it is both.
    sides = F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).when(F.col("own") < F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    tasks = sent.select(row.alias("row"), col.alias("col"), F.explode(sides).alias("side"), "block", "ids", "x")
    dealt_out = tasks.repartition(min(100_000, g * (g + 1) // 2), "row", "col").sortWithinPartitions("row", "col", "side", "block")
    return dealt_out.mapInArrow(lambda batches: _multiply(batches, cos_least, ham_most), PAIRS)


def banded_hamming(items: DataFrame, most: int, id_col: str = "id", hash_col: str = "h", bits: int = 64, bands: int | None = None) -> DataFrame:
    """Pairs within ``most`` bits by the pigeonhole rule: of ``bands`` bands at least ``bands - most`` are equal.

    Every choice of ``bands - most`` bands is a key, so more bands than ``most + 1`` make
    longer keys and fewer chance meetings; ``bands`` is chosen such that keys have 16 bits
    or more if up to 256 keys can do it.  Equal hashes are one class first, so a value
    that a third of all items share is met once; classes are expanded at the end only,
    into the pairs asked for.

    All joins merge sorted partitions.  The planner takes a table of keys for as small as
    that of its values, dozens of times fewer rows, and would have the driver broadcast
    it; for the same reason values are dealt out anew before they grow into keys.
    """
    from itertools import combinations
    from math import comb

    if bands is None:
        able = [b for b in range(most + 1, bits + 1) if comb(b, most) <= 256]
        bands = next((b for b in able if (b - most) * (bits // b) >= 16), able[-1])
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    part = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1 if edges[k + 1] - edges[k] < 63 else -1))
    rows = items.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).where("id is not null and h is not null")
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select("h").distinct().repartition(tasks, F.xxhash64("h"))  # a number given is kept to, where the exchange of distinct would end in a few tasks
    keys = F.array(*(F.xxhash64(F.lit(n), *(part(F.col("h"), k) for k in chosen)) for n, chosen in enumerate(combinations(range(bands), bands - most))))
    keyed = values.select("h", F.explode(keys).alias("key"))
    distance = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    # Both sides of a join are the same plan, by aliases, so that one exchange serves them.
    met = keyed.alias("x").hint("merge").join(keyed.alias("y"), F.col("x.key") == F.col("y.key"))
    near = met.where((F.col("x.h") < F.col("y.h")) & (distance("x.h", "y.h") <= most)).select(F.col("x.h").alias("p"), F.col("y.h").alias("q")).distinct()
    x, y = rows.alias("x"), rows.alias("y")
    across = near.hint("merge").join(x, F.col("p") == F.col("x.h")).hint("merge").join(y, F.col("q") == F.col("y.h")).where("x.id <> y.id")
    same = x.hint("merge").join(y, F.col("x.h") == F.col("y.h")).where("x.id < y.id")
    ends = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    return across.select(*ends, distance("p", "q").alias("hamming")).unionByName(same.select(*ends, F.lit(0).alias("hamming")))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard_classes(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: each document's class of equal token sets, and pairs of classes with Jaccard >= ``least``.

    Tokens are 64-bit hashes from the start, ordered by how many classes hold them.  The
    rarest ones of each set make its prefix; sets that share a token there, are of fitting
    size and can still reach the overlap behind it are confirmed on the whole sets, which
    only classes in such a pair send.
    """
    hashed = docs.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.transform(_tokens(F.col(text_col)), lambda w: F.xxhash64(w)))).alias("w"))
    scratch = Scratch(docs.sparkSession, "jaccard")
    keyed = scratch.cut(hashed.where(F.size("w") > 0).select("id", F.size("w").alias("n"), F.xxhash64(F.lit(1), "w").alias("h1"), F.xxhash64(F.lit(2), "w").alias("h2"), "w"), "sets")  # texts are cut into words once
    first = keyed.groupBy("n", "h1", "h2").agg(F.min("id").alias("class_id"))
    members = scratch.cut(keyed.select("id", "n", "h1", "h2").join(first, ["n", "h1", "h2"]).select("id", "class_id"), "members")
    sets = keyed.join(members.where("id = class_id").select("id"), "id", "left_semi").select(F.col("id").alias("c"), "n", "w")
    tokens = sets.select("c", "n", F.explode("w").alias("t"))
    ranked = tokens.join(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "t")
    # Only the rarest tokens of a set are collected: as many as its prefix has.
    short = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    ordered = ranked.groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    prefix = ordered.select("c", "n", F.posexplode(F.slice("o", F.lit(1), short)).alias("place", "x")).select("c", "n", "place", F.col("x.t").alias("t"))
    other = prefix.toDF("c2", "n2", "place2", "t")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("n2")) - 1e-9)
    reach = 1 + F.least(F.col("n") - F.col("place") - 1, F.col("n2") - F.col("place2") - 1)  # from the first shared token on
    met = prefix.join(other, "t").where((F.col("c") < F.col("c2")) & (F.least("n", "n2") >= least * F.greatest("n", "n2") - 1e-9))
    met = met.groupBy("c", "c2", "n", "n2").agg(F.max(reach).alias("reach")).where(F.col("reach") >= need).select("c", "c2")
    full = met.join(sets.select("c", "w"), "c").join(sets.toDF("c2", "n2", "w2").select("c2", "w2"), "c2")
    both = F.size(F.array_intersect("w", "w2"))
    links = full.select("c", "c2", (both / (F.size("w") + F.size("w2") - both)).alias("jaccard")).where(F.col("jaccard") >= least)
    return members, links


def jaccard_pairs(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs of documents with Jaccard >= ``least``: the classes' links expanded.  For large groups of copies use ``jaccard_classes``."""
    members, links = jaccard_classes(docs, least, id_col, text_col)
    one, two = members.toDF("a", "c"), members.toDF("b", "c2")
    across = links.join(one, "c").join(two, "c2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    same = one.join(two, F.col("c") == F.col("c2")).where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    return across.unionByName(same)


def contained_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str = "item_id", passage_col: str = "text", gram: int = 6) -> DataFrame:
    """``item_id, doc_id`` of the passages that stand in a text, sign by sign.

    A passage's words but the first and the last, which a text may go on with, stand in
    every text that holds it.  Of the runs of ``gram`` such words the one whose hash is
    least is the passage's key; runs of a text that are a key propose the passage, and the
    text is then searched.  Passages too short for a key are searched for in every text.
    """
    items = passages.select(F.col(key_col).alias("item"), F.col(passage_col).alias("passage")).where("passage is not null")
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")).where("body is not null")

    from pyspark.ml.feature import NGram

    runs = NGram(n=gram, inputCol="words", outputCol="grams").transform
    words = F.split("passage", r"\s+")
    inner = items.select("item", "passage", F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2)).alias("words"))
    keyed = runs(inner).select("item", "passage", F.array_min(F.transform("grams", lambda g: F.xxhash64(g))).alias("key"))
    long_, short = keyed.where("key is not null"), keyed.where("key is null").select("item", "passage")
    told = runs(texts.select("doc", F.split("body", r"\s+").alias("words"))).select("doc", F.explode("grams").alias("g")).select("doc", F.xxhash64("g").alias("key"))
    candidates = told.join(long_.select("key", "item"), "key").select("doc", "item").distinct()
    met = candidates.join(texts, "doc").join(long_.select("item", "passage"), "item").where(F.col("body").contains(F.col("passage"))).select("item", "doc")
    few = texts.join(short, F.col("body").contains(F.col("passage"))).select("item", "doc")
    return met.unionByName(few).distinct().toDF(key_col, id_col)

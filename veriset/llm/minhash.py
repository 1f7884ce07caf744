"""MinHash near-dedup with tensored banding, confirmed on full shingle sets.

Signatures.  A text's words are hashed where they lie in the Arrow buffer, its
shingles are runs of ``shingle`` words.  Two collections of ``halves`` half-keys
are made, each half-key from ``per_half`` minhashes; every pair of one half-key
from either collection is the key of a table.  So ``halves`` squared tables cost
only ``2 * halves * per_half`` minhashes, the square root of what they would cost
one by one.  Two sets of similarity s share a table with probability
``(1 - (1 - s**per_half)**halves)**2``: 0.99993 at s = 0.8 with the defaults.

Candidates.  Texts with equal sets are one class first, so copies never meet in a
table.  The first member of each table key that several classes share is found by an
aggregation (combined before its shuffle), and the rows of such keys are joined with
it, a join that adaptive execution may split: no key, however common, is brought into
one task.  Each member of a group is paired with the group's first member only (in one
order for all tables, so that a large group yields few different pairs).  Each text
also has two sketches of its shingles, dealt over cells by hash: the parities of their
counts in ``64 * ODD`` cells, and the counts themselves in about half as many cells as
there are shingles.  The cells whose parities differ are at most the shingles in which
two sets differ; the sum of the smaller counts is at least the shingles that they
share.  Joins drop the pairs that the first bound rules out, and a sift those that the
second does: exact bounds both, so no pair that reaches the similarity is ever dropped.
What is left is confirmed on the full sets.

Nothing is lost by that economy: groups that are not yet one component are taken
up again.  First their rows meet the group's ``LEADS`` most central members (those
that share most rows of open groups), which joins most copies to their original.
Then, where a group has at most ``FEW`` pairs across components for each of its
rows, all of them are compared; a larger one compares some members more with all
the others, a number of pairs linear in its rows, until few are left; ``FEW`` grows
fourfold with each turn, so the turns are few too.

Defined results: a text without words has an empty set and links with nothing;
one of fewer than ``shingle`` words is one shingle; equal sets link; rows that share
an id are one document (linked if any of them links); a null id links with nothing,
its component is null and it is kept; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriset.llm.common import chunks, prepare, raw, table, texts
from veriset.llm.tokens import release
from veriset.operators.components import connected_components
from veriset.plans.scratch import Scratch

HALVES, PER_HALF, PERCENT = 10, 2, 80
#: Pairs across components per row of a group up to which all of them are compared at once.
FEW = 64
#: Words of 64 bits in an odd sketch, least cells of a count sketch, and central members that each open group's rows meet first.
ODD, CELLS, LEADS = 16, 128, 4
#: Nodes whose ids may be broadcast (8 bytes each); beyond that the join is shuffled.
BROADCAST_NODES = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with full diffusion."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Words:
    """Hashes of the words of many texts, from powers of one odd number modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(2 * len(self.up), n + 1)
            step, back = np.full(size, _P), np.full(size, np.uint64(_inverse(int(_P))))
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes, and where each text's words begin among them (with the end of the last)."""
        low = data.copy()
        upper = (low >= 65) & (low <= 90)
        low[upper] += 32
        solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
        n = len(low)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # a text's end also ends its last word
        starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:-1]))
        ends = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        word = (total[ends] - total[starts]) * self.down[starts]
        return mix(word + (ends - starts).astype(np.uint64) * _M2), np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other; and how many each has."""
    sizes = np.diff(bounds)
    runs = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out_at = np.r_[0, np.cumsum(runs)]
    # The first word of every shingle.
    first = np.arange(out_at[-1]) - np.repeat(out_at[:-1], runs) + np.repeat(bounds[:-1], runs)
    length = np.repeat(np.minimum(sizes, k), runs)
    h = mix(words[first] + length.astype(np.uint64) * _P)
    for j in range(1, k):
        more = length > j
        h[more] = mix(h[more] * _P + words[first[more] + j])
    keep = np.ones(len(h), bool)
    for i, (a, b) in enumerate(zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True)):
        if b - a > 1:
            h[a:b].sort()
    keep[1:] = h[1:] != h[:-1]
    keep[out_at[:-1][runs > 0]] = True
    counts = np.r_[0, np.cumsum(keep)]
    return h[keep], counts[out_at[1:]] - counts[out_at[:-1]]


def minhashes(items: np.ndarray, counts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` minhashes of 32 bits for each text that has shingles."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    full = counts[counts > 0]
    at = np.r_[0, np.cumsum(full)][:-1]
    out = np.empty((len(full), n), np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((items * a[i] + b[i]) >> np.uint64(32), at)
    return out


def odd_sketches(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the parities of its shingles' counts in ``64 * ODD`` cells, as 64-bit words."""
    cells = 64 * ODD
    cell = (items % np.uint64(cells)).astype(np.int64)
    cell += np.repeat(np.arange(len(counts)) * cells, counts)
    parity = np.bincount(cell, minlength=len(counts) * cells) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(len(counts), ODD)


def may_link(n: Column, odd: Column, n2: Column, odd2: Column, percent: int) -> Column:
    """False only for sets that cannot reach the similarity, by their sizes or by their odd sketches."""
    differ = reduce(Column.__add__, [F.bit_count(odd[i].bitwiseXOR(odd2[i])) for i in range(ODD)])
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & ((100 + percent) * differ <= (100 - percent) * (n + n2))


def count_sketches(items: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """For each text how many of its shingles lie in each cell, a byte each; None if a cell holds more than a byte can tell."""
    out: list[bytes | None] = []
    at = 0
    for n in counts.tolist():
        cells = max(CELLS, 1 << max(n - 1, 1).bit_length() - 1)
        held = np.bincount((items[at : at + n] >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells)
        out.append(held.astype(np.uint8).tobytes() if held.max() < 256 else None)
        at += n
    return out


def shared_at_most(x: bytes, y: bytes) -> int:
    """The shingles that two texts share at most, by their count sketches; the larger one is folded to the smaller."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) != len(q):
        p, q = (p, q) if len(p) < len(q) else (q, p)
        q = q.reshape(-1, len(p)).sum(0, dtype=np.int64)
    return int(np.minimum(p, q).sum(dtype=np.int64))


SIGNED = "id long, n long, d1 long, d2 long, sig binary, odd array<long>, cells binary"


def _sign(batches: Iterator[pa.RecordBatch], k: int, n: int, seed: int) -> Iterator[pa.RecordBatch]:
    release()
    hashed = Words()
    for batch in chunks(batches):
        items, counts = shingle_sets(*hashed(*raw(batch.column(1))), k)
        full = np.flatnonzero(counts)
        d1, d2 = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
        sig: list[bytes | None] = [None] * len(batch)
        if len(full):
            at = np.r_[0, np.cumsum(counts[full])][:-1]
            d1[full], d2[full] = np.add.reduceat(mix(items + _P), at), np.add.reduceat(mix(items ^ _M1), at)
            for i, s in zip(full.tolist(), minhashes(items, counts, n, seed), strict=True):
                sig[i] = s.tobytes()
        odd = pa.ListArray.from_arrays(np.arange(0, ODD * len(batch) + 1, ODD, dtype=np.int32), odd_sketches(items, counts).reshape(-1))
        columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig, pa.binary()), odd, pa.array(count_sketches(items, counts), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d1", "d2", "sig", "odd", "cells"])


def table_keys(sig: np.ndarray, halves: int, per_half: int) -> np.ndarray:
    """The keys of all tables: every pair of a half-key of the first and one of the second collection."""
    half = np.zeros((len(sig), 2 * halves), np.uint64)
    for j in range(per_half):
        half = mix(half * _P + sig[:, j::per_half].astype(np.uint64) + np.uint64(j + 1))
    first, second = half[:, :halves], half[:, halves:]
    number = np.arange(halves * halves, dtype=np.uint64).reshape(halves, halves)
    return mix((first[:, :, None] * _P + second[:, None, :]) ^ mix(number + _M1)).reshape(len(sig), -1)


def _emit(batches: Iterator[pa.RecordBatch], halves: int, per_half: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(len(part), -1)
            keys = table_keys(sig, halves, per_half)
            nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], names=["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    release()
    hashed = Words()
    for batch in chunks(batches):
        items, counts = shingle_sets(*hashed(*raw(batch.column(1))), k)
        at = np.r_[0, np.cumsum(counts)].tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([items[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "items"])


def _sift(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """``a, b, n_a, n_b`` and both count sketches -> the pairs that may still reach the similarity."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            most = min(n, m) if x is None or y is None else shared_at_most(x, y)
            keep.append((100 + percent) * most >= percent * (n + m))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Confirmer:
    """Confirms candidate pairs; a text's set is computed once, when a pair first needs it."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int, scratch: Scratch) -> None:
        self.docs, self.nodes, self.k, self.percent, self.scratch = docs, nodes, k, percent, scratch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that reach the similarity."""
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"o_{c}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(F.col("n_a"), F.col("o_a"), F.col("n_b"), F.col("o_b"), self.percent)).select("a", "b", "n_a", "n_b")
        near = self.scratch.cut(near, "near")
        told = lambda c: self.nodes.select(F.col("node").alias(c), F.col("cells").alias(f"c_{c}"))
        k, percent = self.k, self.percent
        met = near.join(told("a"), "a").join(told("b"), "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")
        sifted = self.scratch.cut(met.mapInArrow(lambda batches: _sift(batches, percent), "a long, b long"), "sifted")
        wanted = self.scratch.cut(sifted.select(F.col("a").alias("id")).union(sifted.select("b")).distinct(), "wanted")
        if wanted.count() <= BROADCAST_NODES:
            wanted = F.broadcast(wanted)
        sets = self.scratch.cut(self.docs.join(wanted, "id", "left_semi").select("id", "body").mapInArrow(lambda batches: _sets(batches, k), "node long, items binary"), "sets")
        items = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"i_{c}"))
        met = sifted.join(items("a"), "a").join(items("b"), "b").select("a", "b", "i_a", "i_b")
        out = self.scratch.cut(met.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long").distinct(), "links")
        self.scratch.drop(sets)
        return out


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, halves: int = HALVES, per_half: int = PER_HALF, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """A row per row of ``docs``: ``id, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "minhash")
    bodies = texts(docs, id_col, text_col)
    n_hashes = 2 * halves * per_half
    signed = scratch.cut(bodies.mapInArrow(lambda batches: _sign(batches, shingle, n_hashes, seed), SIGNED), "signed")
    usable = signed.where("n > 0 and id is not null")
    classes = scratch.cut(usable.groupBy("n", "d1", "d2").agg(F.min("id").alias("node"), F.max("id").alias("other"), F.min("sig").alias("sig"), F.min("odd").alias("odd"), F.min("cells").alias("cells")), "classes")
    nodes = classes.select("node", "n", "odd", "cells")

    rows = classes.select("node", "sig").mapInArrow(lambda batches: _emit(batches, halves, per_half), "key long, node long")
    heads = scratch.cut(rows.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "head"), "heads")
    met = scratch.cut(rows.join(heads, "key").select("key", "node", "head"), "groups")
    confirm = _Confirmer(bodies, nodes, shingle, percent, scratch)
    tried = scratch.cut(_ordered(met, "head", "node"), "tried")
    links = confirm(tried)
    live = met.select("key", "node").distinct()
    owner = connected_components(links, scratch, "a", "b")
    sketch = nodes.select("node", "n", "odd")
    mate = lambda rows: rows.select("key", F.col("node").alias("mate"), F.col("c").alias("mc"), F.col("n").alias("mn"), F.col("odd").alias("modd"))
    across_parts = (F.col("c") != F.col("mc")) & may_link(F.col("n"), F.col("odd"), F.col("mn"), F.col("modd"), percent)
    for turn in range(100):
        few_pairs = FEW * 4 ** max(turn - 1, 0)
        placed = live.join(owner, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        parts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
        across = parts.groupBy("key").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"), F.max(F.struct("m", "c"))["c"].alias("big"), F.count(F.lit(1)).alias("parts"))
        across = across.where("parts > 1").select("key", "s", "big", ((F.col("s") * F.col("s") - F.col("q")) / 2 > few_pairs * F.col("s")).alias("many"), F.ceil(F.col("s") / few_pairs).alias("each"))
        open_rows = scratch.cut(placed.join(across, "key").join(sketch, "node"), "open")
        if not open_rows.take(1):
            break
        more_turns = True
        if turn == 0:
            central = open_rows.groupBy("node").agg(F.sum("s").alias("met"))
            order = Window.partitionBy("key").orderBy(F.desc("met"), "node")
            leads = open_rows.join(central, "node").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= LEADS)
            pairs = open_rows.join(mate(leads), "key").where(across_parts).select("node", "mate")
            live = open_rows.select("key", "node")
        else:
            few, many = open_rows.where("not many"), open_rows.where("many")
            # A pair across components has a member outside the largest one.
            pairs = few.join(mate(few.where("c <> big")), "key").where(across_parts).select("node", "mate")
            if more_turns := bool(many.take(1)):
                # Of each large group some members, not of its largest component, meet all members of other components.
                drawn = many.where("c <> big").withColumn("draw", F.xxhash64(F.lit(turn), "node"))
                one = drawn.groupBy("key").agg(F.min(F.struct("draw", "node", "c", "n", "odd")).alias("p")).select("key", "p.node", "p.c", "p.n", "p.odd")
                some = drawn.where(F.pmod("draw", "each") == 0).select("key", "node", "c", "n", "odd")
                pivots = scratch.cut(one.unionByName(some).distinct(), "pivots")
                pairs = pairs.unionByName(many.join(mate(pivots), "key").where(across_parts).select("node", "mate"))
                live = scratch.cut(many.join(pivots, ["key", "node"], "left_anti").select("key", "node"), "live")
        fresh = scratch.cut(_ordered(pairs, "node", "mate").join(tried, ["a", "b"], "left_anti"), "fresh")
        more = confirm(fresh)
        links, tried = links.unionByName(more), tried.unionByName(fresh)
        if more.take(1):
            owner = connected_components(links, scratch, "a", "b")
        if not more_turns:
            break
    # Classes of one document without a link are their own component: only the others are joined back.
    keyed = classes.join(owner, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"), F.col("other") != F.col("node"), F.col("component").isNotNull()).toDF("n", "d1", "d2", "component", "many", "linked")
    told = keyed.where("many or linked").select("n", "d1", "d2", "component")
    out = signed.select("id", "n", "d1", "d2").join(told, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN sets s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""

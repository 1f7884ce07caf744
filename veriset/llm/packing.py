"""Order-preserving packing of tokenised documents into windows of bounded length.

The documents of a range of ids form one stream of tokens.  Windows are cut at
document ends (free), sentence ends (a small truncation penalty) or, where a
sentence is longer than ``HARD_STEP`` ids, within it (a large one).  Dynamic
programming finds the cuts with the least padding plus penalties: the best start
of a window that ends at a cut is the least ``cost + position`` over the last
``window`` ids, which a monotone queue gives in constant time.  The one short window
at the end of a stream is cut into powers of two, which need no padding, where that
costs less.

The cuts are the cheapest ones of the whole stream, though it is read once: the
cheapest paths to all possible cuts within the last window are followed back to
where they meet, and the windows before that point are final, since every later
window begins at one of those cuts.  Ids are held only from there on: in practice
some windows of them (a stream whose paths never met would be held whole).

Ranges are sorted tasks; a very long document costs a task its text, its ids and
some bytes for each sentence.

Defined results: a null or empty text is its end id alone; a document longer than
a window is cut and continues in the next; rows that share an id are documents
side by side, in an order given by their texts; a null id comes first; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriset.llm.common import chunks, prepare, table, texts
from veriset.llm.tokens import encoder
from veriset.plans.scratch import Scratch

WINDOW, SENTENCE_COST, HARD_COST, HARD_STEP = 4096, 4, 32, 64
#: Ids after which the paths are followed back; this changes no cut.
BLOCK = 1 << 18
PIECE = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64())])


def powers(n: int, window: int = WINDOW) -> list[int]:
    """Window lengths for the ``n`` ids at a stream's end: one padded window, or powers of two if cheaper."""
    parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return parts if (len(parts) - 1) * HARD_COST < window - n else [n]


def tail_cost(n: int, window: int = WINDOW) -> int:
    """What ``powers`` costs."""
    return min(window - n, (n.bit_count() - 1) * HARD_COST)


class Cuts:
    """The cheapest window ends of a stream of possible cuts, of which consecutive ones are at most ``window`` apart."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.pos, self.back, self.least = [0], [0], [0.0]  # of every possible cut since the last final one
        self.queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost + position, position, index; costs ascend

    def add(self, at: list[int], cost: list[float]) -> None:
        """Possible cuts in ascending order and what it costs to cut there."""
        queue, window, j = self.queue, self.window, len(self.pos)
        back, least = [0] * len(at), [0.0] * len(at)
        key, begin, i = queue[0]
        for k, p in enumerate(at):
            while begin < p - window:
                queue.popleft()
                key, begin, i = queue[0]
            back[k] = i
            least[k] = value = key - p + window + cost[k]
            value += p
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, p, j + k))
            if value <= key:  # it stands alone
                key, begin, i = queue[0]
        self.pos += at
        self.back += back
        self.least += least

    def _chain(self, j: int) -> list[int]:
        out = []
        while j:
            out.append(j)
            j = self.back[j]
        return out[::-1]

    def final(self) -> list[int]:
        """The ends that all cheapest paths share so far; they are forgotten."""
        first = len(self.pos) - 1
        while first and self.pos[first - 1] >= self.pos[-1] - self.window:
            first -= 1
        nodes = sorted({self.back[j] for j in range(first, len(self.pos))})
        while len(nodes) > 1:  # the latest one goes back until all are one
            j = self.back[nodes.pop()]
            at = bisect_left(nodes, j)
            if at == len(nodes) or nodes[at] != j:
                nodes.insert(at, j)
        meet = nodes[0]
        ends = [self.pos[j] for j in self._chain(meet)]
        if meet:
            self.pos, self.least = self.pos[meet:], self.least[meet:]
            self.back = [0, *(j - meet for j in self.back[meet + 1 :])] if len(self.pos) > 1 else [0]
            self.back = [max(j, 0) for j in self.back]  # of cuts that no path uses any more
            self.queue = deque((key, p, j - meet) for key, p, j in self.queue)
        return ends

    def close(self) -> list[int]:
        """The remaining ends, the last being that of the stream; its last window may be cut into powers of two."""
        end = self.pos[-1]
        able = [j for j in range(len(self.pos) - 1) if self.pos[j] >= end - self.window]
        if not able:
            return []
        start = min(able, key=lambda j: (self.least[j] + tail_cost(end - self.pos[j], self.window), j))
        ends = [self.pos[j] for j in self._chain(start)]
        at = self.pos[start]
        self.cost = self.least[start] + tail_cost(end - at, self.window)  # of the whole stream
        for n in powers(end - at, self.window):
            at += n
            ends.append(at)
        return ends


class Packer:
    """Documents in, pieces out: ``(id, start, length, crc32, doc_tokens, seq, offset)``."""

    def __init__(self, sentence_end: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> None:
        self.sentence_end, self.block, self.cuts = sentence_end, block, Cuts(window)
        self.docs: deque[list] = deque()  # id, ids as bytes, ids already placed
        self.at: list[np.ndarray] = []  # possible cuts not yet looked at
        self.cost: list[np.ndarray] = []
        self.placed = self.read = self.followed = self.seq = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        self.docs.append([doc, ids, 0])
        values = np.frombuffer(ids, "<u4")
        at, cost = possible_cuts(values, self.sentence_end)
        self.at.append(at + self.read)
        self.cost.append(cost)
        self.read += len(values)
        if self.read - self.followed >= self.block:
            self._look()
            yield from self._place_all(self.cuts.final())

    def _look(self) -> None:
        if self.at:
            self.cuts.add(np.concatenate(self.at).tolist(), np.concatenate(self.cost).tolist())
            self.at, self.cost, self.followed = [], [], self.read

    def end(self) -> Iterator[tuple]:
        self._look()
        yield from self._place_all(self.cuts.close())

    def _place_all(self, ends: list[int]) -> Iterator[tuple]:
        for e in ends:
            yield from self._place(e - self.placed)
            self.placed = e

    def _place(self, n: int) -> Iterator[tuple]:
        offset = 0
        while offset < n:
            doc, ids, done = entry = self.docs[0]
            total = len(ids) // 4
            take = min(total - done, n - offset)
            yield doc, done, take, zlib.crc32(memoryview(ids)[4 * done : 4 * (done + take)]), total, self.seq, offset
            offset += take
            entry[2] = done + take
            if entry[2] == total:
                self.docs.popleft()
        self.seq += 1


def possible_cuts(ids: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which a document may be cut, ascending, and the penalty of each; its end is free."""
    inner = np.flatnonzero(sentence_end[ids[:-1]]) + 1
    stops = np.concatenate(([0], inner, [len(ids)]))
    pen = np.full(len(inner) + 1, float(SENTENCE_COST))
    pen[-1] = 0
    gaps = np.flatnonzero(np.diff(stops) > HARD_STEP)
    if not len(gaps):
        return stops[1:], pen
    extra = np.concatenate([np.arange(stops[g] + HARD_STEP, stops[g + 1], HARD_STEP) for g in gaps])
    where = np.concatenate((stops[1:], extra))
    order = np.argsort(where, kind="stable")
    return where[order], np.concatenate((pen, np.full(len(extra), float(HARD_COST))))[order]


def _kernel(tokenizer: str, kind: str, end_id: int, window: int) -> Callable:
    return lambda batches: _pack(batches, tokenizer, kind, end_id, window)


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, kind: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    tool, end = encoder(tokenizer, kind), np.array([end_id], "<u4").tobytes()
    packer, rows = Packer(tool.sentence_ends, window), []
    for batch in chunks(batches):
        for doc, ids in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1).to_pylist()), strict=True):
            rows.extend(packer.add(doc, ids + end))
        if len(rows) > 10_000:
            yield _batch(rows, part)
            rows = []
    rows.extend(packer.end())
    if rows:
        yield _batch(rows, part)


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    doc, start, length, crc, total, seq, offset = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip((doc, start, length, crc, total, [part] * len(rows), seq, offset), PIECE, strict=True)], schema=PIECE)


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; sequence ids have no gaps."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")
    ranged = texts(docs, id_col, text_col).repartitionByRange("id", F.xxhash64("body")).sortWithinPartitions("id", F.xxhash64("body"), "body")
    pieces = scratch.cut(ranged.mapInArrow(_kernel(tokenizer, kind, end_id, window), "id long, start long, length long, ids_crc32 long, doc_tokens long, part int, seq long, offset long"), "pieces")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    bases = pieces.groupBy("part").agg((F.max("seq") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(bases, "part").select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("seq")).cast("long").alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")

"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of 128-bit line hashes, each with the documents that hold the line
and the largest id among them.  It is bucketed by hash and sorted within its buckets,
so whatever meets a run is merge-joined with it: the run is neither shuffled nor
sorted again, and a batch that was grouped by hash lies in the same buckets.

A batch of documents is grouped by line hash and merge-anti-joined with all runs: its
fresh lines, and only those, become a run of their own, so no hash ever stands in two
runs.  Lines that a run knows are a tally: documents to be added to the entry that
they met.  A level that has ``fanout`` runs is compacted into one run of the next
level by a full merge, and so are the tallies.  At the end every run folds in the
tallies, and the entries that enough documents hold name the lines to drop.  No other
grouping of all lines takes place: the outcome rests on the anti-joins.

Skew: counts and largest ids are combined before any shuffle; the join of line
places with dropped hashes is followed by an exchange, so adaptive skew handling
may split a line that most documents hold.

Defined results: a null or empty text is one empty line; each row is a document,
also where rows share an id (all rows of the largest id keep the line); a null id
is smaller than any other; an empty table gives no rows; other columns are passed
through, whatever their names, but ``n_lines`` and ``n_dropped`` of ``marked_lines``
stand beside the row, not among its columns.  A very long text costs its lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm.common import BLANKS, ascii_lower, table
from veriset.plans.scratch import Scratch

HASH = ["h1", "h2"]
#: Lets a scan of a sorted bucket keep its order, so that a merge join need not sort it.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _held(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, h1, h2``: the distinct long lines of each document, found within its row."""
    keys = F.filter(F.transform(F.filter(_lines(F.col("text")), lambda x: F.length(x) >= min_chars), _key), lambda k: F.length(k) >= min_chars)
    return docs.select("id", F.explode(F.array_distinct(keys)).alias("key")).select("id", _hash(F.col("key")).alias("h")).select("id", "h.h1", "h.h2")


def _places(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, row, pos, h1, h2`` of every long line."""
    lines = docs.select("id", "row", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.select("id", "row", "pos", _key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("id", "row", "pos", _hash(F.col("key")).alias("h")).select("id", "row", "pos", "h.h1", "h.h2")


class LineRuns:
    """The levels of sorted runs and of tallies, and what they say of a line."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark, self.scratch, self.fanout = spark, Scratch(spark, "line-runs"), fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[list[str]] = [[]]
        self.tallies: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}
        self._usual = spark.conf.get(SORTED_SCANS)
        spark.conf.set(SORTED_SCANS, "true")

    def _store(self, rows: DataFrame, name: str) -> str:
        """Write rows as a table of sorted buckets; its name."""
        known = f"veriset_{name}_{uuid.uuid4().hex}"
        self.paths[known] = self.scratch.path(name)
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[known]).saveAsTable(known)
        return known

    def _drop(self, *tables: str) -> None:
        for name in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.remove(self.paths.pop(name))

    def known(self) -> list[str]:
        """The runs, which share no hash."""
        return [r for level in self.runs for r in level]

    def add(self, held: DataFrame) -> None:
        """Take one batch: ``id, h1, h2``, a row for each document and line hash in it."""
        batch = self._store(held.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")), "batch")
        known = self.known()
        if not known:
            self._push(self.runs, 0, batch)
            return
        fresh = self.spark.table(batch)
        for run in known:
            fresh = fresh.join(self.spark.table(run).select(*HASH), HASH, "left_anti")
        fresh = self._store(fresh, "run")
        seen = self.spark.table(batch).join(self.spark.table(fresh).select(*HASH), HASH, "left_anti")
        self._push(self.tallies, 0, self._store(seen, "tally"))
        self._push(self.runs, 0, fresh)
        self._drop(batch)

    def _push(self, levels: list[list[str]], level: int, run: str) -> None:
        if len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) >= self.fanout:
            merged, levels[level] = levels[level], []
            self._push(levels, level + 1, self._store(self._merge(merged, levels is self.tallies), "merged"))
            self._drop(*merged)

    def _merge(self, runs: list[str], tallies: bool) -> DataFrame:
        """Sorted runs, which share no hash, merged into one; tallies of one hash are added up."""
        out = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).toDF(*HASH, "n2", "keeper2")
            count = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0)) if tallies else F.coalesce("n", "n2")
            keeper = F.greatest("keeper", "keeper2") if tallies else F.when(F.col("n").isNull(), F.col("keeper2")).otherwise(F.col("keeper"))
            out = out.join(other, HASH, "full").select(*HASH, count.cast("long").alias("n"), keeper.alias("keeper"))
        return out

    def repeated(self, min_docs: int) -> DataFrame:
        """``h1, h2, keeper`` of the lines that at least ``min_docs`` documents hold; ends the use of the runs."""
        tallies = [t for level in self.tallies for t in level]
        parts = []
        for run in self.known():
            rows = self.spark.table(run)
            for tally in tallies:
                met = self.spark.table(tally).toDF(*HASH, "n2", "keeper2")
                rows = rows.join(met, HASH, "left").select(*HASH, (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("keeper", "keeper2").alias("keeper"))
            parts.append(rows.where(F.col("n") >= min_docs).select(*HASH, "keeper"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        out = self.scratch.cut(out, "repeated")
        self.close()
        return out

    def close(self) -> None:
        """Delete the tables and set the session as it was."""
        self._drop(*list(self.paths))
        self.runs, self.tallies = [[]], [[]]
        self.spark.conf.set(SORTED_SCANS, self._usual)


def marked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``row, kept, n_lines, n_dropped``: each row of ``docs`` as a struct, its kept lines as text, and counts.

    Documents are taken in ``batches`` ranges of ids, one after the other, as they would
    arrive; the newest come first, so that the first run to hold a line names its keeper.
    """
    spark = docs.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    named = docs.select(whole, ident.alias("id"), text.alias("text"), F.xxhash64(F.lit(3), text).alias("row"))
    keys = docs.select(ident.alias("id"), text.alias("text"), F.xxhash64(F.lit(3), text).alias("row"))
    cuts: list[int] = []
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") and batches > 1:
        found = docs.select(F.percentile_approx(ident, [i / batches for i in range(1, batches)], 1000)).first()[0]
        cuts = sorted(set(found or []))
    runs = LineRuns(spark, fanout)
    try:
        edges = [None, *cuts, None]
        for low, high in zip(edges[-2::-1], edges[:0:-1], strict=True):  # the newest ids first
            above = F.lit(True) if low is None else F.col("id") > low
            below = F.lit(True) if high is None else F.col("id") <= high
            if low is None:
                below = below | F.col("id").isNull()
            runs.add(_held(keys.where(above & below), min_chars))
        repeated = runs.repeated(min_docs)
    finally:
        runs.close()
    gone = _places(keys, min_chars).join(repeated, HASH).where(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = gone.groupBy("id", "row").agg(F.collect_list("pos").alias("gone")).toDF("d_id", "d_row", "gone")
    met = named.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & F.col("row").eqNullSafe(F.col("d_row")), "left").withColumn("lines", _lines(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size(stay)).cast("long")
    return met.select(F.col("whole").alias("row"), kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options: int) -> DataFrame:
    """``docs`` with the kept lines as text; ``length_col``, if any, follows the texts that lost lines."""
    marked = marked_lines(docs, id_col, text_col, **options)
    kinds = dict(docs.dtypes)

    def column(c: str) -> Column:
        as_it_is = F.col("row").getField(c)
        if c == text_col:
            return F.col("kept").alias(c)
        if c == length_col:
            return F.when(F.col("n_dropped") > 0, F.length("kept").cast(kinds[c])).otherwise(as_it_is).alias(c)
        return as_it_is.alias(c)

    return marked.select(*map(column, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = marked_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) s,
       LATERAL (SELECT z[1] AS pos, z[2] AS line) u),
hot AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, hot.keeper IS NOT NULL AND l.doc_id <> hot.keeper AS gone FROM lines l LEFT JOIN hot ON l.k = hot.k AND length(l.k) >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Mixing sources to target weights by systematic sampling.

Targets: the sources share all words by weight, each stopping at ``most`` times
its own size; what is over is shared again by weight.  That is water filling:
sources sorted by cap / weight, the first level that the next cap does not cut.

Copies: every document of a source expects ``target / source size`` copies, neither
more nor less.  The expected copies are prefix-summed over the source, one random
offset is added, and a document is emitted once for each integer that its span
crosses: the floor or the ceiling of what it expects, ``most`` at most.

The order of the sum decides how far the words taken may miss their target.  The
spans, wound around a circle of length one, should cover all of it with equally many
words, for then every offset takes the same.  So the ``HEAD`` largest documents of a
source are laid out in that way, each of them in turn where the circle holds least
(``arrange``); the others follow with falling sizes, and their sum telescopes.
Whatever the offset, a source misses its target by at most ``spread + s``: the words
by which the laid-out circle is uneven, and the size of the largest document that was
not laid out.  (Falling sizes alone would miss by up to the largest document of all.)
A source of few documents, one of them huge, still misses by much: no order helps where
that document is in or out by one draw.

Nothing but the head of a source and one row per source is brought together;
documents are summed where they lie, so a source with a third of all rows is spread
over all tasks.  Reruns give the same mix.

Defined results: a null text has size 0; null sources are one source, last in
order; sources without words have target 0 and take nothing; rows that share an
id are documents of their own, in an order given by the columns in ``carry``, and
rows alike in those too are interchangeable; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm.common import in_ranges, prefix_sums, prepare, table
from veriset.plans.scratch import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: Largest documents of a source that are laid out, and the cells of the circle.
HEAD, CELLS = 2048, 512


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """``source_size`` per ``_source`` -> also ``target``.  Sources are ranked and summed in ranges, not in one task."""
    one = F.lit(1).cast("long")
    named = prefix_sums(scratch.cut(in_ranges(sources, F.col("_source")), "sources"), [F.col("_source")], {"_nth": one, "_before": F.col("source_size")})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_nth") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    levels = named.select("_source", "source_size", F.col("_before_total").alias("_all"), weight.alias("_w"), cap.alias("_cap"), (cap / weight).alias("_level"))
    by = [F.col("_level"), F.col("_source")]
    summed = prefix_sums(scratch.cut(in_ranges(levels, *by), "levels"), by, {"_capped": F.col("_cap"), "_lighter": F.col("_w")})
    # The level if this source and all above it are the ones not capped.
    free = scratch.cut(summed.withColumn("_free", (F.col("_all") - F.col("_capped")) / (F.col("_lighter_total") - F.col("_lighter"))), "free")
    found = free.where("_free <= _level").agg(F.min(F.struct("_level", "_source", "_free")).alias("f")).select("f._free").first()[0]
    fill = F.lit(float("inf") if found is None else found)
    return free.select("_source", "source_size", F.when(F.col("_level") > fill, fill * F.col("_w")).otherwise(F.col("_cap")).alias("target"))


def arrange(sizes: np.ndarray, share: float, cells: int = CELLS) -> np.ndarray:
    """Places of documents (largest first), so that spans of length ``share``, one after the other around a circle, cover it evenly.

    Each document takes, of the places left, the one whose span lies where the circle holds fewest words.
    """
    n = len(sizes)
    width = int(round(share * cells))
    if not 0 < width < cells:
        return np.arange(n)
    first = np.floor(np.arange(n) * share % 1 * cells).astype(int)
    taken, held, place, span = np.zeros(n), np.zeros(cells), np.empty(n, int), np.arange(width)
    for i in range(n):
        sums = np.cumsum(np.r_[0, held, held[:width]])
        p = place[i] = int((sums[first + width] - sums[first] + taken).argmin())
        taken[p] = np.inf
        held[(first[p] + span) % cells] += sizes[i]
    return place


def _arranged(head: pa.Table) -> pa.Table:
    head = head.sort_by("_rank")
    place = arrange(head["size"].to_numpy().astype(float), head["_rate"][0].as_py() % 1)
    return pa.table({"_source": head["_source"], "_rank": head["_rank"], "_place": pa.array(place, pa.int64())})


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: int = 17, head: int = HEAD, carry: dict[str, Column] | None = None) -> DataFrame:
    """``id, source, size, source_size, target, copies, taken`` and the columns named in ``carry``, a row per document."""
    spark, carry = docs.sparkSession, carry or {}
    prepare(spark)
    scratch = Scratch(spark, "mixing")
    name = F.col(f"`{source_col}`")
    source = F.when(name.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), name))
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), name.alias("source"), source.alias("_source"), size.alias("size"), *(c.alias(k) for k, c in carry.items()))
    order = [F.col("size").desc(), F.xxhash64(F.lit(seed), F.col("id")), F.col("id"), *map(F.col, carry)]
    ranged = scratch.cut(in_ranges(sized, F.col("_source"), *order), "ranged")
    targets = water_fill(ranged.groupBy("_source").agg(F.sum("size").alias("source_size")), scratch, weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    offset = F.xxhash64(F.lit(seed), F.col("_source")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    rates = scratch.cut(targets.select("_source", "source_size", "target", rate.alias("_rate"), offset.alias("_offset")), "rates")

    ranked = scratch.cut(prefix_sums(ranged, order, {"_rank": F.lit(1).cast("long")}, ("_source",)).drop("_pid", "_rank_total").join(rates, "_source"), "ranked")
    top = ranked.where(F.col("_rank") < head).select("_source", "_rank", "size", "_rate")
    places = scratch.cut(top.groupBy("_source").applyInArrow(lambda part: _arranged(part), "_source string, _rank long, _place long"), "places")
    rest = ranked.where(F.col("_rank") >= head).withColumn("_at", F.col("_rank"))
    laid = ranked.join(places, ["_source", "_rank"]).withColumnRenamed("_place", "_at").select(*rest.columns).unionByName(rest)
    copies = (F.floor((F.col("_at") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_at") * F.col("_rate") + F.col("_offset"))).cast("long")
    return laid.select("id", "source", "size", "source_size", "target", copies.alias("copies"), *carry).withColumn("taken", F.col("size") * F.col("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), n_words(F.col("text"))).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def targets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets alone, which SQL can check: ``source, n_docs, source_size, target``; each source's taken words are near its target."""
    mixed = mix(table(spark, sf_dir, "documents"), n_words(F.col("text")))
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.first("source_size").alias("source_size"), F.round(F.first("target"), 4).alias("target"))


TARGETS_SQL = r"""
WITH s AS (SELECT source, count(*) AS n_docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS size FROM documents GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight, sum(size) OVER () AS whole FROM s),
-- The water level at which all sources share everything: found by trying each source's cap as the level.
tried AS (SELECT x.source AS at, 3.0 * x.size / x.weight AS level, sum(least(3.0 * x.size / x.weight * w.weight, 3.0 * w.size))::DOUBLE AS used FROM w x, w GROUP BY ALL),
below AS (SELECT coalesce(max(level), 0) AS low FROM tried, (SELECT max(whole) AS whole FROM w) m WHERE used <= whole),
fill AS (SELECT (max(whole) - coalesce(sum(3.0 * size) FILTER (WHERE 3.0 * size / weight <= low), 0))::DOUBLE / sum(weight) FILTER (WHERE 3.0 * size / weight > low) AS level FROM w, below)
SELECT source, n_docs, size AS source_size, round(least(coalesce(level, 'inf'::DOUBLE) * weight, 3.0 * size)::DOUBLE, 4) AS target FROM w, fill
"""

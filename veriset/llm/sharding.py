"""Contiguous shards of near-equal byte size from a global prefix sum.

Documents are dealt by range of their id; each partition sums its own sizes, the
few partition totals are prefix-summed, and every document thus knows the bytes
before it.  The total is cut at equal targets; a document goes to the shard that
holds its middle byte, so a shard misses its target by one document at most.

Defined results: a null text has no bytes (size 1, checksum 0); an empty table
gives no rows; rows that share an id stand together in an order given by size
and checksum; rows with a null id come first; other columns are not read, whatever
their names.  A very long text is read once and stays where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm.common import in_ranges, prefix_sums, table
from veriset.plans.scratch import Scratch


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot, start_byte``: slot counts from 0 within each shard, in id order."""
    if shards < 1:
        raise ValueError("at least one shard")
    scratch = Scratch(docs.sparkSession, "sharding")
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    order = [F.col("id"), F.col("size"), F.col("text_crc32")]
    ranged = scratch.cut(in_ranges(sized, *order), "ranged")
    summed = prefix_sums(ranged, order, {"start_byte": F.col("size"), "row": F.lit(1).cast("long")})
    middle = f"least({shards - 1}, (2 * start_byte + size) * {shards} div (2 * start_byte_total))"
    placed = scratch.cut(summed.select("id", "size", "text_crc32", "start_byte", "row", F.expr(middle).cast("int").alias("shard")), "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard: bounded by the parameter
    return placed.join(F.broadcast(firsts), "shard").select("id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "start_byte")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The table of CRC-32 is made from its polynomial; text bytes come from their hex digits.
SQL = r"""
WITH RECURSIVE bits(v, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
poly AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, length(h) // 2 + 1 AS size, list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS crc FROM b, poly),
s AS (SELECT *, coalesce(sum(size) OVER w, 0) AS before, sum(size) OVER () AS whole FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, least(15, (2 * before + size) * 16 // (2 * whole))::INT AS shard FROM s)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""

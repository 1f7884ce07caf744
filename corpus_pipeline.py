"""The corpus pipeline: toxicity, line dedup, near-dedup, source mix, packing.

Each stage takes the documents that its predecessor kept (written as Parquet and
read again), does its work on all of them, and but for the last returns documents
with the columns of the first table.  MinHash works on shingles of five words at a
similarity of 0.8 here; the mix emits a document as often as its copies say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm import line_dedup, minhash, mixing, packing, toxicity
from veriset.llm.common import table
from veriset.plans.scratch import Scratch

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the one of the largest id; ``n_chars`` follows the text."""
    return line_dedup.dedup_lines(docs, length_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the smallest id stays."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; of rows alike in every column one is written as often as all are taken."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = {f"h{k}": F.xxhash64(F.lit(k), *columns, *(c.isNull() for c in columns)) for k in (1, 2)}
    mixed = mixing.mix(docs, mixing.n_words(F.col("text")), carry=key)
    copies = mixed.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).where("copies > 0")
    taken = docs.select(F.struct(*columns).alias("row"), *(c.alias(k) for k, c in key.items())).join(copies, list(key))
    rows = taken.where("alike = 1").unionByName(taken.where("alike > 1").dropDuplicates(list(key)))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

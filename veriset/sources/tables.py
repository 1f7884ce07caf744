"""Scans and sinks with fixed schemas: lists, CSV, JSON, run tables, binary files, digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.functions.columns import entry_paths, finite, six_digits
from veriset.operators import gates

EMBEDDINGS = "key string, split string, phash long, emb array<float>"
CONTRIBUTIONS = "run_id string, item string, class_id int, inter long, uni long, pred long, label long"
METADATA = "Name string, Index int, Plant string, Disease string, Resolution string, `Label file` string, `Mask ratio` double, URL string, License string, Split string"
AUDIT = "pair_id string, image_1 string, image_2 string, verdict string, notes string"
STRATA = "key string, size_ratio double, chr_value double, edge_contact boolean, classes array<int>, class_pixels map<string,bigint>, size string, chr string, edge string, frequency string"


def scan_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """``path, name, stem, split, bytes`` of the files under root/split/; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root).select("path", F.col("length").alias("bytes"))
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("split"), "bytes")


def scan_items(spark: SparkSession, root: str, suffix: str, counts: dict[str, int] | None = None) -> DataFrame:
    """``key, path, split`` of the images under root/split/; ``counts`` says how many each split must have."""
    files = scan_files(spark, root, suffix)
    found = files.select(F.concat_ws("/", "split", "name").alias("key"), "path", "split")
    if counts is not None:
        have = {r.split: r.n for r in found.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per split
        if have != counts:
            raise gates.GateError(f"items by split {have} instead of {counts}")
    return found


def pair_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer match by split and stem: ``split, stem, left_path, right_path``; orphans keep a null side."""
    one = left.select("split", "stem", F.col("path").alias("left_path"))
    return one.join(right.select("split", "stem", F.col("path").alias("right_path")), ["split", "stem"], "full_outer")


def exact_pairs(left: DataFrame, right: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """The same, but a stem that stands twice, a file without its partner or a split of another size raises."""
    for side in (left, right):
        gates.expect_unique(side, "split", "stem")
    pairs = pair_files(left, right)
    gates.expect_all(pairs, F.col("left_path").isNotNull() & F.col("right_path").isNotNull(), "unpaired file")
    for split, n in (counts or {}).items():
        gates.expect_count(pairs.where(F.col("split") == split), n, split)
    return pairs


def scan_list(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a text list: stripped, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, its columns checked against the schema, by name and order; a byte-order mark is skipped."""
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", True)
    names = reader.csv(path, header=False, encoding="UTF-8").limit(1).first()
    wanted = spark.createDataFrame([], schema).columns
    found = [str(x or "").lstrip("\ufeff").strip() for x in names] if names else []
    if found != wanted:
        raise gates.GateError(f"columns {found} instead of {wanted}")
    return reader.schema(schema).csv(path, header=True, enforceSchema=True, encoding="UTF-8", mode="FAILFAST")


def scan_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """Contributions of all runs, partitioned by run: a filter on ``run_id`` reads only its folder."""
    return spark.read.schema(CONTRIBUTIONS).parquet(root)


def scan_run(spark: SparkSession, root: str, run_id: str, summary: str) -> DataFrame:
    """One run's contributions; its summary (JSON) must be of that run."""
    told = scan_json(spark, summary).select("run_id").first()
    if told is None or told.run_id != run_id:
        raise gates.GateError(f"{summary} is of {told and told.run_id}, not of {run_id}")
    return scan_runs(spark, root).where(F.col("run_id") == run_id)


def scan_embeddings(spark: SparkSession, path: str, items: DataFrame | None = None) -> DataFrame:
    """The cache of hashes and vectors; ``items`` (``key, split``) must be the same, each once."""
    cache = spark.read.schema(EMBEDDINGS).parquet(path)
    if items is not None:
        gates.expect_unique(cache, "key")
        gates.expect_same_keys(cache.select(F.struct("key", "split").alias("item")), items.select(F.struct("key", "split").alias("item")), "item")
    return cache


def scan_masks(spark: SparkSession, root: str) -> DataFrame:
    """``path, height, width, pixels`` of the PNG masks under root."""
    from veriset.operators.raster import decode_masks

    return decode_masks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root))


def embed_files(files: DataFrame, encode: Callable[[list[bytes]], list[tuple[int, list[float]]]], batch: int = 64) -> DataFrame:
    """``path, content`` -> ``path, phash, emb`` by any model: ``encode`` gets ``batch`` files' bytes and gives a 64-bit hash and a vector of each; vectors come out at length one."""
    import numpy as np

    from veriset.operators.shipping import prepare

    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.slice(at, batch)
                hashes, vectors = zip(*encode(part.column(1).to_pylist()), strict=True)
                x = np.array(vectors, np.float64)
                norm = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                signed = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed, pa.int64()), pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["path", "phash", "emb"])

    return files.select("path", "content").mapInArrow(run, "path string, phash long, emb array<float>")


def scan_register(path: str) -> list[dict]:
    """The hypotheses of a YAML register (JSON is YAML too); a small file that the driver reads."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        register = json.loads(text)
    else:
        register = yaml.safe_load(text)
    return [h for h in (register or {}).get("hypotheses", []) if isinstance(h, dict)]


def list_entries(keys: DataFrame, image_root: str, mask_root: str, image_suffix: str = ".jpg", mask_suffix: str = ".png") -> DataFrame:
    """``key, image_path, mask_path`` of a list's entries ``split/name``."""
    image, mask = entry_paths(F.col("key"), image_root, mask_root, image_suffix, mask_suffix)
    return keys.where(F.trim("key") != "").select("key", image.alias("image_path"), mask.alias("mask_path"))


def verify_archive(spark: SparkSession, path: str, md5: str) -> str:
    """The path, if the file's MD5 is the one expected."""
    found = spark.read.format("binaryFile").load(path).select(F.md5("content").alias("d")).first()
    if found is None or found.d != md5.lower():
        raise gates.GateError(f"{path}: MD5 {found and found.d} instead of {md5}")
    return path


def with_seed(df: DataFrame) -> DataFrame:
    """The seed that a file's name ends in."""
    return df.withColumn("seed", F.regexp_extract(F.col("_metadata.file_path"), r"seed(\d+)\.[A-Za-z]+$", 1).cast("int"))


def write_runs(parts: DataFrame, root: str) -> None:
    parts.write.partitionBy("run_id").mode("overwrite").parquet(root)


def write_list(keys: DataFrame, path: str, key: str = "key") -> str:
    """Unique keys, sorted, one per line; the digest of the list.  A list is one file by contract."""
    if keys.groupBy(key).count().where("count > 1").take(1):
        raise ValueError("a key stands twice")
    keys.select(F.col(key).cast("string").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("errorifexists").text(path)
    return list_digest(keys, key)


def list_digest(keys: DataFrame, key: str = "key") -> str:
    """The digest of the sorted list, as ``write_list`` writes it; lines stream to the driver in order, none are collected."""
    digest = hashlib.sha256()
    for row in keys.select(F.col(key).cast("string").alias("k")).orderBy("k").toLocalIterator():
        digest.update((row.k + "\n").encode())
    return "sha256:" + digest.hexdigest()


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def json_digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _put(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """One small file, by the driver, wherever Spark can write; an existing one raises."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, overwrite)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_manifest(spark: SparkSession, path: str, payload: dict) -> str:
    """A manifest as JSON, indented and with sorted keys; the digest of its bytes."""
    blob = (json.dumps(payload, indent=2, sort_keys=True, allow_nan=False) + "\n").encode()
    _put(spark, path, blob, overwrite=True)
    return "sha256:" + hashlib.sha256(blob).hexdigest()


def file_digest(spark: SparkSession, path: str, kind: str = "sha256") -> str:
    content = spark.read.format("binaryFile").load(path)
    return content.select((F.md5("content") if kind == "md5" else F.sha2("content", 256)).alias("d")).first().d


def run_record(spark: SparkSession, path: str, run_id: str, family: str, arm: str, seed: int, status: str, inputs: dict[str, str], **more: object) -> dict:
    """Write what a run was and the digests of its inputs; a record that is there already raises."""
    told = {name: {"path": p, "sha256": "sha256:" + file_digest(spark, p)} for name, p in inputs.items()}
    record = {"run_id": run_id, "model": family, "arm": arm, "seed": int(seed), "status": status, "recorded_at_utc": datetime.now(timezone.utc).isoformat(), "inputs": told, **more}
    _put(spark, path, json.dumps(record, indent=2).encode())
    return record


def write_figures(spark: SparkSession, folder: str, specs: dict[str, dict]) -> list[str]:
    """Figure specs, one JSON file each, from which alone figures are drawn."""
    paths = []
    for stem, spec in specs.items():
        paths.append(f"{folder}/{stem}.json")
        _put(spark, paths[-1], (json.dumps({**spec, "stem": stem}, indent=2, sort_keys=True, allow_nan=False) + "\n").encode(), overwrite=True)
    return paths


def write_audit(sample: DataFrame, folder: str, path_of: DataFrame | None = None) -> None:
    """The reviewers' sheet and the sealed key, in folders of their own, and which file each blind name stands for."""
    from veriset.operators.audit import reviewer_sheet, sealed_key

    reviewer_sheet(sample, path_of).orderBy("pair_id").write.mode("errorifexists").json(f"{folder}/reviewer", ignoreNullFields=False)
    sealed_key(sample).orderBy("pair_id").write.mode("errorifexists").json(f"{folder}/key", ignoreNullFields=False)
    if path_of is not None:
        sides = [sample.select("pair_id", F.lit(k).alias("side"), F.col(f"image_{k}").alias("key")) for k in (1, 2)]
        blind = sides[0].unionByName(sides[1]).join(path_of, "key")
        name = F.concat("pair_id", F.lit("_"), F.col("side").cast("string"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
        blind.select(name.alias("name"), "path").write.mode("errorifexists").json(f"{folder}/assets")


def write_csv(df: DataFrame, path: str, digits: bool = True) -> None:
    """Doubles with six digits, empty for null, or as they are."""
    shown = [six_digits(finite(F.col(c))).alias(c) if t == "double" and digits else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("errorifexists").csv(path, header=True, lineSep="\n", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """One object per line; NaN and infinities become null."""
    df.select(*(finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).write.mode("errorifexists").json(path, ignoreNullFields=False)


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256, bytes`` of every file under root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def quarantine(row: DataFrame, path: str) -> None:
    """A record that must not exist yet."""
    row.write.mode("errorifexists").json(path)

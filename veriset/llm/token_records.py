"""Token ids in length-delimited binary record files with a separate offset index.

Format.  A record file is a run of frames: the payload's length (u64), the masked
CRC-32 of those eight bytes (u32), the payload, the masked CRC-32 of the payload
(u32); all little-endian.  Masking turns a checksum right by 15 bits and adds
0xA282EAD8, so that a checksum stored in data is not mistaken for its own.  The
payload is a flag byte (1: the id is null; 2: wide ids), the document id (i64) and
the token ids (u16 each, or u32 if the vocabulary needs it).  Beside each record file lies its index: per record the document
id (i64), the frame's offset (u64) and its number of ids (u64), 24 bytes each, so
a shuffled reader seeks without scanning.

Documents are dealt by range of their id and sorted within each task, so the
files in order of their number hold ascending ids.  A task writes under a name of
its own attempt; only files in the manifest count, so a lost or repeated attempt
leaves nothing that is read.  Tasks stream: one batch of texts at a time.

Defined results: a null or empty text is the end id alone; rows that share an id
are records side by side, in an order given by their texts; a null id comes first;
an empty table gives no records; other columns are not read, whatever their names.
A very long text costs a task its bytes, its words and its ids, once each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriset.llm.common import chunks, prepare, table, texts
from veriset.llm.tokens import encoder
from veriset.plans.scratch import Scratch

MANIFEST = "part int, records string, index string, n_records long, n_tokens long, n_bytes long"
HEAD, LENGTH, CRC, ENTRY = struct.Struct("<Bq"), struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qQQ")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CRC.pack(masked(length)), payload, CRC.pack(masked(payload))))


def read_frames(stream, name: str = "") -> Iterator[bytes]:
    """Payloads of a record file; a wrong checksum or a cut file raises."""
    while head := stream.read(12):
        if len(head) < 12 or CRC.unpack(head[8:])[0] != masked(head[:8]):
            raise ValueError(f"broken length in {name}")
        n = LENGTH.unpack(head[:8])[0]
        payload, crc = stream.read(n), stream.read(4)
        if len(payload) < n or len(crc) < 4 or CRC.unpack(crc)[0] != masked(payload):
            raise ValueError(f"broken record in {name}")
        yield payload


def read_at(stream, offset: int) -> bytes:
    """One payload by the offset that the index gives."""
    stream.seek(offset)
    return next(read_frames(stream))


def _writer(folder: str, tokenizer: str, kind: str, end_id: int) -> Callable:
    return lambda batches: _write(batches, folder, tokenizer, kind, end_id)


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, kind: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    files, root = pafs.FileSystem.from_uri(folder)
    tool = encoder(tokenizer, kind)
    wide = max(tool.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
    width = "<u4" if wide else "<u2"
    end = np.array([end_id], width).tobytes()
    name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
    records = index = None
    n = tokens = at = 0
    try:
        for batch in chunks(batches):
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if records is None and ids:
                files.create_dir(root, recursive=True)
                records, index = (files.open_output_stream(name + x, buffer_size=1 << 20) for x in (".rec", ".idx"))
            for doc, encoded in zip(ids, tool.encode(bodies), strict=True):
                framed = frame(HEAD.pack((doc is None) | wide << 1, doc or 0) + (encoded if wide else np.frombuffer(encoded, "<u4").astype(width).tobytes()) + end)
                count = len(encoded) // 4 + 1
                records.write(framed)
                index.write(ENTRY.pack(doc or 0, at, count))
                n, tokens, at = n + 1, tokens + count, at + len(framed)
    finally:
        for f in (records, index):
            if f is not None:
                f.close()
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name + ".rec", name + ".idx", n, tokens, at)], names=["part", "records", "index", "n_records", "n_tokens", "n_bytes"]).cast(
            pa.schema([("part", pa.int32()), ("records", pa.string()), ("index", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files under ``folder`` (a URI that all executors reach); the manifest, a row per file."""
    spark = docs.sparkSession
    prepare(spark)
    ranged = texts(docs, id_col, text_col).repartitionByRange("id", F.xxhash64("body")).sortWithinPartitions("id", F.xxhash64("body"), "body")
    written = ranged.mapInArrow(_writer(f"{folder}/files", tokenizer, kind, end_id), MANIFEST)
    path = f"{folder}/manifest"
    written.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def _reader(root_uri: str, with_ids: bool) -> Callable:
    return lambda batches: _read(batches, root_uri, with_ids)


def _read(batches: Iterator[pa.RecordBatch], root_uri: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs

    files = pafs.FileSystem.from_uri(root_uri)[0]
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            held = 0
            with files.open_input_stream(path, buffer_size=1 << 20) as stream:
                for payload in read_frames(stream, path):
                    flags, doc = HEAD.unpack_from(payload)
                    body = payload[HEAD.size :] if flags & 2 else np.frombuffer(payload, "<u2", offset=HEAD.size).astype("<u4").tobytes()
                    n = len(body) // 4
                    rows.append((None if flags & 1 else doc, start, n, zlib.crc32(body), *((body,) if with_ids else ())))
                    start, held = start + n, held + (len(body) if with_ids else 32)
                    if held > 1 << 20:
                        yield _rows(rows, with_ids)
                        rows, held = [], 0
            if rows:
                yield _rows(rows, with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def read_records(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` (and ``ids``, little-endian u32) of every record, checksums verified."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = manifest.select("records", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    n_files = max(1, manifest.count())
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return starts.repartition(n_files).mapInArrow(_reader(folder, with_ids), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Scratch(spark, "token-records").root
    manifest = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(manifest, folder).withColumnRenamed("id", "doc_id")

"""Intermediate tables in the folder that all executors share.

Iterative plans cut their lineage by writing a Parquet table under
``spark.checkpoint.dir`` and reading it back: a lost executor then costs a
re-read, never a replay of the whole loop, and the next plan gets real sizes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_kept: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set a temporary one, in local mode alone."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="veriset-")
    return _fallback[app]


class Scratch:
    """Tables of one query, each in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veriset-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, free of its lineage."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veriset_path = path
        return out

    def remove(self, *paths: str) -> None:
        """Delete folders below the root."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        self.remove(*(path for t in tables if (path := getattr(t, "_veriset_path", None))))


def _status(spark: SparkSession, path: str) -> tuple | None:
    """Name, size and time of the files at a path; None if there are none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    if not files.exists(target):
        return None
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(target)))


def once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the table at ``source``, written once a session and read from then on, while the table is the same and the copy is there."""
    key = (spark.sparkContext.applicationId, name, source, _status(spark, source))
    path = _kept.get(key)
    if path is None or _status(spark, f"{path}/_SUCCESS") is None:
        _kept[key] = path = Scratch(spark, name).path(name)
        build().write.parquet(path)
    return spark.read.parquet(path)

"""Python kernels on executors: the package travels as a zip, so nothing needs to be installed there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: few, since one row may be a very long text or a whole block.
BATCH_ROWS = 1000
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Before Python kernels run: executors can import this package, and get batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="veriset-code-")  # the driver's; the context sends the file to executors
    with zipfile.ZipFile(f"{folder}/veriset.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(f"{folder}/veriset.zip")
    _shipped.add(context.applicationId)

"""Gives executors this package, wherever the driver was started from, and bounds the Arrow batches that they exchange with Python."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, about, unless the session sets its own bound: workers hold several arrays for each byte of text.
BATCH, BATCH_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", f"{64 << 20}b"


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application, and bound its Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == DEFAULT_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    to = tempfile.mkdtemp(prefix="larkspur-code-")
    shutil.copytree(root / "larkspur", f"{to}/src/larkspur", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{to}/larkspur", "zip", f"{to}/src"))
    shutil.rmtree(f"{to}/src")
    _shipped.add(sc.applicationId)

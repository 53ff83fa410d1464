"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes that a Python worker gets at a time, where the session leaves Spark's defaults: whole texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application, and bound their batches."""
    for name, (default, bound) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, bound)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(os.path.realpath(tempfile.mkdtemp(prefix="spark-sources-"))) / f"{root.name}_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)

"""Tables written to the folder that driver and executors share, where lineage is to end."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, gets an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders written and not yet removed, by application.
_WRITTEN: dict[str, set[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; removed by remove(), else when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = set()
        atexit.register(_remove_rest, spark, app)
    _WRITTEN[app].add(path)
    return path


def _remove_rest(spark: SparkSession, app: str) -> None:
    for path in sorted(_WRITTEN.pop(app, ())):
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it from there: its lineage ends, and losing executors costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.kept_at = path
    return read


def remove(df: DataFrame) -> None:
    """Delete what keep() gave, when it's read no more."""
    remove_path(df.sparkSession, df.kept_at)


@contextlib.contextmanager
def scratch(spark: SparkSession, *spared: str) -> Iterator[None]:
    """Remove at the end what was written within, but for folders whose names begin as said."""
    before = set(_WRITTEN.get(spark.sparkContext.applicationId, ()))
    yield
    for path in sorted(_WRITTEN.get(spark.sparkContext.applicationId, set()) - before):
        if not path.rsplit("/", 1)[1].startswith(spared):
            remove_path(spark, path)

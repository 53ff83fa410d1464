"""Prototype and embedding stores, and ledger files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import description_column


def missing_labels(taxonomy: DataFrame, store: DataFrame) -> DataFrame:
    """Labels that a store lacks; any at all means that it is built anew."""
    return taxonomy.select("domain", "label").distinct().join(store.select("domain", "label").distinct(), ["domain", "label"], "left_anti")


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts without a cached embedding."""
    return texts.select("eval_text").distinct().join(cache.select("eval_text"), "eval_text", "left_anti")


class StaleVersion(Exception):
    """Another writer has committed since the version that a write builds on."""


MANIFEST = "version string, at string"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """(number, version, at) of the committed versions; an entry that a writer didn't finish counts for nothing."""
    named = spark.read.schema(MANIFEST).json(f"{root}/manifest").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).cast("long").alias("number"), "version", "at")
    return named.where("version is not null and number is not null")


def latest(spark: SparkSession, root: str) -> int:
    """Number of a store's newest version; 0 where there is none."""
    try:
        return _manifest(spark, root).agg(F.max("number")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def _commit(spark: SparkSession, root: str, version: str, expected: int | None) -> int:
    """Enter a version under the next number, which only one writer can create. With `expected`, that must be the newest number still."""
    while True:
        number = (latest(spark, root) if expected is None else expected) + 1
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{number:012d}.json")
        try:
            out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in type(e.java_exception).__name__ and "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            if expected is not None:
                raise StaleVersion(f"{root}: {number} is there already") from None
            continue
        out.writeBytes(json.dumps({"version": version, "at": datetime.now(UTC).isoformat()}) + "\n")
        out.close()
        return number


def write_version(df: DataFrame, root: str, *partition: str, expected: int | None = None) -> str:
    """Write a new version of a store and then enter it in the manifest; readers of the old one are not disturbed, and a failed write leaves it.

    With `expected`, the number that the new version builds on, it fails where another writer was first, and leaves nothing.
    """
    version, spark = uuid.uuid4().hex, df.sparkSession
    folder = f"{root}/versions/{version}"
    try:
        if expected is not None and latest(spark, root) != expected:
            raise StaleVersion(f"{root}: not at {expected} any more")
        (df.write.partitionBy(*partition) if partition else df.write).parquet(folder)
        _commit(spark, root, version, expected)
    except Exception:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        raise
    return version


def read_version(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The store's latest version, or an earlier one."""
    version = _manifest(spark, root).orderBy(F.desc("number")).take(back + 1)[back]["version"]
    return spark.read.parquet(f"{root}/versions/{version}")


def roll_back(spark: SparkSession, root: str, back: int = 1) -> int:
    """Make an earlier version the newest again, by a new entry: nothing is rewritten, and going back can be undone."""
    newest = _manifest(spark, root).orderBy(F.desc("number")).take(back + 1)
    return _commit(spark, root, newest[back]["version"], newest[0]["number"])


class EmbeddingCache:
    """Embeddings by text, in a table bucketed and sorted by the text: (eval_text, v).

    Looking texts up shuffles the texts only, the cache stays where it lies; only texts that aren't there are encoded, and appended.
    One cache for each encoder. Null texts are left out.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets

    def _write(self, rows: DataFrame, table: str, mode: str) -> None:
        # Dealt out as the buckets are, so a bucket is written by one task.
        rows.select("eval_text", "v").repartition(self.buckets, "eval_text").write.bucketBy(self.buckets, "eval_text").sortBy("eval_text").mode(mode).saveAsTable(table)

    def rows(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.table):
            self._write(self.spark.createDataFrame([], "eval_text string, v array<double>"), self.table, "ignore")
        return self.spark.table(self.table)

    def missing(self, texts: DataFrame) -> DataFrame:
        """Distinct texts without an embedding."""
        return texts.select("eval_text").where("eval_text is not null").repartition(self.buckets, "eval_text").distinct().join(self.rows(), "eval_text", "left_anti")

    def fill(self, texts: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> int:
        """Encode the missing texts (`encode` adds v to eval_text) and append them; how many there were."""
        before = self.rows().count()
        new = self.missing(texts)
        if new.isEmpty():
            return 0
        self._write(encode(new), self.table, "append")
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).count() - before

    def found(self, texts: DataFrame) -> DataFrame:
        """`texts` with v, null where the cache has none."""
        return texts.join(self.rows(), "eval_text", "left")

    def compact(self) -> None:
        """One file for each bucket again, after many appends: written beside the table, which then is replaced."""
        beside = f"{self.table}_compacted"
        self._write(self.rows().dropDuplicates(["eval_text"]), beside, "overwrite")
        self.spark.sql(f"DROP TABLE {self.table}")
        self.spark.sql(f"ALTER TABLE {beside} RENAME TO {self.table}")


def write_bundle(parts: dict[str, DataFrame], root: str) -> None:
    """Each part as a new version of its own, then one row that names them all: a reader sees either all new parts or none."""
    versions = [(name, write_version(df, f"{root}/{name}")) for name, df in sorted(parts.items())]
    spark = next(iter(parts.values())).sparkSession
    write_version(spark.createDataFrame(versions, "part string, part_version string").coalesce(1), root)


def read_bundle(spark: SparkSession, root: str, back: int = 0) -> dict[str, DataFrame]:
    """The parts of the latest bundle, or an earlier one; a folder without a bundle is an error."""
    try:
        named = read_version(spark, root, back).collect()  # a row for each part
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no prototypes in {root}") from e
    return {r["part"]: spark.read.parquet(f"{root}/{r['part']}/versions/{r['part_version']}") for r in named}


def read_first(spark: SparkSession, paths: list[str], **readers: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The first of `paths` that exists, read by its ending: csv (with a header), parquet, json, or as a plug-in of that name says."""
    own = {"csv": lambda s, p: s.read.option("header", True).csv(p), "parquet": lambda s, p: s.read.parquet(p), "json": lambda s, p: s.read.json(p)}
    for path in paths:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind not in own | readers:
            raise ValueError(f"no reader for {path!r}: give one as {kind}=")
        try:
            return (own | readers)[kind](spark, path)
        except (AnalysisException, FileNotFoundError) as e:
            if isinstance(e, AnalysisException) and e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {paths}")


def described(df: DataFrame, embeddings: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The table's descriptions as text (missing: `nan`), and how many more rows it has than `embeddings`: anything but 0 is for the caller to report."""
    name = description_column(df.columns) if "Description" not in df.columns else "Description"
    texts = df.select(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")).alias("description"))
    return texts, 0 if embeddings is None else texts.count() - embeddings.count()


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; one file only for ledgers known to be small."""
    (df.coalesce(1) if single else df).write.option("header", True).option("encoding", "UTF-8").csv(path)


def union_statements(frames: list[DataFrame]) -> DataFrame:
    """Statements of different columns, one under the other; blank rows go."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.na.drop("all")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import keep, new_path, remove, remove_path, scratch, shared_dir
from ..shipping import ship

#: A word: a run of characters other than the six ASCII white-space characters.
#: `bytes.split()` without arguments splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def n_words(text: Column) -> Column:
    """Number of words of a text column, in the JVM; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_text(df: DataFrame, fn: Callable, fields: str, text: str = "text", chunk: int = 0) -> DataFrame:
    """Replace the column `text` by what `fn` gives for it; the other columns pass as Arrow arrays, untouched.

    With `chunk`, `fn` gets lists of so many texts at most, and gives a list of tuples.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(fields)
    arrow = [to_arrow_type(f.dataType) for f in new]
    kept = [f.name for f in df.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            rows: Iterator[tuple] | list[tuple] = [r for i in range(0, len(texts), chunk) for r in fn(texts[i : i + chunk])] if chunk else map(fn, texts)
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, columns, arrow)], names=[*kept, *new.names])

    return df.mapInArrow(run, T.StructType([*(f for f in df.schema if f.name != text), *new]))


def ordered_key(docs: DataFrame, id_col: str, key: str = "key") -> DataFrame:
    """Add a long that tells rows apart and follows (id, nulls last, place in the table): the id itself where every row has its own."""
    n_rows, n_ids = docs.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    if n_rows == n_ids:
        return docs.withColumn(key, F.col(id_col).cast("long"))
    numbered = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    # Sorted by ranges, the numbers that Spark gives rows follow the order; written, they stay.
    order = numbered.select(F.col(id_col).alias("_id"), F.col("_row").alias("_at")).orderBy(F.col("_id").asc_nulls_last(), "_at")
    keys = keep(order.select("_at", F.monotonically_increasing_id().alias(key)), "keys")
    return numbered.join(keys.hint("merge"), F.col("_row") == F.col("_at")).drop("_row", "_at")

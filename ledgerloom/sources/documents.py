"""Statement files to tokens and cells. The reader of a format is a plug-in; Spark deals the files out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators.layout import page_layer

TOKENS = "source_file string, page_num int, x0 double, y0 double, x1 double, y1 double, text string, score double"
CELLS = "source_file string, page_num int, table_id int, row_idx int, cells array<string>"
PAGES = "source_file string, page_num int, text string"


def statement_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of the files in a folder; order comes from `path`."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


Reader = Callable[[str, bytes], Iterator[tuple]]


def read_with(files: DataFrame, *readers: Reader, schema: str, one_only: bool = False) -> DataFrame:
    """Rows that the first reader with any yields for each file of (path, content), with `error`.

    Readers stand in order: the next is asked if one yields nothing or, unless `one_only`, fails. A file that no reader
    could read gives one row of nulls with the path as source_file and the errors; one without rows or errors gives none.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def rows_of(path: str, content: bytes) -> list[tuple]:
        errors = []
        for reader in readers:
            try:
                rows = list(reader(path, content))
            except Exception as e:  # one bad file must not end the others
                errors.append(f"{type(e).__name__}: {e}")
                if one_only:
                    break
                continue
            if rows:
                return [(*r, None) for r in rows]
        return [(*[path if n == "source_file" else None for n in names], "; ".join(errors))] if errors else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(rows_of(path, content), columns=[*names, "error"], dtype=object)

    return files.mapInPandas(run, f"{schema}, error string")


def pages_with_layer(pages: DataFrame) -> DataFrame:
    return pages.withColumn("layer", page_layer(F.col("text"))).withColumn("n_chars", F.length("text"))


def split_tables(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tables of two columns are metadata, those of tables of four or more transactions; a table is as wide as its widest row."""
    table = ["source_file", "page_num", "table_id"]
    wide = cells.groupBy(*table).agg(F.max(F.size("cells")).alias("_width"))
    # Null-safe, as a reader may leave a number out; widths are a row for each table.
    names = {c: wide[c].alias(f"_{c}") for c in table}
    both = cells.join(wide.select(*names.values(), "_width"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in table]).select(*cells.columns, "_width")
    return both.where("_width = 2").drop("_width"), both.where("_width >= 4").drop("_width")


def metadata_pairs(cells: DataFrame) -> DataFrame:
    """(source_file, page_num, table_id, row_idx, field, value) of two-column tables, blank and missing names left out."""
    name = F.btrim(F.get("cells", F.lit(0)))
    pairs = cells.select("source_file", "page_num", "table_id", "row_idx", name.alias("field"), F.btrim(F.get("cells", F.lit(1))).alias("value"))
    return pairs.where(F.col("field").isNotNull() & ~F.lower("field").isin("", "nan", "none"))


#: Names of columns that a common table may have.
MOST_NAMES = 2000


def _names(header: Column) -> Column:
    """Column names of a header's cells: blank ones by their place, repeated ones numbered, as layout.unique_names has them."""
    base = F.transform(header, lambda c, i: F.when(F.coalesce(F.trim(c), F.lit("")).isin("") | F.startswith(c, F.lit("Unnamed:")), F.concat(F.lit("Col_"), i.cast("string"))).otherwise(collapse(c)))
    return F.transform(base, lambda n, i: _numbered(n, F.size(F.filter(F.slice(base, F.lit(1), i), lambda x: x == n))))


def _numbered(name: Column, before: Column) -> Column:
    return F.when(before > 0, F.concat(name, F.lit("_"), before.cast("string"))).otherwise(name)


def headed_rows(cells: DataFrame) -> DataFrame:
    """(source_file, row_idx, fields) of the rows under each file's header, for any number of files at once; `fields` maps the header's names to the cells.

    A file's header is its first row, if that begins with `txn` or none reads like a header; else the first row that does, and
    what stands above it goes. A row longer than its header names the rest by place; a null cell stays null. One aggregate by file finds
    the headers, so the plan is as large for a thousand files as for one.
    """
    line = F.lower(F.array_join("cells", " ", ""))
    reads = F.contains(line, F.lit("description")) & line.rlike("txn date|date|cheque")
    row = F.struct("row_idx", "cells")
    files = cells.groupBy("source_file").agg(F.min_by(row, "row_idx").alias("top"), F.min_by(row, F.when(reads, F.col("row_idx"))).alias("found"), F.max(reads).alias("any"))
    proper = F.startswith(F.lower(F.coalesce(F.get("top.cells", F.lit(0)), F.lit(""))), F.lit("txn")) | ~F.coalesce("any", F.lit(False))
    heads = files.select("source_file", F.when(proper, F.col("top")).otherwise(F.col("found")).alias("head")).select("source_file", F.col("head.row_idx").alias("_at"), _names(F.col("head.cells")).alias("_names"))
    rows = cells.join(heads, "source_file").where("row_idx > _at")
    n, m = F.size("_names"), F.size("cells")
    rest = F.when(m > n, F.transform(F.sequence(n, m - 1), lambda i: F.concat(F.lit("Col_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.select("source_file", "row_idx", F.map_from_arrays(F.slice(F.concat("_names", rest), F.lit(1), m), F.col("cells")).alias("fields"))


def common_table(rows: DataFrame) -> DataFrame:
    """headed_rows as one table: source_file, row_idx and a column for each name that any file has, in order of the files and of their places; rows without any value go.

    One aggregate finds the names, MOST_NAMES at most; more are an error.
    """
    named = rows.select("source_file", F.posexplode(F.map_keys("fields")).alias("at", "name")).groupBy("name").agg(F.min(F.struct("source_file", "at")).alias("first"))
    found = [r["name"] for r in named.orderBy("first", "name").limit(MOST_NAMES + 1).collect()]
    if len(found) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} column names")
    filled = rows.where(F.exists(F.map_values("fields"), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    return filled.select("source_file", "row_idx", *[F.col("fields")[n].alias(n) for n in found])

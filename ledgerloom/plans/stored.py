"""Queries that write files made from the given tables and read them again: statements as pages, workbooks, stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..shared import keep, new_path
from ..sources import documents, pages, workbooks
from . import learned, statements

_TEXT_PAGES = 4096  # that a task reads: text is light


def write_pages(cells: DataFrame, path: str) -> None:
    """A text file for each statement, its pages and tables in order, as pages.TextCells reads them."""
    plain = reduce(lambda c, kv: F.transform(c, lambda x: F.replace(x, F.lit(kv[0]), F.lit(kv[1]))), pages.SEPARATORS.items(), F.col("cells"))
    line = F.struct(F.col("row_idx").alias("at"), F.array_join(plain, "\t").alias("value"))
    first = F.struct(F.lit(-1).alias("at"), F.concat(F.when((F.col("page_num") > 0) & (F.col("table_id") == 0), "\f").otherwise(""), F.lit("#"), F.col("table_id").cast("string")).alias("value"))
    rows = cells.select("source_file", "page_num", "table_id", F.inline(F.when(F.col("row_idx") == 0, F.array(first, line)).otherwise(F.array(line))))
    ordered = rows.repartition("source_file").sortWithinPartitions("source_file", "page_num", "table_id", "at")
    ordered.select("source_file", "value").write.partitionBy("source_file").text(path)


def _read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages.register(spark)
    folder = new_path(spark, "statements")
    write_pages(statements.cells(spark, sf_dir), folder)
    spans = pages.find_pages(spark, folder, "*.txt", _TEXT_PAGES)
    read = spark.read.format("statement_pages").options(path=folder, spans=spans, pages_a_task=_TEXT_PAGES).load().where("error is null").drop("error")
    # Written, as the files would be read again for the layouts.
    tables = keep(read.withColumn("page_num", F.col("page_num") - 1), "pages")
    return layout.parse_rows(tables, layout.detect_layout(tables)).select(*statements.ROW)


def _read_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages.register(spark)
    folder = new_path(spark, "workbooks")
    workbooks.write_workbooks(learned.workbook_cells(spark, sf_dir), folder, learned.COLUMNS)
    return spark.read.format("workbooks").load(folder).select("source_file", "sheet", "row", "col", F.coalesce("value", F.lit("<none>")).alias("value"))


def _many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of its own, in three layouts and without one."""
    pages_ = statements.cells(spark, sf_dir).select(F.concat_ws("-", "source_file", F.col("page_num").cast("string")).alias("source_file"), "row_idx", "cells")
    table = documents.common_table(documents.headed_rows(pages_))
    return table.select("source_file", "row_idx", F.col("Description").alias("description"), F.col("`Value Date`").alias("value_date"), F.col("`Statement as of 01-02-2024`").alias("first"), F.col("Col_4").alias("col_4"), F.lit(len(table.columns) - 2).alias("n_columns"))


_MANY_SQL = f"""WITH p AS ({statements.PAGED}), f AS (SELECT *, concat(source_file, '-', page_num) AS file FROM p),
r AS (SELECT file, pos + 2 AS row_idx, CASE WHEN kind IN (1, 2) THEN concat('  ', said, chr(10), ' ', chr(9), 'X') END AS description, CASE WHEN kind IN (1, 2) THEN val END AS value_date, CASE WHEN kind IN (0, 3) THEN day END AS first,
   CASE kind WHEN 0 THEN CASE WHEN is_debit = 1 THEN concat('Rs. ', amount) ELSE '' END WHEN 3 THEN amount END AS col_4 FROM f
 UNION ALL SELECT file, 1, NULL, NULL, 'Date', 'Withdrawal Amt.' FROM f WHERE kind = 0 AND pos = 0)
SELECT file AS source_file, row_idx::INT AS row_idx, description, value_date, first, col_4, 21 AS n_columns FROM r"""


REGISTRY = {
    "f5_u1_many_files": (_many_files, _MANY_SQL),
    "s3_s7_statement_pages": (_read_pages, statements.ROWS_SQL),
    "k1_s8_workbook_files": (_read_workbooks, f"SELECT source_file::VARCHAR AS source_file, sheet, row, col, value FROM ({learned.workbook_sql()})"),
}

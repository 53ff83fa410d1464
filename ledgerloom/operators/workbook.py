"""Workbooks as rows: (source_file, sheet, row, col, span, value, style, align). A writer plug-in only draws them.

A statement's first sheet has a title, a box with two columns of metadata and the ledger; its
second has all metadata. Places follow from the number of columns and of metadata, so no row
waits for another: only the ledger's row numbers need its other rows, sorted by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import row_style

# Texts, styles (fill, font colour, bold, size), widths and alignments of a workbook.
LEDGER, METADATA = "Transactions", "Account_Metadata"
NONE = "—"
TITLE, LEFT_TITLE, RIGHT_TITLE, LEDGER_TITLE = ("🏦  {}  –  ACCOUNT STATEMENT", "👤  PARTY & ACCOUNT DETAILS", "🏦  BANK & STATEMENT DETAILS", "📊  TRANSACTION LEDGER")
STYLES = {
    "title": ("1A3A5C", "FFFFFF", True, 14), "section": ("16283D", "90CDF4", True, 10), "label": ("0D1B2A", "63B3ED", True, 9), "value": ("0D1B2A", "FFFFFF", False, 9),
    "ledger_title": ("0D1B2A", "63B3ED", True, 11), "header": ("1A3A5C", "90CDF4", True, 10), "debit": ("2D1515", "D1E8F5", False, 9), "credit": ("0F2F1A", "D1E8F5", False, 9),
    "even": ("111E2D", "D1E8F5", False, 9), "odd": ("0D1826", "D1E8F5", False, 9), "field_header": ("1A3A5C", "90CDF4", True, 11), "field": ("0D1B2A", "D1E8F5", False, 10),
}
WIDTHS = {
    "No": 8, "Transaction ID": 18, "Txn Posted Date": 24, "Txn Date": 16, "Value Date": 16, "Cheque No": 14, "Description": 48, "Branch Code": 14, "Cr/Dr": 10, "Transaction Amount": 20,
    "Debit": 18, "Credit": 18, "Balance": 20, "Verification Status": 22, "Source File": 28, "Transaction Mode": 20, "Transaction Direction": 18, "Transaction Purpose": 25,
    "Bank / Institution": 25, "Party / Counterparty": 30,
}
FIELD_WIDTHS = (28, 55)
RIGHT = ("Debit", "Credit", "Balance", "Transaction Amount")
CENTRE = ("No", "Cheque No", "Branch Code", "Cr/Dr", "Value Date", "Transaction Direction", "Transaction Mode")
LEFT_BOX = (("Account Holder / Party", "Account Holder"), ("Party Address", "Client Address"), ("Account Number", "Account Number"), ("Customer ID", "Customer ID"), ("Account Type", "Account Type"))
RIGHT_BOX = (("Bank Name", "Bank Name"), ("Branch Name", "Branch Name"), ("IFSC Code", "IFSC Code"), ("MICR Code", "MICR Code"), ("Statement Period", "Statement Period"), ("Opening Balance", "Opening Balance"), ("Closing Balance", "Closing Balance"))
LEFT_MORE, RIGHT_MORE = ("Nominee", "PAN"), ("Interest Rate",)
BOX_TOP, LEAST_COLUMNS = 4, 9


def align(column: str) -> str:
    return "right" if column in RIGHT else "center" if column in CENTRE else "left"


def widths(columns: list[str]) -> dict[str, int]:
    return {c: WIDTHS[c] for c in columns if c in WIDTHS}


def _filled(field: str) -> Column:
    return F.nullif(F.col("fields")[field], F.lit(""))


def _box(items: tuple, more: tuple) -> Column:
    """Label and value pairs; fields in `more` only where they are filled."""

    def value(label: str, field: str) -> Column:
        if label.endswith(" Balance"):
            return F.coalesce(F.concat(F.lit("Rs. "), _filled(field)), F.lit(NONE))
        if label == "Party Address":
            return F.coalesce(_filled(field), F.col("fields")["Address"], F.lit(NONE))
        return F.coalesce(F.col("fields")[field], F.lit(NONE))

    pairs = [F.struct(F.lit(label).alias("label"), value(label, field).alias("value")) for label, field in items]
    pairs += [F.when(_filled(f).isNotNull(), F.struct(F.lit(f).alias("label"), F.col("fields")[f].alias("value"))) for f in more]
    return F.filter(F.array(*pairs), lambda p: p.isNotNull())


def _cell(sheet: str, row: Column, col: int, span: int, value: Column, style: str, at: str) -> Column:
    lit = lambda x, name: F.lit(x).alias(name)
    return F.struct(lit(sheet, "sheet"), row.cast("int").alias("row"), lit(col, "col"), lit(span, "span"), value.cast("string").alias("value"), lit(style, "style"), lit(at, "align"))


def statement_cells(ledger: DataFrame, columns: list[str], order: list[str], metadata: DataFrame) -> DataFrame:
    """Cells of both sheets of each statement.

    `ledger` has source_file, `columns` (`Debit` and `Credit`, if there, decide a row's style) and `order`, which must tell a statement's rows apart;
    `metadata` (source_file, fields map<string, string>) has one row for each statement. One without metadata has its ledger all the
    same, as if its fields were empty, and no second sheet. A missing value is an empty cell (null).
    """
    n = max(len(columns), LEAST_COLUMNS)
    mid = max(4, n // 2)
    files = ledger.select("source_file").distinct().join(metadata.select("source_file", "fields"), "source_file", "full")
    files = files.withColumn("_given", F.coalesce(F.size("fields") > 0, F.lit(False))).withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    files = files.withColumn("_left", _box(LEFT_BOX, LEFT_MORE)).withColumn("_right", _box(RIGHT_BOX, RIGHT_MORE))
    files = files.withColumn("_top", F.greatest(F.size("_left"), F.size("_right")) + BOX_TOP + 2)
    bank = F.upper(F.coalesce(F.col("fields")["Bank Name"], F.lit("BANK STATEMENT")))
    before, after = TITLE.split("{}")
    heads = [
        _cell(LEDGER, F.lit(1), 1, n, F.concat(F.lit(before), bank, F.lit(after)), "title", "center"), _cell(LEDGER, F.lit(3), 1, mid, F.lit(LEFT_TITLE), "section", "left"),
        _cell(LEDGER, F.lit(3), mid + 1, n - mid, F.lit(RIGHT_TITLE), "section", "left"), _cell(LEDGER, F.col("_top") - 1, 1, n, F.lit(LEDGER_TITLE), "ledger_title", "left"),
        *[_cell(LEDGER, F.col("_top"), i, 1, F.lit(c), "header", "center") for i, c in enumerate(columns, 1)],
    ]

    def box(side: str, col: int, span: int) -> Column:
        two = lambda p, i: F.array(_cell(LEDGER, i + BOX_TOP, col, 1, p["label"], "label", "left"), _cell(LEDGER, i + BOX_TOP, col + 1, span, p["value"], "value", "left"))
        return F.flatten(F.transform(side, two))

    pairs = F.array_sort(F.map_entries("fields"))
    fields = F.flatten(F.transform(pairs, lambda e, i: F.array(_cell(METADATA, i + 2, 1, 1, e["key"], "field", "left"), _cell(METADATA, i + 2, 2, 1, e["value"], "field", "left"))))
    names = [_cell(METADATA, F.lit(1), i, 1, F.lit(x), "field_header", "center") for i, x in enumerate(("Metadata Field", "Extracted Value"), 1)]
    second = F.when(F.col("_given"), F.concat(F.array(*names), fields)).otherwise(F.array().cast(_CELLS))
    above = files.select("source_file", F.inline(F.concat(F.array(*heads), box("_left", 1, mid - 1), box("_right", mid + 1, n - mid - 1), second)))
    have = {c.lower() for c in ledger.columns}
    styled = row_style(ledger.withColumns({c: F.lit(None).cast("string") for c in ("Debit", "Credit") if c.lower() not in have}), order, "place")
    # A number for each statement; a statement's rows stay where they are.
    placed = styled.join(F.broadcast(files.select("source_file", "_top")), "source_file")
    each = [F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(align(c)).alias("align")) for i, c in enumerate(columns, 1)]
    rows = placed.select("source_file", (F.col("_top") + F.col("place")).cast("int").alias("row"), F.col("row_style").alias("style"), F.inline(F.array(*each)))
    return above.unionByName(rows.select("source_file", F.lit(LEDGER).alias("sheet"), "row", "col", F.lit(1).alias("span"), "value", "style", "align"))


_CELLS = "array<struct<sheet:string,row:int,col:int,span:int,value:string,style:string,align:string>>"

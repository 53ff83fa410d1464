"""Queries of the layout family: statements are written from `orders`, as cells and as page tokens, and read again.

What a statement must read as is known from the rows it was written from; the SQL says that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..operators.running import numbered

_FREE = 25  # orders of a page

# One row for each order, the same SQL in both engines; a page's layout goes by its number.
PAGED = f"""
SELECT *, CAST(n % {_FREE} AS INT) AS pos, CAST(floor(n / {_FREE}) AS INT) AS page_num, CAST(floor(n / {_FREE}) % 4 AS INT) AS kind,
  CASE WHEN o_orderkey % 9 = 4 THEN '' ELSE concat(substr(iso, 9, 2), '-', substr(iso, 6, 2), '-', substr(iso, 1, 4)) END AS day, concat(substr(iso, 9, 2), '/', substr(iso, 6, 2), '/', substr(iso, 1, 4)) AS val,
  lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '8') AS ref, concat('PAYMENT TO ', CASE o_custkey % 3 WHEN 0 THEN 'SHOP' WHEN 1 THEN 'Mr. Vora' ELSE 'grocer & sons' END) AS said
FROM (
  SELECT o_orderkey, o_custkey, CAST(o_custkey % 10 AS VARCHAR(5)) AS source_file, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1 AS n, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(30)) AS iso,
    CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS VARCHAR(30)) AS amount, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) + 1000 AS VARCHAR(30)) AS balance,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_debit, CASE o_orderkey % 5 WHEN 0 THEN ' cr' WHEN 1 THEN 'DR.' WHEN 2 THEN '' ELSE 'CR' END AS flag
  FROM orders) AS o"""

_HEADS = (
    "Date|Narration|Chq./Ref.No.|Value Dt|Withdrawal Amt.|Deposit Amt.|Closing Balance",
    "No.|Transaction\nID|Value Date|Txn Posted Date|Cheque No.|Description|Cr/Dr|Transaction\nAmount|Available\nBalance",
    "Txn Date|Value Date|Cheque No.|Description|Branch\nCode|Debit|Credit|Balance",
)


_PLACE = "row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey)"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of PAGED. Places in the ten statements are numbered by ranges, so no task holds a statement, over rows written once for all that reads them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus").withColumn("file", F.col("o_custkey") % 10)
    placed = numbered(orders, ["file"], ["o_orderkey"], "place", few=True).drop("file")
    return spark.sql(PAGED.replace(_PLACE, "place").replace("FROM orders)", "FROM {orders})"), orders=placed)


def _rs(number: Column) -> Column:
    return F.concat(F.lit("Rs. "), number)


def _row_cells() -> Column:
    debit, credit = F.when(F.col("is_debit") == 1, _rs(F.col("amount"))).otherwise(""), F.when(F.col("is_debit") == 0, F.col("amount")).otherwise("")
    narrow = F.concat(F.lit("  "), "said", F.lit("\n \tX"))
    kinds = (
        F.array(F.col("day"), narrow, F.col("ref"), F.col("val"), debit, credit, F.col("balance")),
        F.array(F.concat(F.col("pos").cast("string"), F.lit("\nz")), F.concat(F.lit(" S"), "ref"), F.col("val"), F.concat(F.lit(" "), "val"), F.concat("ref", F.lit(" ")), narrow, F.col("flag"), F.col("amount"), _rs(F.col("balance"))),
        F.array(F.col("day"), F.col("val"), F.col("ref"), narrow, F.lit(" 0042"), debit, credit, F.col("balance")),
        F.array(F.col("day"), F.col("said"), F.col("ref"), F.lit("0042"), F.col("amount"), F.col("balance")),
    )
    return F.when(F.col("kind") == 0, kinds[0]).when(F.col("kind") == 1, kinds[1]).when(F.col("kind") == 2, kinds[2]).otherwise(kinds[3])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a page: a title, the header (none for every fourth page), the orders."""
    rows = paged(spark, sf_dir)
    body = rows.select("source_file", "page_num", F.lit(0).alias("table_id"), (F.col("pos") + 2).alias("row_idx"), _row_cells().alias("cells"))
    head = F.split(F.get(F.array(*map(F.lit, _HEADS)), F.col("kind")), r"\|")
    heads = rows.where("pos = 0 and kind < 3").select("source_file", "page_num", F.lit(0).alias("table_id"), F.lit(1).alias("row_idx"), head.alias("cells"))
    titles = rows.where("pos = 0").select("source_file", "page_num", F.lit(0).alias("table_id"), F.lit(0).alias("row_idx"), F.array(F.lit("Statement as of 01-02-2024"), F.lit("1.00")).alias("cells"))
    return body.unionByName(heads).unionByName(titles)


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.detect_layout(cells(spark, sf_dir))
    return found.select("source_file", "page_num", "layout", "header_row", *[F.col("columns")[r].alias(f"{r}_at") for r in ("description", "val_date", "balance")])


ROW = ("source_file", "page_num", "row_idx", "layout", "txn_date", "value_date", "cheque_no", "description", "branch_code", "cr_dr", "debit", "credit", "balance")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = cells(spark, sf_dir)
    return layout.parse_rows(tables, layout.detect_layout(tables)).select(*ROW)


_PAGED = f"WITH p AS ({PAGED})"
_SAID = "concat(said, ' X')"
_DC = "CASE WHEN is_debit = 1 THEN concat('Rs. ', amount) ELSE '' END AS debit, CASE WHEN is_debit = 0 THEN concat('Rs. ', amount) ELSE '' END AS credit, concat('Rs. ', balance) AS balance"
_ROWS_SQL = f"""{_PAGED}, r AS (
SELECT source_file, page_num, CAST(pos + 2 AS INT) AS row_idx, 'schema_hdfc' AS layout, day AS txn_date, val AS value_date, ref AS cheque_no, {_SAID} AS description, '' AS branch_code, NULL AS cr_dr, {_DC} FROM p WHERE kind = 0 AND day <> ''
UNION ALL SELECT source_file, page_num, pos + 2, 'schema_b', val, val, ref, {_SAID}, '', CASE WHEN contains(upper(flag), 'CR') THEN 'CR' ELSE 'DR' END,
  CASE WHEN contains(upper(flag), 'DR') THEN concat('Rs. ', amount) ELSE '' END, CASE WHEN contains(upper(flag), 'CR') THEN concat('Rs. ', amount) ELSE '' END, concat('Rs. ', balance) FROM p WHERE kind = 1 AND flag <> ''
UNION ALL SELECT source_file, page_num, pos + 2, 'schema_a', day, val, ref, {_SAID}, '0042', NULL, {_DC} FROM p WHERE kind = 2 AND day <> '')"""


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = cells(spark, sf_dir)
    plain = tables.join(layout.detect_layout(tables).select("source_file", "page_num", "table_id"), ["source_file", "page_num", "table_id"], "left_anti")
    return layout.parse_free_rows(plain).select("source_file", "page_num", "row_idx", "txn_date", "cheque_no", "branch_code", "description", F.array_join("raw_amounts", "|").alias("amounts"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = cells(spark, sf_dir)
    found = layout.detect_layout(tables)
    rows = layout.parse_rows(tables, found).withColumn("direct", F.lit(True))
    free = layout.parse_free_rows(tables.join(found.select("source_file", "page_num", "table_id"), ["source_file", "page_num", "table_id"], "left_anti"))
    return layout.page_formats(rows.unionByName(free, allowMissingColumns=True))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the third kind as tokens, a little askew, without table or cell; empty cells have none."""
    rows = paged(spark, sf_dir).where("kind = 2")
    body = rows.select("source_file", "page_num", (F.col("pos") + 1).alias("line"), F.col("o_orderkey").alias("k"), F.posexplode(_row_cells()).alias("i", "text"))
    heads = rows.where("pos = 0").select("source_file", "page_num", F.lit(0).alias("line"), F.lit(0).cast("long").alias("k"), F.posexplode(F.split(F.lit(_HEADS[2]), r"\|")).alias("i", "text"))
    x = 100.0 * F.col("i") + (F.col("k") + F.col("i")) % 23
    y = 40.0 * F.col("line") + (F.col("k") + 3 * F.col("i")) % 7
    return body.unionByName(heads).where("text <> ''").select("source_file", "page_num", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 9).alias("y1"), "text", F.lit(1.0).alias("score"))


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rows_by_header(_tokens(spark, sf_dir)).select(*[c for c in ROW if c != "layout"])


def _borderless_words(orders: DataFrame) -> DataFrame:
    """Two lines for an order: date, words and amounts; every third has its last word on a line of its own."""
    word = lambda x, text, down=0.0: F.struct(F.lit(float(x)).alias("x0"), F.lit(down).alias("down"), text.alias("text"))
    side = F.when(F.col("is_debit") == 1, F.lit(410.0)).otherwise(F.lit(490.0))
    more = F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit(80.0).alias("x0"), F.lit(10.0).alias("down"), F.lit("more").alias("text")))
    amount = F.struct(side.alias("x0"), F.lit(1.0).alias("down"), F.col("amount").alias("text"))
    words = F.array(word(40, F.col("val")), word(70, F.lit("UPI")), word(120, F.col("ref")), word(290, F.lit("77")), word(360, F.col("val")), amount, word(560, F.col("balance"), 2.0), more)
    rows = orders.select("source_file", "page_num", "pos", F.inline(F.filter(words, lambda w: w.isNotNull())))
    y = 230.0 + 20 * F.col("pos") + F.col("down")
    return rows.select("source_file", "page_num", "x0", y.alias("y0"), (F.col("x0") + 30).alias("x1"), (y + 6).alias("y1"), "text", F.lit(1.0).alias("score"))


def _borderless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.parse_borderless(_borderless_words(paged(spark, sf_dir))).drop("direct")


# What a page of the chain offers, by its number: a table with a layout (of whose rows the first so many are there), a free table (so many), words (so many), a hint.
_A, _B, _HDFC = 2, 1, 0
_OFFERS = (
    (_A, 25, 0, 25, True), (_A, 25, 0, 0, True), (_HDFC, 25, 0, 25, False), (_HDFC, 25, 0, 0, False), (_B, 12, 13, 0, False), (_A, 1, 0, 3, False), (_A, 1, 1, 3, False),
    (_A, 0, 0, 25, False), (_A, 0, 1, 1, False), (_A, 0, 1, 2, False), (_B, 2, 0, 25, False), (_HDFC, 0, 2, 3, False), (_A, 0, 0, 0, True),
)
_PATHS = ("layout", "free", "borderless")


def _offer(i: int) -> Column:
    return F.get(F.array(*[F.lit(o[i]) for o in _OFFERS]), F.col("page_num") % len(_OFFERS))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, tokens, texts) of pages that offer as said: the tables stand one under the other, the words are those of the borderless layout."""
    rows = paged(spark, sf_dir).withColumn("kind", _offer(0)).withColumns({"n_laid": _offer(1), "n_free": _offer(2), "n_words": _offer(3), "hinted": _offer(4)})
    page = ["source_file", "page_num"]
    laid = rows.where("pos < n_laid").select(*page, F.lit(0).alias("table_id"), (F.col("pos") + 1).alias("row_idx"), _row_cells().alias("cells"))
    free = rows.where("pos >= n_laid and pos < n_laid + n_free").withColumn("kind", F.lit(3)).select(*page, F.lit(1).alias("table_id"), F.col("pos").alias("row_idx"), _row_cells().alias("cells"))
    head = F.split(F.get(F.array(*map(F.lit, _HEADS)), F.col("kind")), r"\|")
    heads = rows.where("pos = 0 and (n_laid > 0 or kind = 0)").select(*page, F.lit(0).alias("table_id"), F.lit(0).alias("row_idx"), head.alias("cells"))
    words = _borderless_words(rows.where("pos < n_words"))
    texts = rows.where("pos = 0").select(*page, F.when(F.col("hinted"), "Date Narration Withdrawal Amt.").otherwise("Narration").alias("text"))
    return laid.unionByName(free).unionByName(heads), words, texts


_CHAINED = ("source_file", "page_num", "path", "row_idx", "txn_date", "description", "debit", "balance")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.digital_rows(*_pages(spark, sf_dir)).select(*_CHAINED)


def _chain_sql() -> str:
    """Every parser's rows of a page, counted, and the chain's choice between them."""
    offers = ", ".join(f"({i}, {k}, {a}, {f}, {w}, {str(h).lower()})" for i, (k, a, f, w, h) in enumerate(_OFFERS))
    rs = "concat('Rs. ', {})".format
    owed = f"CASE WHEN is_debit = 1 THEN {rs('amount')} ELSE '' END"
    return f"""{_PAGED}, o(i, of, n_laid, n_free, n_words, hinted) AS (VALUES {offers}), q AS (SELECT * FROM p JOIN o ON page_num % {len(_OFFERS)} = i),
c AS (SELECT source_file, page_num, 'layout' AS path, pos + 1 AS row_idx, CASE of WHEN {_B} THEN val ELSE day END AS txn_date, {_SAID} AS description,
   CASE WHEN of = {_B} THEN CASE WHEN contains(upper(flag), 'DR') THEN {rs('amount')} ELSE '' END ELSE {owed} END AS debit, {rs('balance')} AS balance FROM q
   WHERE pos < n_laid AND CASE of WHEN {_B} THEN flag <> '' ELSE day <> '' END
 UNION ALL SELECT source_file, page_num, 'free', pos, day, said, NULL, NULL FROM q WHERE pos >= n_laid AND pos < n_laid + n_free AND day <> ''
 UNION ALL SELECT source_file, page_num, 'borderless', pos + 1, val, concat('UPI ', ref, CASE WHEN o_orderkey % 3 = 0 THEN ' more' ELSE '' END), {owed}, {rs('balance')} FROM q WHERE pos < n_words),
n AS (SELECT source_file, page_num, sum((path = 'borderless')::INT) AS b, sum((path <> 'borderless')::INT) AS other FROM c GROUP BY ALL),
w AS (SELECT source_file, page_num, CASE WHEN (hinted OR of = {_HDFC}) AND b > 0 THEN true WHEN other <= 1 AND b > other THEN true ELSE false END AS words FROM n JOIN o ON page_num % {len(_OFFERS)} = i)
SELECT source_file, page_num, path, row_idx::INT AS row_idx, txn_date, description, debit, balance FROM c JOIN w USING (source_file, page_num) WHERE (path = 'borderless') = words"""


def _scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as recognised tokens, a little askew: a fourth has no header, and of the others a third have rows without columns."""
    rows = paged(spark, sf_dir).withColumn("day", F.expr("CASE WHEN kind < 3 THEN val ELSE day END")).withColumn("flag", F.expr("CASE WHEN flag = '' THEN 'CR' ELSE flag END"))
    loose = F.array(F.col("val"), F.concat_ws(" ", "said", "ref", F.lit("0042"), "amount"))
    cells = F.when((F.col("page_num") % 3 == 0) & (F.col("kind") < 3), loose).otherwise(_row_cells())
    body = rows.select("source_file", "page_num", (F.col("pos") + 1).alias("line"), F.col("o_orderkey").alias("k"), F.posexplode(cells).alias("i", "text"))
    head = F.split(F.get(F.array(*map(F.lit, _HEADS)), F.col("kind")), r"\|")
    heads = rows.where("pos = 0 and kind < 3").select("source_file", "page_num", F.lit(0).alias("line"), F.lit(0).cast("long").alias("k"), F.posexplode(head).alias("i", "text"))
    x = 100.0 * F.col("i") + (F.col("k") + F.col("i")) % 23
    y = 40.0 * F.col("line") + (F.col("k") + 3 * F.col("i")) % 7
    return body.unionByName(heads).where("text <> ''").select("source_file", "page_num", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 9).alias("y1"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), F.lit(1.0).alias("score"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.scanned_rows(_scan_tokens(spark, sf_dir)).select("source_file", "page_num", "path", "row_idx", "txn_date", "cheque_no", "description", F.array_join("raw_amounts", "|").alias("amounts"))


_FIELDS = ("Bank Name", "Account Holder", "Client Address", "Customer ID", "IFSC Code", "MICR Code", "Account Number", "Opening Balance", "Email")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(
        F.lit("Some Cooperative\nAccount Statement\nA. Person "), "ref", F.lit("\n1 Road\nCustomer ID: C"), "ref", F.lit("\nIFSC Code: ZZZZ0"), F.substring("ref", 1, 6), F.lit("\nMICR Code: "), "ref",
        F.lit("\nAccount Number: "), "ref", F.lit("\nOpening Balance: Rs. "), "amount", F.lit("\nEmail ID: u"), "ref", F.lit("@example.com\n"),
    )
    return paged(spark, sf_dir).select("o_orderkey", layout.metadata(page).alias("m")).select("o_orderkey", *[F.col("m")[f].alias(f.lower().replace(" ", "_")) for f in _FIELDS])


# Every field, as a page says it and as it must be read; what a field's letters allow decides.
_ALL_FIELDS = (
    ("Customer ID", "Cust ID. ", "concat('CU', ref)"), ("Branch Name", "Branch Name: ", "concat('Fort ', CASE o_custkey % 3 WHEN 0 THEN 'St. Mary-le-Bow' ELSE 'East' END)"), ("Branch Code", "Branch Code: ", "substr(ref, 1, 4)"),
    ("IFSC Code", "RTGS/NEFT IFSC: ", "concat('ABCD0', substr(ref, 1, 6))"), ("MICR Code", "MICR. ", "ref"), ("Account Number", "Account A/C No: ", "concat(ref, '123')"), ("Account Type", "Product Name: ", "'Savings (A/C)'"),
    ("Account Currency", "Currency: ", "'INR'"), ("Interest Rate", "Interest Rate: ", "concat(CAST(o_custkey % 7 AS VARCHAR(5)), '.50 % p.a.')"), ("Statement Period", "Statement From: from ", "concat(val, ' to ', val)"), ("Opening Balance", "Opening Balance: Rs. ", "amount"),
    ("Closing Balance", "Closing Balance: ", "balance"), ("Email", "Email: ", "concat('a.b+c-', ref, '@mail.example.org')"), ("Mobile", "Phone: ", "concat('+91 ', ref, '0')"), ("PAN", "Tax no ", "concat('ABCDE', substr(ref, 1, 4), 'Z')"),
)


def _all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scanned first page with all fields, a second one that isn't looked at; every eleventh statement has nothing on its first page."""
    lines = F.concat_ws("\n", F.lit("Bank of Nowhere"), *[F.concat(F.lit(label), F.expr(value)) for _, label, value in _ALL_FIELDS])
    rows = paged(spark, sf_dir)
    page = lambda n, text, layer: F.struct(F.lit(n).alias("page_num"), text.alias("text"), F.lit(layer).alias("layer"))
    pages = rows.select(F.col("o_orderkey").cast("string").alias("source_file"), F.inline(F.array(page(1, F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(lines), "scanned"), page(2, F.lit("IFSC: ZZZZ0ZZZZZZ"), "digital"))))
    found = layout.metadata_text(pages).select(F.col("source_file").cast("long").alias("o_orderkey"), layout.metadata(F.col("text")).alias("m"))
    return found.select("o_orderkey", F.size("m").alias("n_fields"), *[F.col("m")[f].alias(_column(f)) for f, *_ in _ALL_FIELDS])


def _column(field: str) -> str:
    return field.lower().replace(" ", "_")


_ALL_FIELDS_SQL = f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE {len(_ALL_FIELDS) + 1} END AS n_fields, " + ", ".join(f"CASE WHEN o_orderkey % 11 > 0 THEN {value} END AS {_column(f)}" for f, _, value in _ALL_FIELDS) + " FROM p"


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's rows, bank and holder; the fields are on its first two pages."""
    rows = paged(spark, sf_dir)
    title = F.when(F.col("page_num") == 0, F.concat(F.lit("Metropolitan Bank\nAccount Statement\nA. Person "), "ref", F.lit("\n1 Road"))).otherwise(F.concat(F.lit("Page "), F.col("page_num").cast("string")))
    pages = rows.where("pos = 0").select("source_file", (F.col("page_num") + 1).alias("page_num"), title.alias("text"), F.lit("digital").alias("layer"))
    fields = layout.metadata_text(pages).select("source_file", layout.metadata(F.col("text")).alias("m"))
    tables = cells(spark, sf_dir)
    counted = layout.parse_rows(tables, layout.detect_layout(tables)).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    return fields.join(counted, "source_file", "left").select("source_file", F.coalesce("n", F.lit(0)).alias("n"), F.col("m")["Bank Name"].alias("bank"), F.col("m")["Account Holder"].alias("holder"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = paged(spark, sf_dir).select(F.col("o_orderkey").alias("file_idx"), F.concat(F.lit("field "), (F.col("o_custkey") % 7).cast("string")).alias("field"), F.col("ref").alias("value"))
    return layout.merge_metadata(per_file)


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(F.when(F.col("day") != "", F.col("day")).otherwise("none"), F.col("said"), F.col("amount"), F.col("balance"))
    rows = paged(spark, sf_dir).select("source_file", "page_num", F.col("pos").alias("line_no"), F.posexplode(F.slice(texts, F.lit(1), (2 + F.col("o_orderkey") % 3).cast("int"))).alias("i", "text"), "o_orderkey")
    tokens = rows.select("source_file", "page_num", "line_no", (F.col("i") * 10).alias("x0"), "text", ((F.col("o_orderkey") % 8 + F.col("i")) / 16).alias("score"))
    return layout.recognised_rows(tokens).select("source_file", "page_num", "line_no", F.array_join("cells", "|").alias("cells"), "confidence")


_LINES = "concat(CASE o_orderkey % 6 WHEN 0 THEN 'Statement OF Account ' WHEN 1 THEN 'Customer ID ' WHEN 2 THEN 'MICR Code' WHEN 3 THEN 'Value  date' ELSE '' END, said)"


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("o_orderkey", F.expr(_LINES).alias("line")).where(~layout.is_noise(F.col("line")))


ROWS_SQL = f"{_ROWS_SQL} SELECT * FROM r"

REGISTRY = {
    "p1_p2_layouts": (
        _layouts,
        f"{_PAGED} SELECT source_file, page_num, CASE kind WHEN 0 THEN 'schema_hdfc' WHEN 1 THEN 'schema_b' ELSE 'schema_a' END AS layout, 1 AS header_row, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 3 END AS description_at, CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS val_date_at, CASE kind WHEN 0 THEN 6 WHEN 1 THEN 8 ELSE 7 END AS balance_at FROM p WHERE pos = 0 AND kind < 3",
    ),
    "p3_p6_direct_rows": (_rows, ROWS_SQL),
    "p7_free_rows": (_free, f"{_PAGED} SELECT source_file, page_num, CAST(pos + 2 AS INT) AS row_idx, day AS txn_date, ref AS cheque_no, '0042' AS branch_code, said AS description, concat(amount, '|', balance) AS amounts FROM p WHERE kind = 3 AND day <> ''"),
    "p8_p9_token_rows": (
        _token_rows,
        f"{_PAGED} SELECT source_file, page_num, CAST(pos + 1 AS INT) AS row_idx, day AS txn_date, val AS value_date, ref AS cheque_no, {_SAID} AS description, '0042' AS branch_code, NULL AS cr_dr, {_DC} FROM p WHERE kind = 2 AND day <> ''",
    ),
    "p10_p11_borderless_rows": (
        _borderless,
        f"{_PAGED} SELECT source_file, page_num, CAST(pos + 1 AS INT) AS row_idx, val AS txn_date, val AS value_date, '77' AS cheque_no, concat('UPI ', ref, CASE WHEN o_orderkey % 3 = 0 THEN ' more' ELSE '' END) AS description, {_DC} FROM p",
    ),
    "p12_chain": (_chain, _chain_sql()),
    "p7_scanned_rows": (
        _scanned,
        f"""{_PAGED} SELECT source_file, page_num, 'layout' AS path, (pos + 1)::INT AS row_idx, val AS txn_date, ref AS cheque_no, {_SAID} AS description, NULL AS amounts FROM p WHERE kind < 3 AND page_num % 3 <> 0
UNION ALL SELECT source_file, page_num, 'free', pos + 1, val, ref, said, amount FROM p WHERE kind < 3 AND page_num % 3 = 0
UNION ALL SELECT source_file, page_num, 'free', CASE WHEN kind = 3 THEN pos ELSE pos + 1 END, day, ref, said, concat(amount, '|', balance) FROM p WHERE kind = 3 AND day <> ''""",
    ),
    "p13_page_formats": (
        _labels,
        f"""{_ROWS_SQL} SELECT source_file, page_num, CASE min(layout) WHEN 'schema_hdfc' THEN 'Schema HDFC – Withdrawal / Deposit' WHEN 'schema_b' THEN 'Format B – Cr/Dr Flag' ELSE 'Format A – Standard' END AS format FROM r GROUP BY ALL
UNION ALL SELECT DISTINCT source_file, page_num, 'Fallback (Math Engine)' FROM p WHERE kind = 3 AND day <> ''""",
    ),
    "p14_p16_metadata": (
        _metadata,
        f"{_PAGED} SELECT o_orderkey, 'Some Cooperative' AS bank_name, concat('A. Person ', ref) AS account_holder, '1 Road' AS client_address, concat('C', ref) AS customer_id, concat('ZZZZ0', substr(ref, 1, 6)) AS ifsc_code, ref AS micr_code, ref AS account_number, amount AS opening_balance, concat('u', ref, '@example.com') AS email FROM p",
    ),
    "p15_all_fields": (_all_fields, f"{_PAGED} {_ALL_FIELDS_SQL}"),
    "a8_statement_overview": (_overview, f"{_ROWS_SQL}, c AS (SELECT source_file, count(*) AS k FROM r GROUP BY source_file) SELECT source_file, coalesce(k, 0) AS n, 'Metropolitan Bank' AS bank, concat('A. Person ', ref) AS holder FROM p LEFT JOIN c USING (source_file) WHERE pos = 0 AND page_num = 0"),
    "p17_merged_metadata": (_merged, f"{_PAGED} SELECT concat('field ', CAST(o_custkey % 7 AS VARCHAR)) AS field, arg_max(ref, o_orderkey) AS value FROM p GROUP BY ALL"),
    "p19_recognised_rows": (
        _recognised,
        f"""{_PAGED} SELECT source_file, page_num, pos AS line_no, concat(day, '|', said, '|', amount, CASE WHEN o_orderkey % 3 = 2 THEN concat('|', balance) ELSE '' END) AS cells,
round((o_orderkey % 8 + CASE WHEN o_orderkey % 3 = 2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) / 16, 4) AS confidence FROM p WHERE day <> '' AND o_orderkey % 3 > 0""",
    ),
    "f12_line_noise": (_noise, f"{_PAGED} SELECT o_orderkey, {_LINES} AS line FROM p WHERE o_orderkey % 6 IN (3, 4, 5)"),
}

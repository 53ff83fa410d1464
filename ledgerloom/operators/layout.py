"""Layout detection and row parsing of table cells and page tokens, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import BANKS, LAYOUTS, METADATA
from ..functions.text import AMOUNT, DATE, VALUE_DATE, collapse, rupees, strip, u

HEADER_ROWS = 8
SCANNED_CHARS = 80


def page_layer(text: Column) -> Column:
    return F.when(F.length(strip(text)) < SCANNED_CHARS, "scanned").otherwise("digital")


def detect_layout(cells: DataFrame) -> DataFrame:
    """(source_file, page_num, table_id, layout, header_row, columns) of each table (…, row_idx, cells): the first of its first eight rows that any layout fits."""
    rows = cells.where(F.col("row_idx") < HEADER_ROWS).withColumn("_c", _lower("cells"))
    rows = rows.withColumn("_n", _fit(F.col("_c"))).where("_n is not null")
    first = rows.groupBy("source_file", "page_num", "table_id").agg(F.min_by(F.struct("row_idx", "_n", "_c"), "row_idx").alias("h"))
    return first.select("source_file", "page_num", "table_id", _layout_name(F.col("h._n")).alias("layout"), F.col("h.row_idx").alias("header_row"), F.map_from_entries(_columns(F.col("h._n"), F.col("h._c"))).alias("columns"))


def _lower(cells: Column | str) -> Column:
    return F.transform(cells, lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))


def _any(cell: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(cell, F.lit(w))
    return out


def _holds(words: list[str]) -> Callable[[Column], Column]:
    return lambda c: _any(c, words)


def _all_groups(cells: Column, groups: list[list[str]]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.exists(cells, _holds(g))
    return out


def _fit(lower: Column) -> Column:
    """The number of the first layout that a row's lower-cased cells fit; null if none."""
    return F.coalesce(*[F.when(_all_groups(lower, groups), F.lit(i)) for i, (_, groups, _) in enumerate(LAYOUTS)])


def _layout_name(n: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name, *_ in LAYOUTS]), n)


def _columns(n: Column, lower: Column) -> Column:
    """(key, value) of each role that a header's cells have: its name and the cell's place, in the layout's order."""
    out = F.lit(None).cast("array<struct<key:string,value:int>>")
    for i, (_, _, roles) in enumerate(LAYOUTS):
        places = F.array(*[F.struct(F.lit(r).alias("key"), (F.array_position(F.transform(lower, _holds(k)), True) - 1).cast("int").alias("value")) for r, k in roles.items()])
        out = F.when(n == i, F.filter(places, lambda x: x["value"] >= 0)).otherwise(out)
    return out


def cell(role: str) -> Column:
    """The row's cell in a role; empty where missing or beyond the row."""
    return F.coalesce(F.get("cells", F.col("columns")[role]), F.lit(""))


def first_amount(text: Column) -> Column:
    return F.regexp_extract(text, AMOUNT, 1)


def _read(at: Callable[[str], Column]) -> dict[str, Column]:
    """What is looked for in a row's cells, given by role."""
    found = {"flag": F.upper(F.btrim(at("cr_dr_flag"))), "date": F.regexp_extract(at("txn_date"), DATE, 1), "value": F.regexp_extract(at("val_date"), DATE, 1)}
    return found | {role: first_amount(at(role)) for role in ("amount", "debit", "credit", "balance")}


def _entry(at: Callable[[str], Column], read: Callable[[str], Column], flagged: Column) -> dict[str, Column]:
    """A ledger row's fields: separate debit and credit columns, or one amount with a flag."""
    is_cr, is_dr = F.contains(read("flag"), F.lit("CR")), F.contains(read("flag"), F.lit("DR"))
    posted = F.coalesce(F.nullif(at("posted_date"), F.lit("")), at("txn_date"))
    side = lambda mine, role: F.when(flagged, F.when(mine, rupees(read("amount"))).otherwise("")).otherwise(rupees(read(role)))
    only = lambda c: F.when(flagged, c)
    return {
        "no": only(F.btrim(F.substring_index(at("serial"), "\n", 1))), "transaction_id": only(F.btrim(at("txn_id"))),
        "txn_date": F.when(flagged, strip(F.replace(posted, F.lit("\n"), F.lit(" ")))).otherwise(read("date")),
        "value_date": F.when(flagged & (read("value") == ""), strip(F.replace(at("val_date"), F.lit("\n"), F.lit(" ")))).otherwise(read("value")),
        "cheque_no": strip(at("cheque")), "description": collapse(at("description")), "branch_code": F.when(flagged, "").otherwise(strip(at("branch"))),
        "cr_dr": only(F.when(is_cr, "CR").otherwise("DR")), "amount": only(rupees(read("amount"))), "debit": side(is_dr, "debit"), "credit": side(is_cr, "credit"), "balance": rupees(read("balance")),
    }


def _named(fields: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in fields.items()]


def _is_entry(read: Callable[[str], Column], flagged: Column) -> Column:
    told = (read("amount") != "") & (F.contains(read("flag"), F.lit("CR")) | F.contains(read("flag"), F.lit("DR")))
    return F.when(flagged, told).otherwise((read("date") != "") & (F.concat(read("debit"), read("credit"), read("balance")) != ""))


def parse_rows(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """Ledger rows of tables with a layout: separate debit and credit columns, or one amount with a flag."""
    rows = cells.join(layouts, ["source_file", "page_num", "table_id"]).where("row_idx > header_row")
    read, flagged = _read(cell), F.col("layout") == "schema_b"
    return rows.where(_is_entry(read.get, flagged)).select("source_file", "page_num", "table_id", "row_idx", "layout", *_named(_entry(cell, read.get, flagged)))


def _without_first(text: Column, piece: Column) -> Column:
    """A text without the first place of a piece that it has."""
    return F.overlay(text, F.lit(""), F.instr(text, piece), F.length(piece))


def _joined(cells: Column | str) -> Column:
    return F.array_join(F.filter(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")


def _line_marks() -> dict[str, Column]:
    """What makes a line a transaction: its date and amounts; null without a line."""
    return {"txn_date": F.regexp_extract("line", DATE, 1), "value_date": F.regexp_extract("line", u(VALUE_DATE), 1), "raw_amounts": F.regexp_extract_all("line", F.lit(AMOUNT), F.lit(1))}


def _is_line_entry() -> Column:
    return (F.col("txn_date") != "") & ~F.contains(F.lower("line"), F.lit("statement as of")) & (F.size("raw_amounts") > 0)


def _line_rest(rows: DataFrame) -> DataFrame:
    """Cheque and branch numbers and the description; what is found is taken out of the line before the next is looked for."""
    rows = rows.withColumn("w", _without_first(F.col("line"), F.col("txn_date")))
    # The value date's pattern is looked for once more in what is left.
    rows = rows.withColumn("w", F.when(F.col("value_date") != "", _without_first(F.col("w"), F.regexp_extract("w", u(VALUE_DATE), 1))).otherwise(F.col("w")))
    number = F.regexp_extract("w", r"\b(\d{6,16})\b", 1)
    rows = rows.withColumn("cheque_no", F.when(F.instr("w", number) < F.instr("w", F.col("raw_amounts")[0]), number).otherwise("")).withColumn("w", _without_first(F.col("w"), F.col("cheque_no")))
    rows = rows.withColumn("branch_code", F.regexp_extract("w", r"\b(\d{4})\b", 1)).withColumn("w", _without_first(F.col("w"), F.col("branch_code")))
    return rows.withColumn("description", strip(F.regexp_replace(F.regexp_replace("w", AMOUNT, ""), r"[|\s]+", " "))).drop("w", "line")


def parse_free_rows(cells: DataFrame) -> DataFrame:
    """Ledger rows of tables without a layout: date, amounts, cheque and branch numbers are picked out of the joined line."""
    rows = cells.withColumn("line", _joined("cells"))
    for name, mark in _line_marks().items():
        rows = rows.withColumn(name, mark)
    return _line_rest(rows.where(_is_line_entry())).drop("cells").withColumn("direct", F.lit(False))


def _paged(tokens: DataFrame, top: float = float("-inf"), bottom: float = float("inf")) -> DataFrame:
    """(source_file, page_num, ws): a page's words by height."""
    word = F.struct(F.col("y0").alias("y"), F.col("x0").alias("x"), F.col("x1").alias("x1"), F.col("text").alias("text"))
    return tokens.where(F.col("y0").between(top, bottom)).groupBy("source_file", "page_num").agg(F.sort_array(F.collect_list(word)).alias("ws"))


def _lines(tolerance: float) -> Column:
    """Of a page's words its lines, an array of words each: grouped by height with a running mean, each line from left to right.

    One page is one fold: its tokens are few, however many pages there are.
    """
    # The fold only finds where lines begin; each line is then one slice.
    joins = lambda acc, w: acc["at"].isNotNull() & (F.abs(w["y"] - acc["at"]) < tolerance)
    fold = F.aggregate(
        "ws",
        F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts")),
        lambda acc, w: F.struct(
            F.when(joins(acc, w), (acc["at"] + w["y"]) / 2).otherwise(w["y"]).alias("at"), (acc["n"] + 1).alias("n"),
            F.when(joins(acc, w), acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["n"] + 1))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    by_x = lambda ws: F.sort_array(F.transform(ws, lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y"), w["x1"].alias("x1"), w["text"].alias("text"))))
    cut = lambda starts: F.transform(starts, lambda at, i: by_x(F.slice("ws", at, F.coalesce(F.get(starts, i + 1), F.size("ws") + 1) - at)))
    return _let(fold, cut)


def group_lines(tokens: DataFrame, tolerance: float, top: float = float("-inf"), bottom: float = float("inf")) -> DataFrame:
    """(source_file, page_num, line_no, words): tokens grouped by height with a running mean, each line from left to right."""
    # Exploded as a column, lines would be found once more for a filter on its size.
    return _paged(tokens, top, bottom).select("source_file", "page_num", F.posexplode(_lines(tolerance)).alias("line_no", "words"))


_ROLES = tuple(dict.fromkeys(role for *_, roles in LAYOUTS for role in roles))


def _header(lines: Column) -> Column:
    """Of a page's lines the first of eight that any layout fits: its number (row), the layout (n), the roles' centres by rank, and the rank whose words a role's cell holds.

    Two roles of one header word: the first takes the words, the last fills the cell.
    """
    seen = F.transform(F.slice(lines, 1, HEADER_ROWS), lambda words, i: _let(_lower(words["text"]), lambda c: F.struct(_fit(c).alias("n"), i.alias("row"), words.alias("words"), c.alias("c"))))
    centre = lambda word: (word["x"] + word["x1"]) / 2

    def ranks(by: Column, role: str) -> Column:
        at = F.get(F.filter(by, lambda e: e["key"] == role)["value"], F.lit(0))
        return _let(at, lambda a: F.array_max(F.transform(by, lambda e, rank: F.when(e["value"] == a, rank))))

    def told(h: Column, by: Column) -> Column:
        centres = F.transform(by, lambda e: centre(F.get(h["words"], e["value"])))
        return F.struct(h["row"].alias("row"), h["n"].alias("n"), centres.alias("centres"), F.struct(*[ranks(by, r).alias(r) for r in _ROLES]).alias("ranks"))

    first = F.slice(F.filter(seen, lambda h: h["n"].isNotNull()), 1, 1)
    return F.get(F.transform(first, lambda h: _let(_columns(h["n"], h["c"]), lambda by: told(h, by))), F.lit(0))


def nearest(centres: Column, cx: Column) -> Column:
    """The rank, from 0, of the nearest centre; ties to the first in order, and what isn't known is nearest."""
    far = F.transform(centres, lambda c: F.coalesce(F.abs(c - cx), F.lit(float("-inf"))))
    return _let(far, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _headed(tokens: DataFrame, tolerance: float) -> DataFrame:
    """(source_file, page_num, ls, head): pages with their lines and header, null if none."""
    return _paged(tokens).select("source_file", "page_num", _lines(tolerance).alias("ls")).withColumn("head", _header(F.col("ls")))


def _under_header() -> Column:
    """Each line below a page's header as cells by role: the words whose nearest header word is the role's."""
    head = F.col("head")

    def by_role(words: Column) -> Column:
        mine = F.transform(words, lambda w: nearest(head["centres"], (w["x"] + w["x1"]) / 2))
        cells = lambda ranks: F.transform(head["centres"], lambda _, rank: F.array_join(F.filter(words["text"], lambda t, i: F.get(ranks, i) == rank), " "))
        return _let(_let(mine, cells), lambda found: F.struct(*[F.coalesce(F.get(found, head["ranks"][role]), F.lit("")).alias(role) for role in _ROLES]))

    return F.transform(F.slice("ls", head["row"] + 2, F.size("ls")), by_role)


def rows_by_header(tokens: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """Ledger rows of pages of tokens, as parse_rows gives them: a page's lines, each word under the role of the nearest header word.

    Pages without a header line in their first eight have no rows. A page is one row from its words on, so words are shuffled once and lines are found once.
    """
    cells = F.transform(_under_header(), lambda at, i: F.struct((F.col("head.row") + 1 + i).alias("row_idx"), *[at[role].alias(f"at_{role}") for role in _ROLES]))
    rows = _headed(tokens, tolerance).select("source_file", "page_num", F.col("head.n").alias("n"), F.inline(cells))
    at, layout = lambda role: F.col(f"at_{role}"), _layout_name(F.col("n"))
    read, flagged = _read(at), layout == "schema_b"
    return rows.where(_is_entry(read.get, flagged)).select("source_file", "page_num", F.lit(0).alias("table_id"), "row_idx", layout.alias("layout"), *_named(_entry(at, read.get, flagged)))


# Lines that are no transactions, and the slots of the borderless layout.
_FURNITURE = r"Date Narration|Closing Balance|HDFC BANK LIMITED|\*Closing balance|Contents of this statement|Registered Office|STATEMENT SUMMARY"
_SLOTS = {"description": (65, 280), "cheque_no": (280, 355), "value_date": (355, 400), "debit": (400, 480), "credit": (480, 550), "balance": (550, 640)}


def parse_borderless(tokens: DataFrame) -> DataFrame:
    """Ledger rows from word positions; lines that don't begin with a date continue the open transaction of their page."""
    lines = group_lines(tokens, 6.0, 225.0, 775.0).where(~F.array_join(F.col("words.text"), " ").rlike(_FURNITURE))
    first = F.col("words")[0]
    lines = lines.withColumn("starts", (first["x"] < 65) & first["text"].rlike(DATE))
    lines = lines.withColumn("gid", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("source_file", "page_num").orderBy("line_no"))).where("gid > 0")
    rest = F.when(F.col("starts"), F.slice("words", F.lit(2), F.size("words"))).otherwise(F.col("words"))
    lines = lines.withColumn("rest", rest)
    whole = r"^(?:Rs\.?\s*)?(\d{1,3}(?:,\d{2,3})*\.\d{2}|\d+\.\d{2})$"

    def slot(name: str) -> Column:
        lo, hi = _SLOTS[name]
        keep = lambda w: (w["x"] >= lo) & (w["x"] < hi)
        if name in ("debit", "credit", "balance"):
            return F.transform(F.filter("rest", lambda w: keep(w) & F.btrim(w["text"]).rlike(whole)), lambda w: w["text"])
        if name == "description":
            return F.transform(F.filter("rest", lambda w: keep(w) | (~F.col("starts") & (w["x"] < 65) & ~w["text"].rlike(DATE))), lambda w: w["text"])
        return F.transform(F.filter("rest", keep), lambda w: w["text"])

    last = lambda a: F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(""))
    parts = lines.select(
        "source_file", "page_num", "gid", "line_no", "starts", F.array_join(slot("description"), " ").alias("d"),
        F.struct(first["text"].alias("txn_date"), last(slot("value_date")).alias("value_date"), F.array_join(slot("cheque_no"), " ").alias("cheque_no"), *[rupees(last(slot(s))).alias(s) for s in ("debit", "credit", "balance")]).alias("head"),
    )
    said = F.array_sort(F.collect_list(F.when(F.col("starts") | (F.col("d") != ""), F.struct("line_no", "d"))))
    grouped = parts.groupBy("source_file", "page_num", "gid").agg(F.first("head", ignorenulls=True).alias("_any"), F.min_by("head", "line_no").alias("h"), F.array_join(F.transform(said, lambda x: x["d"]), " ").alias("description"))
    return grouped.select("source_file", "page_num", F.col("gid").cast("int").alias("row_idx"), "h.txn_date", "h.value_date", "h.cheque_no", "description", "h.debit", "h.credit", "h.balance", F.lit(True).alias("direct"))


def borderless_hint(text: Column) -> Column:
    """A page's text that sends it straight to the word parser."""
    text = F.lower(text)
    return F.contains(text, F.lit("narration")) & (F.contains(text, F.lit("withdrawal amt")) | F.contains(text, F.lit("deposit amt")))


def choose_rows(found: DataFrame) -> DataFrame:
    """Of a page's candidates (path: `layout`, `free`, `borderless`; optionally `hint` and `hdfc`, true for a page if true in any row) those of the chain.

    Borderless ones, if any, where the page's text hints at them or a table has the HDFC layout; also where all other rows
    are one at most and the borderless more. Else the rows of all tables, with a layout or without.
    """
    page = Window.partitionBy("source_file", "page_num")
    n = {p: F.sum((F.col("path") == p).cast("int")).over(page) for p in ("layout", "free", "borderless")}
    said = F.lit(False)
    for flag in ("hint", "hdfc"):
        if flag in found.columns:
            said = said | F.coalesce(F.max(flag).over(page), F.lit(False))
    other = n["layout"] + n["free"]
    words = F.when(said & (n["borderless"] > 0), True).otherwise((other <= 1) & (n["borderless"] > other))
    return found.withColumn("_words", words).where((F.col("path") == "borderless") == F.col("_words")).drop("_words")


def digital_rows(cells: DataFrame, tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Ledger rows of digital pages, with `path` and `direct`: what the chain leaves of all parsers' rows.

    cells: the pages' tables. tokens: the pages' words. texts: (source_file, page_num, text). A page may lack any of them.
    """
    page = ["source_file", "page_num"]
    layouts = detect_layout(cells)
    placed = parse_rows(cells, layouts).withColumn("direct", F.lit(True)).withColumn("path", F.lit("layout"))
    plain = cells.join(layouts.select(*page, "table_id"), [*page, "table_id"], "left_anti")
    free = parse_free_rows(plain).withColumn("path", F.lit("free"))
    words = parse_borderless(tokens).withColumn("path", F.lit("borderless"))
    marked = texts.where(borderless_hint(F.col("text"))).select(*page).unionByName(layouts.where("layout = 'schema_hdfc'").select(*page)).distinct()
    found = placed.unionByName(free, allowMissingColumns=True).unionByName(words, allowMissingColumns=True)
    return choose_rows(found.join(marked.withColumn("hint", F.lit(True)), page, "left")).drop("hint")


def scanned_rows(tokens: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """Ledger rows of recognised pages, with `path` and `direct`: by the header's words, and where no header or no such row is found, from the joined lines.

    A page is one row from its words on, so words are shuffled once and lines are found once. Then a line is one row, read in the way that its page is.
    """
    text, flagged = F.lit(None).cast("string"), _layout_name(F.col("head.n")) == "schema_b"
    told = F.exists("under", lambda cells: _is_entry(_read(lambda role: cells[role]).get, flagged))
    pages = _headed(tokens, tolerance).withColumn("under", _under_header()).withColumn("head", F.when(told, F.col("head")))
    row = lambda i, line, cell: F.struct(i.alias("row_idx"), line.alias("line"), *[cell(role).alias(f"at_{role}") for role in _ROLES])
    by_header = F.transform("under", lambda cells, i: row(F.col("head.row") + 1 + i, text, lambda role: cells[role]))
    joined = F.transform("ls", lambda words, i: row(i, _joined(words["text"]), lambda _: text))
    lines = pages.select("source_file", "page_num", F.col("head.n").alias("n"), F.inline(F.when(F.col("head").isNotNull(), by_header).otherwise(joined)))

    flagged, laid = _layout_name(F.col("n")) == "schema_b", F.col("n").isNotNull()
    at, read = lambda role: F.col(f"at_{role}"), lambda what: F.col(f"_{what}")
    lines = lines.withColumns({f"_{what}": c for what, c in _read(at).items()} | _line_marks())
    rows = _line_rest(lines.where(F.when(laid, _is_entry(read, flagged)).otherwise(_is_line_entry())))
    picked = {f: F.col(f) for f in ("txn_date", "value_date", "cheque_no", "description", "branch_code")}
    fields = {f: F.when(laid, c).otherwise(picked.get(f, text)) for f, c in _entry(at, read, flagged).items()}
    path = F.when(laid, "layout").otherwise("free")
    return rows.select("source_file", "page_num", F.lit(0).alias("table_id"), "row_idx", _layout_name(F.col("n")).alias("layout"), *_named(fields), laid.alias("direct"), path.alias("path"), "raw_amounts")


def page_formats(rows: DataFrame) -> DataFrame:
    """(source_file, page_num, format): the label of each page's first direct row (layout, cheque_no, value_date, debit, credit, branch_code, cr_dr)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    entry = (F.col("cheque_no").isNotNull()) & F.col("value_date").isNotNull() & (F.concat(text("debit"), text("credit")) != "")
    is_hdfc = (F.col("layout") == "schema_hdfc") | (entry & (text("branch_code") == "") & (text("cr_dr") == ""))
    # A branch or a flag says more than the layout's name only where the layout isn't named.
    label = F.when(is_hdfc, "Schema HDFC – Withdrawal / Deposit").when((text("branch_code") == "") & (text("cr_dr") != ""), "Format B – Cr/Dr Flag").otherwise("Format A – Standard")
    first = F.min_by(F.when(F.col("direct"), label), F.when(F.col("direct"), F.struct("table_id", "row_idx")))
    return rows.groupBy("source_file", "page_num").agg(F.coalesce(first, F.lit("Fallback (Math Engine)")).alias("format"))


def bank_name(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: strip(x)), lambda x: x != "")
    out = F.coalesce(F.get(lines, F.lit(0)), F.lit("Bank Statement"))
    for name, words in reversed(BANKS):
        out = F.when(_any(F.lower(text), words), name).otherwise(out)
    return out


# What ends the holder's address.
_STOP = r"account statement as of|account holder|customer id|branch|micr|ifsc|account number"


def metadata_text(pages: DataFrame) -> DataFrame:
    """(source_file, text) that the fields are looked for in, from pages (source_file, page_num from 1, text, layer): the first page if it is scanned, else the first two."""
    first = pages.where("page_num <= 2").groupBy("source_file").agg(F.max(F.when(F.col("page_num") == 1, F.struct("layer", "text"))).alias("p1"), F.max(F.when(F.col("page_num") == 2, F.col("text"))).alias("p2"))
    both = F.concat(*[F.when(t.isNotNull(), F.concat(t, F.lit("\n"))).otherwise("") for t in (F.col("p1.text"), F.col("p2"))])
    return first.select("source_file", F.when(F.col("p1.layer") == "scanned", F.coalesce("p1.text", F.lit(""))).otherwise(both).alias("text"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` gives for a value that is computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _client(lines: Column) -> Column:
    """The lines between the title and the first field."""
    titled = F.array_position(F.transform(F.slice(lines, 1, 4), lambda x: F.contains(F.lower(x), F.lit("statement"))), True)
    after = F.slice(lines, (F.greatest(titled, F.lit(0)) + 1).cast("int"), F.size(lines))
    stop = F.array_position(F.transform(after, lambda x: F.lower(x).rlike(_STOP)), True)
    return F.when((titled > 0) & (titled < F.size(lines)), F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after))


def _saluted(lines: Column) -> Column:
    return F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: F.when(F.upper(F.get(lines, i - 1)).isin("MR", "MRS", "MS", "DR", "M/S") & (i < F.size(lines)), F.concat(F.get(lines, i - 1), F.lit(" "), F.get(lines, i)))
            .when(F.get(lines, i - 1).rlike(r"(?i)^(?:MR|MRS|MS|DR|M/S)\s+[A-Za-z]") & ~F.lower(F.get(lines, i - 1)).rlike("branch|bank|statement|joint holders"), F.get(lines, i - 1))),
        lambda x: x.isNotNull(),
    )


def metadata(text: Column) -> Column:
    """Map of the account fields found in a statement's first pages, with bank, holder and address; no text, no fields."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: strip(x)), lambda x: x != "")
    told = lambda client, of: F.struct(
        F.coalesce(F.get(client, F.lit(0)), F.get(_saluted(of), F.lit(0))).alias("holder"), F.when(F.size(client) > 1, F.array_join(F.slice(client, F.lit(2), F.size(client)), ", ")).alias("address")
    )
    said = _let(lines, lambda of: _let(_client(of), lambda client: told(client, of)))

    def fields(who: Column) -> Column:
        found = [("Bank Name", bank_name(text)), ("Account Holder", who["holder"]), ("Client Address", who["address"]), *((k, strip(F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")))) for k, p in METADATA.items())]
        return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found])

    return F.map_from_entries(F.filter(_let(said, fields), lambda e: e["value"].isNotNull() & (F.length(text) > 0)))


def merge_metadata(per_file: DataFrame) -> DataFrame:
    """(field, value) over files (file_idx, field, value): the last file that has a field says it."""
    return per_file.groupBy("field").agg(F.max_by("value", "file_idx").alias("value"))


def recognised_rows(tokens: DataFrame) -> DataFrame:
    """Lines of three tokens or more (line_no, x0, text, score) whose first is a date: cells from left to right, and confidence."""
    cells = F.array_sort(F.collect_list(F.struct("x0", "text")))
    rows = tokens.groupBy("source_file", "page_num", "line_no").agg(cells["text"].alias("cells"), F.round(F.avg("score"), 4).alias("confidence"))
    return rows.where((F.size("cells") >= 3) & F.get("cells", F.lit(0)).rlike(DATE))


# Phrases of headers, footers and watermarks.
_NOISE = ("statement of account", "customer id", "synthetic data", "txn date", "value date", "account holders name", "micr code")


def is_noise(line: Column) -> Column:
    return _any(F.lower(line), _NOISE)


def unique_names(names: list[str]) -> list[str]:
    """Column names without blanks and repeats."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = f"Col_{i}" if not (n or "").strip() or n.startswith("Unnamed:") else n
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n] - 1}")
    return out

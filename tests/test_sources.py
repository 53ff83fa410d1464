"""Pages and workbooks as data sources; the page chain; running totals."""

import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import layout, running
from ledgerloom.plans import statements, stored
from ledgerloom.sources import documents, pages, workbooks

CELLS = "source_file string, sheet string, row int, col int, span int, value string, style string, align string"


class Twice(pages.TextCells):
    """A reader that fails on pages with the word `bad` and knows nothing of those with `none`."""

    def page(self, file, number):
        body = self._page(file, number)
        if b"bad" in body:
            raise ValueError("bad page")
        if b"none" not in body:
            yield from ((0, 0, [line]) for line in body.decode().split("\n") if line)


def test_pages_are_dealt_out_by_lots():
    files = [("a", 100, 5), ("b", 10, 1), ("c", 10, 1), ("d", 1000, 2)]
    lots = pages.lots_of(files, 4, 200)
    assert lots == [[("a", 1, 4)], [("a", 5, 5), ("b", 1, 1), ("c", 1, 1)], [("d", 1, 1)], [("d", 2, 2)]]
    assert pages.lots_of([], 4, 200) == []


def test_pages_of_text(spark, tmp_path):
    pages.register(spark)
    (tmp_path / "one.txt").write_text("#0\na\\tb\tc\\\\\n\td\n#1\nx\f#0\nbad\fnone\f")
    (tmp_path / "two.txt").write_text("")
    (tmp_path / "_skipped.txt").write_text("lost")
    read = lambda **o: spark.read.format("statement_pages").options(path=str(tmp_path), pattern="*.txt", pages_a_task=1, **o).load()
    got = read()
    assert got.rdd.getNumPartitions() == 4  # three pages and an empty file
    assert sorted(tuple(r) for r in got.where("source_file = 'one'").collect()) == [
        ("one", 1, 0, 0, ["a\tb", "c\\"], None), ("one", 1, 0, 1, ["", "d"], None), ("one", 1, 1, 0, ["x"], None), ("one", 2, 0, 0, ["bad"], None), ("one", 3, 0, 0, ["none"], None),
    ]
    assert got.where("source_file = 'two'").count() == 0
    alone = read(readers="tests.test_sources:Twice").orderBy("page_num").collect()
    assert [(r.page_num, r.error) for r in alone if r.page_num > 1] == [(2, "ValueError: bad page")]
    both = read(readers="tests.test_sources:Twice,ledgerloom.sources.pages:TextCells").collect()
    assert {(r.page_num, tuple(r.cells)) for r in both if r.page_num > 1} == {(2, ("bad",)), (3, ("none",))} and not any(r.error for r in both)


def test_a_task_starts_at_its_own_pages(spark, tmp_path):
    body = [f"#0\n{i}\tx\\\\" + "\ty" * (i % 50) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\f".join(body) + "\f")
    (tmp_path / "b.txt").write_text("\f\f#0\nlast")
    want = [("a", i + 1, [str(i), "x\\", *["y"] * (i % 50)]) for i in range(3000)] + [("b", 3, ["last"])]
    pages.register(spark)
    for size in (20_011, 1 << 20):  # parts of files that end anywhere
        for given in ({"spans": pages.find_pages(spark, str(tmp_path), "*.txt", 100, size)}, {"bytes_a_task": size}):
            read = spark.read.format("statement_pages").options(path=str(tmp_path), pattern="*.txt", pages_a_task=100, **given).load()
            assert sorted((r.source_file, r.page_num, r.cells) for r in read.collect()) == want
    lots = pages.PagesReader({"path": str(tmp_path), "pattern": "a.txt"}, 6).partitions()
    assert [(first, last) for lot in lots for _, first, last, _ in lot.spans] == [(i, min(i + 63, 3000)) for i in range(1, 3001, 64)]
    reader, seen = pages.TextCells(), []
    file = io.BytesIO("\f".join(body).encode())
    file.seek, seek = lambda at: (seen.append(at), seek(at)), file.seek
    reader.begin(file, lots[-1].spans[0][1], lots[-1].spans[0][3])
    assert [c[0] for _, _, c in reader.page(file, lots[-1].spans[0][1])] == [str(lots[-1].spans[0][1] - 1)]
    assert seen == [lots[-1].spans[0][3]]


def test_more_tasks_than_files(spark, tmp_path):
    pages.register(spark)
    stored.write_pages(statements.cells(spark, "/root/testdata/sf0.001"), str(tmp_path / "s"))
    read = spark.read.format("statement_pages").options(path=str(tmp_path / "s"), pattern="*.txt", pages_a_task=2).load()
    assert read.select("source_file").distinct().count() == 10 < read.rdd.getNumPartitions()


def _book(spark, tmp_path, rows):
    workbooks.write_workbooks(spark.createDataFrame(rows, CELLS), str(tmp_path / "out"), ["Debit", "Description"])


def test_workbooks_there_and_back(spark, tmp_path):
    pages.register(spark)
    odd = "a & <b> \"'\n\ttab\x01 _x0041_ é \U0001f3e6 "
    rows = [("f", "Transactions", 1, 1, 3, odd, "title", "center"), ("f", "Transactions", 4, 30, 1, None, "debit", "right"), ("f", "Account_Metadata", 1, 1, 1, "", "field", "left"), ("g/h", "Transactions", 2, 1, 1, "x", None, None)]
    _book(spark, tmp_path, rows)
    got = sorted((tuple(r) for r in spark.read.format("workbooks").load(str(tmp_path / "out")).collect()), key=lambda r: r[:4])
    assert got == [("f", "Account_Metadata", 1, 1, ""), ("f", "Transactions", 1, 1, odd), ("f", "Transactions", 4, 30, None), ("g_h", "Transactions", 2, 1, "x")]
    assert spark.read.format("workbooks").option("sheet", "Account_Metadata").load(str(tmp_path / "out")).count() == 1
    with zipfile.ZipFile(tmp_path / "out" / "f.xlsx") as z:
        assert b'<mergeCell ref="A1:C1"/>' in z.read("xl/worksheets/sheet1.xml") and b"AD4" in z.read("xl/worksheets/sheet1.xml")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f.xlsx", "g_h.xlsx"]
    with pytest.raises(PySparkException, match="workbooks of one name"):
        _book(spark, tmp_path, rows[:1])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f.xlsx", "g_h.xlsx"]


def test_a_long_statement_is_written_as_volumes(spark, tmp_path):
    """Beyond a sheet's rows a statement used to fail; volumes are tasks of their own, and rows read as they were given."""
    pages.register(spark)
    last = 3 * workbooks.MOST_ROWS + 5
    rows = [("a/b", "Transactions", r, c, 1, f"{r} {c}", "odd", "left") for r in (1, 2, 100, workbooks.MOST_ROWS, workbooks.MOST_ROWS + 1, last) for c in (1, 3)] + [("a/b", "Account_Metadata", 1, 1, 1, "m", "field", "left"), ("c", "Transactions", 1, 1, 1, "x", "odd", "left")]
    _book(spark, tmp_path, rows)
    read = spark.read.format("workbooks").load(str(tmp_path / "out"))
    assert sorted(map(tuple, read.collect())) == sorted((s.replace("/", "_"), sheet, r, c, v) for s, sheet, r, c, _, v, _, _ in rows)
    names = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.xlsx"))
    assert names == ["a_b.xlsx", "c.xlsx", "source_file=a_b/a_b-25.xlsx", "source_file=a_b/a_b-8.xlsx", "source_file=a_b/a_b-9.xlsx"]
    with zipfile.ZipFile(tmp_path / "out" / names[2]) as z:
        assert b'<row r="5">' in z.read("xl/worksheets/sheet1.xml")
    workbooks.write_workbooks(spark.createDataFrame(rows[:6], CELLS), str(tmp_path / "small"), [], 2)
    read = spark.read.format("workbooks").load(str(tmp_path / "small"))
    assert read.rdd.getNumPartitions() == 2 and sorted((r.row, r.col) for r in read.collect()) == [(r, c) for r in (1, 2, 100) for c in (1, 3)]


def test_a_failed_workbook_leaves_no_file(spark, tmp_path):
    pages.register(spark)
    good = [(f"s{i}", "Transactions", r, 1, 1, "x", "odd", "left") for i in range(8) for r in range(1, 50)]
    with pytest.raises(PySparkException, match="twice or out of order"):
        _book(spark, tmp_path, [*good, ("s3", "Transactions", 7, 1, 1, "again", "odd", "left")])
    assert not any((tmp_path / "out").rglob("*.xlsx"))


def test_shared_strings_runs_and_numbers():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c t="b"><v>1</v></c><c r="E2"><v>1.5</v></c></row><row><c t="str"><f>1</f><v>a_x000A_b</v></c><c/></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r><rPh><t>no</t></rPh></si></sst>")
    with zipfile.ZipFile(out) as z:
        shared = list(workbooks._shared(z))
    assert list(workbooks.cells_of(io.BytesIO(sheet.encode()), shared)) == [(2, 2, "one"), (2, 3, "TRUE"), (2, 5, "1.5"), (3, 1, "a_x000A_b"), (3, 2, None)]
    assert [workbooks.letters(i) for i in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and workbooks.number("AAA") == 703


@pytest.mark.parametrize(
    ("offers", "kept"),
    [
        ({"layout": 1, "borderless": 3}, "borderless"), ({"layout": 2, "free": 1}, "layout free"), ({"layout": 1, "free": 1, "borderless": 9}, "layout free"), ({"free": 1, "borderless": 1}, "free"),
        ({"layout": 5, "borderless": 2, "hint": True}, "borderless"), ({"layout": 5, "hint": True}, "layout"), ({"layout": 5, "borderless": 1, "hdfc": True}, "borderless"), ({"borderless": 1}, "borderless"),
    ],
)
def test_chain(spark, offers, kept):
    rows = [("f", 1, p, i, offers.get("hint", False), offers.get("hdfc")) for p in ("layout", "free", "borderless") for i in range(offers.get(p, 0))]
    found = spark.createDataFrame(rows, "source_file string, page_num int, path string, i int, hint boolean, hdfc boolean")
    got = layout.choose_rows(found)
    assert {r.path: r["count"] for r in got.groupBy("path").count().collect()} == {p: offers[p] for p in kept.split()}


@pytest.mark.parametrize("parts", [1, 5])
def test_running_totals(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") % 11)
        df = spark.range(1000).select(key.alias("k"), F.xxhash64("id").alias("o"), "id")
        w = Window.partitionBy("k").orderBy(F.desc("o"))
        want = df.withColumn("total", F.sum("id").over(w)).withColumn("n", F.row_number().over(w).cast("long"))
        got = running.running(df, ["k"], [F.desc("o")], {"total": F.col("id"), "n": F.lit(1)})
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert running.numbered(df.limit(0), ["k"], ["o"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_files_as_one_table(spark):
    rows = [("a", 0, ["Txn Date", "Amount", "Amount", ""]), ("a", 1, ["1", "2", "3", "4", "5"]), ("a", 2, ["", None, " "]), ("b", 0, ["title"]), ("b", 3, ["No", "Date", "Description\n x"]), ("b", 4, ["7", None, "z"]), ("c", 0, ["x"]), ("c", 1, ["y"])]
    cells = spark.createDataFrame(rows, "source_file string, row_idx int, cells array<string>")
    table = documents.common_table(documents.headed_rows(cells))
    assert table.columns == ["source_file", "row_idx", "Txn Date", "Amount", "Amount_1", "Col_3", "Col_4", "No", "Date", "Description x", "x"]
    got = {(r.source_file, r.row_idx): {k: v for k, v in r.asDict().items() if v is not None and k not in ("source_file", "row_idx")} for r in table.collect()}
    assert got == {("a", 1): {"Txn Date": "1", "Amount": "2", "Amount_1": "3", "Col_3": "4", "Col_4": "5"}, ("b", 4): {"No": "7", "Description x": "z"}, ("c", 1): {"x": "y"}}
    head = F.concat(F.lit("h"), (F.col("id") % 3).cast("string"))
    many = spark.range(1000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("source_file"), F.posexplode(F.array(F.array(head), F.array(F.lit("v")))).alias("row_idx", "cells"))
    assert documents.common_table(documents.headed_rows(many)).count() == 1000


def test_numbers_of_few_keys_need_no_second_shuffle(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 > 0 THEN id % 3 END AS k", "id % 7 AS o", "id", "'x' AS rank")
    got = running.numbered(rows, ["k"], ["o", F.desc("id")], few=True)
    want = rows.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("o", F.desc("id"))).cast("long"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    wide = [line for line in plan.splitlines() if "Exchange" in line and "o#" in line]
    assert not wide  # rows themselves stay where they were written

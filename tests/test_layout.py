"""Layout detection, grid rows, token lines."""

from pyspark.sql import functions as F

from ledgerloom.operators import layout
from ledgerloom.plans import statements

CELLS = "source_file string, page_num int, table_id int, row_idx int, cells array<string>"


def _tables(spark, *tables):
    return spark.createDataFrame([("f", 1, t, i, c.split("|")) for t, rows in enumerate(tables) for i, c in rows], CELLS)


def test_layouts_and_rows(spark):
    a, b, h = "Txn Date|Value Date|Cheque No.|Description|Branch\nCode|Debit|Credit|Balance", "No.|Transaction\nID|Value Date|Txn Posted Date|Cheque No.|Description|Cr/Dr|Transaction\nAmount|Available\nBalance", "Date|Narration|Chq./Ref.No.|Value Dt|Withdrawal Amt.|Deposit Amt.|Closing Balance"
    df = _tables(
        spark, [(0, a), (1, "01-02-2024|01-02-2024||NEFT  Cr-X|0042||Rs. 1,500.00|Rs. 9,000.00"), (2, "|||continued|||"), (3, "01-02-2024|||text|||")],
        [(0, b), (1, "1\n2|S1|01 Feb 2024|01/02/2024||UPI/CR/1|CR|250.00|1,250.00"), (2, "2|S2|||| |  |1.00|2.00")], [(0, h)], [(0, "opening balance|1,000.00"), (8, a)],
    )
    found = layout.detect_layout(df)
    assert {r.table_id: r.layout for r in found.collect()} == {0: "schema_a", 1: "schema_b", 2: "schema_hdfc"}
    got = {r.table_id: r for r in layout.parse_rows(df, found).collect()}
    assert sorted(got) == [0, 1]
    assert (got[0].debit, got[0].credit, got[0].balance, got[0].description) == ("", "Rs. 1,500.00", "Rs. 9,000.00", "NEFT Cr-X")
    assert (got[1].no, got[1].value_date, got[1].credit, got[1].debit, got[1].cr_dr) == ("1", "01 Feb 2024", "Rs. 250.00", "", "CR")


def test_free_rows(spark):
    df = _tables(spark, [(0, "01-02-2024|UPI x|123456|0042|1,000.00|2,000.00"), (1, "no date|1.00"), (2, "Statement as of 01-02-2024|1.00")])
    r = layout.parse_free_rows(df).collect()
    assert len(r) == 1 and (r[0].cheque_no, r[0].branch_code, r[0].raw_amounts, r[0].description) == ("123456", "0042", ["1,000.00", "2,000.00"], "UPI x")


def _tokens(spark, rows):
    return spark.createDataFrame([("f", p, float(x), float(y), x + 5.0, y + 5.0, t, 1.0) for p, x, y, t in rows], "source_file string, page_num int, x0 double, y0 double, x1 double, y1 double, text string, score double")


def test_running_mean_lines(spark):
    for ys, n in (((300, 304, 320), 2), ((300, 305, 308, 311), 1), ((300, 305, 309), 2), ((224, 776), 0)):
        assert layout.group_lines(_tokens(spark, [(1, 10, y, "a") for y in ys]), 6.0, 225.0, 775.0).count() == n


def test_borderless(spark):
    rows = [(1, 70, 250, "lost"), (1, 40, 300, "01/02/24"), (1, 70, 300, "UPI"), (1, 290, 300, "77"), (1, 360, 300, "01/02/24"), (1, 490, 300, "5.00"), (1, 560, 300, "9.00"), (1, 80, 320, "more"), (1, 40, 340, "02/02/24"), (1, 410, 340, "x")]
    got = layout.parse_borderless(_tokens(spark, rows)).orderBy("row_idx").collect()
    assert [(r.txn_date, r.description, r.cheque_no, r.debit, r.credit, r.balance) for r in got] == [("01/02/24", "UPI more", "77", "", "Rs. 5.00", "Rs. 9.00"), ("02/02/24", "", "", "", "", "")]


def test_metadata(spark):
    t = "Velocity Banking\nAccount Statement\nA. Person\n1 Road\nCustomer ID: ABC12345\nIFSC: VELO0123456\n"
    m = spark.createDataFrame([(t,)], "t string").select(layout.metadata(F.col("t"))).first()[0]
    assert m["Bank Name"] == "Velocity Banking Corporation" and m["Account Holder"] == "A. Person" and m["Client Address"] == "1 Road" and m["Customer ID"] == "ABC12345"
    assert layout.unique_names(["a", "", "a", "Unnamed: 3"]) == ["a", "Col_1", "a_1", "Col_3"]


def test_statements_are_numbered_without_a_task_for_each(spark):
    """Ten statements at any scale: a window over them has ten tasks at most."""
    rows = statements.paged(spark, "/root/testdata/sf0.001")
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in sorted(rows.collect(), key=lambda r: r.o_orderkey):
        n = by[r.source_file] = by.get(r.source_file, -1) + 1
        assert (r.n, r.pos, r.page_num, r.kind) == (n, n % 25, n // 25, n // 25 % 4)
    assert len(by) == 10


def test_metadata_cuts_a_text_once(spark):
    """Lines are looked at by every other field; cut anew for each look, a text costs its lines squared."""
    plan = spark.createDataFrame([("a\nb",)], "t string").select(layout.metadata(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4


def test_line_folding_keeps_no_lines_in_its_state(spark):
    """The fold carries where lines begin, not the words themselves; lines are those of a plain loop."""
    import random

    words = [(i, float(x), round(random.Random(7 * i + x).uniform(0, 60), 1), "w") for i in range(20) for x in range(30)]
    tokens = spark.createDataFrame(words, "page_num int, x0 double, y0 double, text string").selectExpr("'f' AS source_file", "page_num", "x0", "y0", "x0 + 1 AS x1", "text")
    found = layout.group_lines(tokens, 2.0)
    got = {(r.page_num, r.line_no): [w.x for w in r.words] for r in found.collect()}
    want, plan = {}, found._jdf.queryExecution().optimizedPlan().toString()
    for page in range(20):
        at, no = None, -1
        for y, x in sorted((y, x) for p, x, y, _ in words if p == page):
            joins = at is not None and abs(y - at) < 2.0
            no, at = (no, (at + y) / 2) if joins else (no + 1, y)
            want.setdefault((page, no), []).append(x)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert "starts" in plan and "lines, " not in plan


def test_scanned_pages_shuffle_their_words_once(spark):
    """A page is one row from its words on: lines aren't found anew for the header, the rows below it and the pages without."""
    head = "Txn Date|Value Date|Cheque No.|Description|Branch|Debit|Credit|Balance".split("|")
    entry = ["01-02-2024", "02-02-2024", "123456", "NEFT x", "0042", "5.00", "", "9.00"]
    line = lambda p, no, cells, dx=0: [(p, 100 * i + dx, 40 * no, t) for i, t in enumerate(cells) if t]
    rows = [
        *line(1, 0, ["Some Bank"]), *line(1, 1, head), *line(1, 2, entry, 20), *line(1, 3, ["no date"]), *line(1, 4, entry, 50), *line(1, 5, ["03-02-2024 UPI 7.00"]),
        *line(2, 0, head), *line(2, 1, ["01-02-2024", "UPI 654321 0042 1.00 2.00"]), *line(2, 2, ["none"]),
        *line(3, 0, ["Statement as of 01-02-2024", "1.00"]), *line(3, 1, ["01-02-2024", "UPI", "1.00"]),
        *[t for no in range(8) for t in line(4, no, ["x"])], *line(4, 8, head), *line(4, 9, entry),
    ]
    found = layout.scanned_rows(_tokens(spark, rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and "Join" not in plan and "Union" not in plan
    got = sorted((r.page_num, r.path, r.row_idx, r.layout, r.txn_date, r.value_date, r.cheque_no, r.branch_code, r.description, r.debit, r.balance, r.raw_amounts, r.direct) for r in found.collect())
    laid = ("layout", "schema_a", "01-02-2024", "02-02-2024", "123456", "0042", "NEFT x", "Rs. 5.00", "Rs. 9.00", None, True)
    # Words halfway between two roles belong to the first of them.
    assert got == [
        (1, "layout", i, *laid[1:]) for i in (2, 4)
    ] + [
        (2, "free", 1, None, "01-02-2024", "01-02-2024", "654321", "0042", "UPI", None, None, ["1.00", "2.00"], False),
        (3, "free", 1, None, "01-02-2024", "01-02-2024", "", "", "UPI", None, None, ["1.00"], False),
        (4, "free", 9, None, "01-02-2024", "01-02-2024", "123456", "0042", "NEFT x", None, None, ["5.00", "9.00"], False),
    ]
    direct = layout.rows_by_header(_tokens(spark, rows))
    assert [(r.page_num, r.row_idx, r.debit) for r in direct.orderBy("row_idx").collect()] == [(1, 2, "Rs. 5.00"), (1, 4, "Rs. 5.00")]


def test_scanned_rows_of_two_roles_under_one_word(spark):
    """Two roles of one header word: the first takes the words, the last fills the cell, so both are empty."""
    head, entry = ["Date", "Narration", "Value Date Withdrawal", "Deposit", "Closing Balance"], ["01/02/24", "UPI", "5.00", "", "9.00"]
    rows = [(1, 100 * i, 40 * no, t) for no, cells in enumerate((head, entry)) for i, t in enumerate(cells) if t]
    r = layout.scanned_rows(_tokens(spark, rows)).collect()
    assert [(x.layout, x.path, x.txn_date, x.description, x.value_date, x.debit, x.credit, x.balance) for x in r] == [("schema_hdfc", "layout", "01/02/24", "UPI", "", "", "", "Rs. 9.00")]

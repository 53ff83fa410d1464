"""Golden narrations, the balance engine, filters and stores."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import rules, text
from ledgerloom.operators import ledger, vectors
from ledgerloom.plans.queries import REGISTRY
from ledgerloom.sources import documents, stores

GOLDEN = [
    ("NEFT-CNRBR946608852502-HDFC0004171-RAMESH VORA-/NONE", "NEFT - RAMESH VORA", "NEFT", None, "Ramesh Vora"),
    ("UPI-SANDEEP SWAIN-sandeep@okicici", "UPI - SANDEEP SWAIN - sandeep@okicici", "UPI", "Personal / P2P Transfer", "Sandeep Swain"),
    ("Chq Paid - MICR Inward Clearing - FORAM JOSHI - HDFC BANK LTD", None, "Cheque / Clearing", None, "Foram Joshi"),
    ("IMPS BRN SALARY TRF BY - CONSUMER PRODUCTS INDIA", None, "IMPS", "Salary / Payroll", "Consumer Products India"),
    ("ATM WDL-ATM CASH 96012", "ATM WDL - ATM CASH", "ATM", "ATM Withdrawal", "Not Specified"),
    ("NEFT DR RAMESH VORA", None, "NEFT", "Personal / P2P Transfer", "Ramesh Vora"),
    ("CASH-BNA-SELF-MEHUL PANDYA", "CASH - BNA - SELF - MEHUL PANDYA", "Cash / BNA", None, "Mehul Pandya"),
    ("UPI-SWIGGY INSTAMART-x@y", "UPI - SWIGGY INSTAMART - x@y", "UPI", "Food & Dining", "Swiggy Instamart"),
]


def test_golden_narrations(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, narration string")
    e = df.withColumn("t", text.clean_description(F.col("narration")))
    got = e.select("i", "t", rules.first_rule(F.col("t"), rules.MODE), rules.purpose_rule(F.col("narration")), rules.counterparty(F.col("narration"))).orderBy("i").collect()
    for (raw, cleaned, mode, purpose, party), r in zip(GOLDEN, got, strict=True):
        assert tuple(r)[1:] == (cleaned or raw, mode, purpose, party)


def test_cleaner_edges(spark):
    rows = [(None, ""), ("   ", ""), ("HEALTHC\nARE LTD", "HEALTHCARE LTD"), ("x–y—z", "x - y - z"), ("_A_9", "A 9")]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", text.clean_description(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in got] == [r[1] for r in rows]


def test_title_case(spark):
    assert spark.sql("select \"o'neil smith-jones a1b2\" as t").select(text.title_case(F.col("t"))).first()[0] == "O'Neil Smith-Jones A1B2"


def test_balance_engine(spark):
    rows = [
        ("f", 1, 1, "by clg 1", False, None, None, None, ["100.00", "1,100.00"], ("", "Rs. 100.00", "Rs. 1,100.00")), ("f", 1, 2, "x", False, None, None, None, ["50.00", "1,050.00"], ("Rs. 50.00", "", "Rs. 1,050.00")),
        ("f", 1, 3, "x", False, None, None, None, ["1,050.00"], ("", "", "Rs. 1,050.00")), ("f", 1, 4, "x", False, None, None, None, [], ("", "", "")),
        ("f", 1, 5, "x", False, None, None, None, ["10.00", "1,050.00"], ("Rs. 10.00", "", "Rs. 1,050.00")), ("f", 1, 6, "x", True, "", "Rs. 5.00", "Rs. 1,055.00", [], ("", "Rs. 5.00", "Rs. 1,055.00")),
        ("f", 2, 1, "x", False, None, None, None, ["45.00", "1,100.00"], ("", "Rs. 45.00", "Rs. 1,100.00")), ("g", 1, 1, "x", False, None, None, None, ["45.00", "2,100.00"], ("Rs. 45.00", "", "Rs. 2,100.00")),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], "source_file string, page_num int, row_idx int, description string, direct boolean, debit string, credit string, balance string, raw_amounts array<string>")
    got = {(r.source_file, r.page_num, r.row_idx): (r.debit, r.credit, r.balance) for r in ledger.balance_engine(df).collect()}
    assert got == {r[:3]: r[-1] for r in rows}


def test_classify_defaults_and_prototypes(spark):
    df = spark.createDataFrame([("zzz", "", ""), (None, "", "5")], "narration string, debit string, credit string")
    got = {r.narration: r for r in ledger.classify(df).collect()}
    assert (got["zzz"].mode, got["zzz"].direction, got["zzz"].purpose, got["zzz"].bank) == ("Other", "Debit", "General Transfer", "Not Mentioned")
    assert got[None].eval_text == "nan" and got[None].direction == "Credit"
    scored = spark.createDataFrame([("zzz", "Transaction Mode", "UPI", 0.6), ("zzz", "Bank / Institution", "Axis Bank", 0.6)], "eval_text string, domain string, label string, score double")
    r = ledger.classify(df, scored=scored).where("narration = 'zzz'").first()
    assert (r["mode"], r["bank"]) == ("UPI", "Not Mentioned")


def test_filters_and_columns(spark):
    df = spark.createDataFrame([("Txn Date", "Description"), ("01-01-2024", "UPI x"), ("02-01-2024", " "), ("total", "y")], "a string, b string")
    assert [r.b for r in ledger.transactions_only(df, "b", "txn date|date|customer id|total").collect()] == ["UPI x"]
    assert ledger.target_column(df, "B") == "b" and ledger.target_column(df, "1") == "b" and ledger.target_column(df, "description") == "b"
    assert ledger.description_column(["x", "Narration "]) == "Narration "
    up = ledger.promote_header(spark.createDataFrame([(0, "junk", "z"), (1, "Txn  Date", "Description"), (2, "01", "UPI")], "i int, c0 string, c1 string"), "i")
    assert up.columns == ["i", "Txn Date", "Description"] and up.count() == 1
    assert ledger.sanitise(spark.createDataFrame([("nan a\n b", "k")], "x string, d string"), "d").first()["x"] == "a b"
    assert spark.sql("select 'a b!.pdf' as t union all select '!!' ").select(text.stem(F.col("t"))).collect()[0][0] == "a_b"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<float>").select("id", vectors.normalise(F.col("v")).alias("v"))
    assert [[round(x, 6) for x in r.v] for r in v.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0]]
    p = spark.createDataFrame([("b", 1, [1.0, 0.0]), ("a", 0, [1.0, 0.0])], "label string, label_rank int, v array<double>")
    assert vectors.best_label(vectors.label_scores(v.where("id = 1"), p)).first().label == "a"
    s = spark.createDataFrame([("a", 0, [x, 0.0]) for x in (0.9, 0.8, 0.1, 0.5)], "label string, label_rank int, v array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id int, v array<double>")
    assert [round(vectors.label_scores(one, s, k).first().score, 4) for k in ("max", "top3", "mean")] == [0.9, 0.7333, 0.575]


def test_sources_and_stores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"hello")
    (tmp_path / "in/b.pdf").write_bytes(b"")
    pages = documents.read_with(documents.statement_files(spark, f"file://{tmp_path}/in"), lambda p, c: [(p, 1, chr(c[0]))], schema=documents.PAGES)
    assert [r.layer for r in documents.pages_with_layer(pages.where('error is null')).collect()] == ["scanned"]
    tax = ledger.taxonomy(spark)
    stores.write_version(tax, f"file://{tmp_path}/s", "domain")
    assert stores.missing_labels(tax, stores.read_version(spark, f"file://{tmp_path}/s")).count() == 0
    real = spark.createDataFrame([("Transaction Mode", "UPI", 1, "new one"), ("Transaction Mode", "NEW", 1, "other")], "domain string, label string, rank int, phrase string")
    merged = ledger.merge_exemplars(tax, real).where("domain = 'Transaction Mode' and label in ('UPI', 'NEW')").orderBy("label", "rank").collect()
    assert [(r.label, r["rank"]) for r in merged] == [("NEW", 0), ("UPI", 0), ("UPI", 1), ("UPI", 2)]


def test_document_clusters_take_every_language(spark, tmp_path):
    subjects = ["river stone bridge water", "garten blume baum haus", "fromage pain vin soleil", "playa arena barco mar"]
    kinds = [(0, 0, 0, 0, 1, 1, 1, 2, 2, 3)[i % 10] for i in range(40)]  # unequal numbers, so that no singular value is repeated
    rows = [(i, f"{subjects[k]} {subjects[k].split()[i % 3]}", ["en", "de", None, "es"][k]) for i, k in enumerate(kinds)]
    rows += [(None, subjects[0], "en"), (None, subjects[1], "de"), (3, subjects[3], "es"), (3, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {r["cluster"]: r["n"] for r in REGISTRY["c2_tfidf_kmeans"][0](spark, str(tmp_path)).collect()}
    assert sum(sizes.values()) == len(rows)
    ranks = REGISTRY["a6_w2_keyword_ranks"][0](spark, str(tmp_path)).collect()
    assert {r["cluster"]: r["total_records"] for r in ranks}.items() <= sizes.items()
    found, of = {}, {}
    for r in ranks:
        found[r["keyword"]] = found.get(r["keyword"], 0) + r["frequency"]
        of.setdefault(r["keyword"], set()).add(r["cluster"])
    assert found == Counter(w for _, t, _ in rows for w in (t or "").split())
    assert all(len({frozenset(of[w]) for w in s.split()}) == 1 and len(of[s.split()[0]]) == 1 for s in subjects)  # real clusters, not ids modulo four
    assert REGISTRY["c5_k8_keyword_report"][0](spark, str(tmp_path)).count() == len(ranks)
    x = np.zeros((len(rows), 16))
    words = sorted(found)
    for i, (_, t, _) in enumerate(rows):
        for w, n in Counter((t or "").split()).items():
            x[i, words.index(w)] = n * (math.log((1 + len(rows)) / (1 + sum(w in (u or "").split() for _, u, _ in rows))) + 1)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    svd = [r["value"] for r in REGISTRY["c6_svd"][0](spark, str(tmp_path)).orderBy("no").collect()]
    assert np.allclose(svd, np.linalg.svd(x)[1][:2])


@pytest.mark.parametrize("pool", ["max", "top3", "mean"])
def test_more_prototypes_than_are_sent_at_once(spark, monkeypatch, pool):
    rng = np.random.default_rng(2)
    protos = spark.createDataFrame([(str(i % 3), i % 3, rng.normal(size=4).tolist()) for i in range(23)], "label string, label_rank int, v array<double>")
    rows = spark.createDataFrame([(i // 2, rng.normal(size=4).tolist()) for i in range(6)], "id int, v array<double>")
    key = lambda df: sorted((r["id"], r["label"], r["label_rank"], round(r["score"], 9)) for r in df.collect())
    whole = key(vectors.label_scores(rows, protos, pool))
    monkeypatch.setattr(vectors, "PROTOTYPES", 5)
    assert key(vectors.label_scores(rows, protos, pool)) == whole and len(whole) == 18


@pytest.mark.parametrize("pool", ["max", "top3", "mean"])
def test_odd_vectors_have_null_scores_and_odd_prototypes_take_no_part(spark, monkeypatch, pool):
    nan = float("nan")
    protos = spark.createDataFrame([(f"l{i % 2}", i % 2, [1.0, float(i)]) for i in range(9)] + [("l0", 0, [1.0, nan]), ("l1", 1, [None, 1.0]), ("l0", 0, None), ("l2", 2, [nan, nan])], "label string, label_rank int, v array<double>")
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [nan, 1.0]), (5, [1.0]), (6, []), (1, [1.0, 2.0])], "id int, v array<double>")
    key = lambda df: sorted((r["id"], r["label"], r["score"]) for r in df.collect())
    whole = key(vectors.label_scores(rows, protos, pool))
    monkeypatch.setattr(vectors, "PROTOTYPES", 2)
    assert key(vectors.label_scores(rows, protos, pool)) == whole
    assert len(whole) == 14 and [r[2] is None for r in whole] == [i != 1 for i, *_ in whole]
    assert {r[1] for r in whole} == {"l0", "l1"}

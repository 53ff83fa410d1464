"""Encoders, prototypes and their stores, sources, terms of clusters, workbooks."""

import math
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ledgerloom.operators import clusters, encoder, ledger, vectors, workbook
from ledgerloom.sources import documents, stores


def test_encode_prefixes_keeps_nulls_and_loads_once(spark):
    def counting():
        loads = []

        def load():
            loads.append(1)
            return lambda texts: np.array([[len(t), len(loads), len(texts)] for t in texts], dtype=float)

        return load

    texts = spark.createDataFrame([("a",), (None,), ("bcd",), ("",)], "eval_text string").coalesce(1)
    got = {r.eval_text: r.v for r in encoder.encode(texts, counting(), prefix="p: ", batch=2).collect()}
    assert got[None] is None and got["a"] == pytest.approx(list(np.array([4, 1, 2]) / np.sqrt(21)))
    assert got[""] == pytest.approx(list(np.array([3, 1, 1]) / np.sqrt(11)))
    zero = encoder.encode(texts.where("eval_text = ''"), encoder.hashing_encoder(4), prefix="").first()
    assert zero.v == [0.0] * 4


def test_nearest_prototype_behind_its_gate(spark):
    tax = ledger.taxonomy(spark)
    text = tax.where("domain = 'Bank / Institution'").orderBy("label_rank", "exemplar_rank").first()
    rows = spark.createDataFrame([(text.exemplar,), ("zzz qqq",), (None,)], "eval_text string")
    best = encoder.best_by_domain(encoder.exemplar_scores(rows, tax, encoder.hashing_encoder()))
    got = {(r.eval_text, r.domain): r for r in best.where("score is not null").collect()}
    assert got[text.exemplar, "Bank / Institution"].label == text.label and got[text.exemplar, "Bank / Institution"].score == pytest.approx(1.0)
    assert {k[0] for k in got} == {text.exemplar, "zzz qqq"} and len(got) == 8


def test_prototype_store(spark, tmp_path):
    rows = [("Transaction Mode", "A", "one two"), ("Transaction Mode", "A", "three"), ("Transaction Mode", "B", "one"), ("Transaction Mode", "C", " "), ("New / Kind", "D", "x")]
    given = spark.createDataFrame(rows, "domain string, label string, exemplar string")
    parts = encoder.prototypes(given, encoder.hashing_encoder(64))
    root = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        stores.read_bundle(spark, root)
    stores.write_bundle(parts, root)
    got = stores.read_bundle(spark, root)
    assert set(got) == set(parts)
    unit = lambda v: v / np.linalg.norm(v)
    each = {r.exemplar: np.array(r.v) for r in got["exemplars"].collect()}
    labels = {r.label: np.array(r.v) for r in got["labels"].collect()}
    assert set(labels) == {"A", "B", "D"} and np.allclose(labels["A"], unit(each["one two"] + each["three"]))
    domains, classes = ({r.domain: np.array(r.v) for r in got[k].collect()}["Transaction Mode"] for k in ("domains", "classes"))
    assert np.allclose(domains, unit(labels["A"] + labels["B"])) and np.allclose(classes, unit(each["one two"] + each["three"] + each["one"]))
    assert {(r.domain_id, r.folder_key, r.label, tuple(r.exemplars)) for r in got["metadata"].collect()} == {(1, "1_transaction_mode", "A", ("one two", "three")), (1, "1_transaction_mode", "B", ("one",)), (9, "9_new_kind", "D", ("x",))}
    stores.write_bundle(parts | {"labels": parts["labels"].where("label = 'A'")}, root)
    assert stores.read_bundle(spark, root)["labels"].count() == 1 and stores.read_bundle(spark, root, back=1)["labels"].count() == 3


def test_scores_of_vectors_that_are_not_whole(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0])]
    protos = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 0, None), ("b", 1, [0.0, None])], "label string, label_rank int, v array<double>")
    v = spark.createDataFrame(rows, "id int, v array<double>")
    assert {r.id: (r.label, r.score) for r in vectors.label_scores(v, protos).collect()} == {1: ("a", 1.0), **{i: ("a", None) for i in (2, 3, 4, 5)}}
    assert vectors.label_scores(v, protos.where("label = 'b'")).count() == 0 and vectors.label_scores(v.limit(0), protos).count() == 0


def test_matrix_scores_equal_expressions(spark):
    rng = np.random.default_rng(5)
    p, x = rng.normal(size=(11, 6)), rng.normal(size=(20, 6))
    protos = spark.createDataFrame([(f"l{i % 3}", i % 3, p[i].tolist()) for i in range(11)], "label string, label_rank int, v array<double>")
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "id int, v array<double>")
    for pool, fn in (("max", np.max), ("mean", np.mean), ("top3", lambda s: np.sort(s)[-3:].mean())):
        got = {(r.id, r.label): r.score for r in vectors.label_scores(v, protos, pool).collect()}
        assert got == pytest.approx({(i, f"l{k}"): fn(x[i] @ p[k::3].T) for i in range(20) for k in range(3)})


def test_readers_stand_in_order(spark):
    files = spark.createDataFrame([("good", b"1"), ("second", b"2"), ("bad", b"3"), ("none", b"")], "path string, content binary")

    def grid(path, content):
        if path in ("second", "bad"):
            raise ValueError("no grid")
        return [(path, 1, "grid")] if content else []

    def words(path, content):
        if path == "bad":
            raise OSError("no words")
        return [(path, 1, "words")] if content else []

    got = {(r.source_file, r.text, r.error) for r in documents.read_with(files, grid, words, schema=documents.PAGES).collect()}
    assert got == {("good", "grid", None), ("second", "words", None), ("bad", None, "ValueError: no grid; OSError: no words")}
    only = {r.source_file: r.error for r in documents.read_with(files, grid, words, schema=documents.PAGES, one_only=True).collect()}
    assert only == {"good": None, "second": "ValueError: no grid", "bad": "ValueError: no grid"}


def test_tables_are_split_whole(spark):
    rows = [("f", 1, 0, 0, ["Name", "x"]), ("f", 1, 0, 1, [" nan ", "y"]), ("f", 1, 1, 0, ["a", "b", "c", "d"]), ("f", 1, 1, 1, ["a", "b"]), ("f", None, 2, 0, ["K", None]), ("f", 1, 3, 0, ["a", "b", "c"])]
    cells = spark.createDataFrame(rows, documents.CELLS)
    meta, moves = documents.split_tables(cells)
    assert meta.columns == cells.columns and sorted((r.table_id, r.row_idx) for r in moves.collect()) == [(1, 0), (1, 1)]
    assert {(r.field, r.value) for r in documents.metadata_pairs(meta).collect()} == {("Name", "x"), ("K", None)}


def test_first_file_that_exists(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,Narration\n1,UPI\n2,\n")
    paths = [f"file://{tmp_path}/{n}" for n in ("a.parquet", "b.csv", "c.xlsx")]
    df = stores.read_first(spark, paths)
    texts, more = stores.described(df, spark.range(5))
    assert sorted(r.description for r in texts.collect()) == ["UPI", "nan"] and more == -3
    with pytest.raises(FileNotFoundError):
        stores.read_first(spark, paths[:1])
    with pytest.raises(ValueError, match="xlsx"):
        stores.read_first(spark, paths[2:])
    assert stores.read_first(spark, paths[2:], xlsx=lambda s, p: s.range(3)).count() == 3


def test_csv_and_union(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "é,\"x"), (None, None)], "i int, t string"), spark.createDataFrame([(2.5,)], "u double")
    both = stores.union_statements([a, b])
    assert both.columns == ["i", "t", "u"] and both.count() == 2
    stores.write_csv(a.where("i = 1"), f"file://{tmp_path}/out", single=True)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1 and spark.read.option("header", True).option("escape", "\\").csv(f"file://{tmp_path}/out").first()["t"] == "é,\"x"


def test_terms_of_centres(spark):
    docs = spark.createDataFrame([(i, ("river stone stone" if i % 2 else "garden bloom the bloom")) for i in range(10)] + [(10, None), (10, "river")], "k int, text string")
    weights, vocabulary = clusters.tf_idf_weights(docs, "k", "text")
    assert vocabulary == ["bloom", "garden", "river", "stone"] and weights.groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    own, words = clusters.tf_idf_weights(docs, "k", "text", features=2, stop=["stone"])
    assert words == ["bloom", "river"] and own.count() == 11
    found, vocabulary = clusters.tf_idf(docs, "k", "text")
    terms = clusters.centre_terms(spark, clusters.k_means(found, 2)[1], vocabulary, 2)
    assert {frozenset(r.term for r in terms.where(F.col("cluster") == c).collect()) for c in (0, 1)} == {frozenset({"river", "stone"}), frozenset({"bloom", "garden"})}
    empty, none = clusters.tf_idf(docs.where("text is null"), "k", "text")
    assert none == [] and empty.count() == 1


def test_workbook_places(spark):
    rows = spark.createDataFrame([("f", 2, "b", "", "5"), ("f", 1, "a", " ", ""), ("f", 3, "c", "1", "2"), ("f", 4, None, None, None), ("g", 1, "z", "", "")], "source_file string, i int, Description string, Debit string, Credit string")
    meta = spark.createDataFrame([("f", {"Bank Name": "b", "PAN": "P", "Nominee": "N", "Interest Rate": "1%", "Address": "home"}), ("h", {"Bank Name": "only"})], "source_file string, fields map<string,string>")
    got = workbook.statement_cells(rows, ["Description", "Debit", "Credit"], ["i"], meta).collect()
    at = {(r.source_file, r.sheet, r.row, r.col): r for r in got}
    assert len(at) == len(got)
    f = lambda row, col, sheet=workbook.LEDGER, file="f": at[file, sheet, row, col].value
    assert f(1, 1) == "🏦  B  –  ACCOUNT STATEMENT" and f(1, 1, file="g") == "🏦  BANK STATEMENT  –  ACCOUNT STATEMENT" and f(5, 2) == "home" and f(10, 1) == "PAN" and f(11, 5) == "Interest Rate" and f(9, 6) == "—"
    assert (f(13, 1), f(14, 1), f(14, 3)) == ("📊  TRANSACTION LEDGER", "Description", "Credit") and f(13, 1, file="g") == "Description"
    assert [(f(14 + k, 1), at["f", workbook.LEDGER, 14 + k, 1].style) for k in (1, 2, 3, 4)] == [("a", "odd"), ("b", "credit"), ("c", "debit"), (None, "even")]
    assert f(2, 1, workbook.METADATA) == "Address" and f(6, 2, workbook.METADATA) == "P" and ("g", workbook.METADATA, 1, 1) not in at and ("h", workbook.METADATA, 2, 1) in at
    assert workbook.widths(["Debit", "Description", "x"]) == {"Debit": 18, "Description": 48} and {r.style for r in got} <= set(workbook.STYLES)
    plain = workbook.statement_cells(rows.select("source_file", "i", "Description"), ["Description"], ["i"], meta)
    assert {r.style for r in plain.where("row > 14 and sheet = 'Transactions'").collect()} == {"odd", "even"}


def test_manifest_of_two_writers_and_going_back(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    frame = lambda i: spark.createDataFrame([(i,)], "i int")
    assert stores.latest(spark, root) == 0
    for i in (1, 2, 3):
        stores.write_version(frame(i), root)
    assert stores.latest(spark, root) == 3 and [stores.read_version(spark, root, b).first()[0] for b in (0, 1, 2)] == [3, 2, 1]
    stores.write_version(frame(4), root, expected=3)
    with pytest.raises(stores.StaleVersion):  # the second writer built on 3 as well
        stores.write_version(frame(5), root, expected=3)
    with pytest.raises(stores.StaleVersion):  # or comes between the look and the entry
        stores._commit(spark, root, "lost", 3)
    assert stores.read_version(spark, root).first()[0] == 4 and len(list((tmp_path / "store" / "versions").iterdir())) == 4
    assert stores.roll_back(spark, root) == 5 and stores.read_version(spark, root).first()[0] == 3
    assert stores.roll_back(spark, root) == 6 and stores.read_version(spark, root).first()[0] == 4
    (tmp_path / "store" / "manifest" / "000000000007.json").write_text("")  # a writer that died
    assert stores.latest(spark, root) == 6 and stores.read_version(spark, root).first()[0] == 4


def test_embedding_cache_encodes_new_texts_only(spark):
    cache, calls = stores.EmbeddingCache(spark, "test_embedding_cache", 4), []

    def encode(texts):
        calls.append(texts.count())
        return encoder.encode(texts, encoder.hashing_encoder(8))

    spark.sql("DROP TABLE IF EXISTS test_embedding_cache")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(f"text {i % 7}",) for i in range(20)] + [(None,)], "eval_text string")
        assert cache.fill(texts, encode) == 7 and cache.fill(texts, encode) == 0
        assert cache.fill(texts.unionByName(spark.createDataFrame([("new",)], "eval_text string")), encode) == 1 and calls == [7, 1]
        plan = cache.missing(texts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the texts', none of the cache
        cache.compact()
        got = {r.eval_text: r.v for r in cache.found(texts).collect()}
        want = {r.eval_text: r.v for r in encoder.encode(texts, encoder.hashing_encoder(8)).collect()}
        assert got == want and cache.rows().count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS test_embedding_cache")


def test_svd_bounds_the_rows_of_a_worker(spark):
    """Ten thousand dense vectors of a vocabulary at a time, in every worker, are too many."""
    own = spark.newSession()
    rows = own.range(50).select(array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("vector"))
    _, values = clusters.svd(rows)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and values[0] > values[1] > 0


def test_a_text_is_encoded_once_for_all_its_labels(spark, tmp_path):
    """Labels, domains and classes come from one pass of the encoder."""
    seen = str(tmp_path)

    def load():
        run = encoder.hashing_encoder(16)()

        def counted(texts):
            with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                f.writelines(f"{t}\n" for t in texts)
            return run(texts)

        return counted

    rows = [(d, label, f"word{i} x") for i in range(40) for d, label in (("A", "a"), ("A", "b" if i % 2 else "c"), ("B", "d"))]
    parts = encoder.prototypes(spark.createDataFrame([*rows, rows[0]], "domain string, label string, exemplar string").repartition(3), load)
    assert {k: parts[k].count() for k in ("labels", "domains", "classes")} == {"labels": 4, "domains": 2, "classes": 2}
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for k in ("labels", "domains", "classes") for r in parts[k].collect())
    said = [line for p in tmp_path.iterdir() for line in p.read_text().splitlines()]
    assert sorted(said) == sorted(f"{encoder.PREFIX}word{i} x" for i in range(40))


def test_only_the_vocabulary_is_shuffled(spark):
    """What is weighed is written once by key; giving the weights shuffles nothing more."""
    docs = spark.createDataFrame([(1, "stone stone river"), (1, "river tree"), (2, "tree sky"), (None, "stone")], "k int, text string")
    found, vocabulary = clusters.tf_idf_weights(docs, "k", "text", features=3, stop=[])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and vocabulary == ["river", "stone", "tree"]
    got = {(r.k, r.word): r.weight for r in found.collect()}
    raw = {"river": 2 * (math.log(3 / 2) + 1), "stone": 2 * (math.log(3 / 2) + 1), "tree": 1.0}
    length = math.sqrt(sum(x * x for x in raw.values()))
    assert got == {**{(1, w): pytest.approx(x / length) for w, x in raw.items()}, (2, "tree"): pytest.approx(1.0)}
    assert clusters.tf_idf_weights(docs.limit(0), "k", "text")[0].count() == 0

"""Queries on the driver's tables, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.taxonomy import GATES, TAXONOMY
from ..operators import clusters, ledger, vectors

# The ledger bridge, the same SQL in both engines: narrations and running balances from orders.
_NM = "CASE o_custkey % 5 WHEN 0 THEN 'RAMESH VORA' WHEN 1 THEN 'NISHA JHAVERI' WHEN 2 THEN 'SANDEEP SWAIN' WHEN 3 THEN 'CONSUMER PRODUCTS INDIA' ELSE 'DAILY NEEDS LIMITED' END"
_REF = "lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '7')"
BRIDGE = f"""
SELECT o_orderkey, o_custkey % 10 AS file_id, o_orderdate AS txn_date,
  CASE o_orderkey % 12
    WHEN 0 THEN concat('UPI-', {_NM}, '-user', CAST(o_custkey AS VARCHAR(20)), '@okicici') WHEN 1 THEN concat('UPI-ZOMATO LTD-zomato@hdfcbank-', {_REF})
    WHEN 2 THEN concat('NEFT-CNRBR', {_REF}, '-HDFC0004171-', {_NM}, '-/NONE') WHEN 3 THEN concat('RTGS Dr-ICICR', {_REF}, '-', {_NM}, '/URGENT/')
    WHEN 4 THEN concat('IMPS BRN SALARY TRF BY - ', {_NM}) WHEN 5 THEN concat('ATM WDL-ATM CASH ', CAST(o_orderkey AS VARCHAR(20)))
    WHEN 6 THEN concat('CASH-BNA-SELF-', {_NM}) WHEN 7 THEN concat('Chq Paid - MICR Inward Clearing - ', {_NM}, ' - HDFC BANK LTD')
    WHEN 8 THEN 'Service Charges - SMS CHARGES' WHEN 9 THEN concat('NEFT Dr-', {_REF}, '-MONTHLY RENT')
    WHEN 10 THEN 'SENT-TRANSFER FROM 7221215049 _A_9 x--y' ELSE ' ' END AS narration,
  CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS amount,
  CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS VARCHAR(30)) ELSE '' END AS debit,
  CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS VARCHAR(30)) ELSE '' END AS credit,
  CASE WHEN o_orderkey % 7 = 0 THEN 'CR' WHEN o_orderkey % 7 = 1 THEN 'DR' ELSE '' END AS cr_dr
FROM orders"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(re.sub(r"FROM orders$", "FROM {orders}", BRIDGE), orders=orders)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql(steps: tuple, start: str) -> str:
    """Nested replacements; the dialect has no classes for Unicode, and the bridge is ASCII."""
    out = start
    for pattern, to in steps:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        out = f"regexp_replace({out}, {_q(pattern.removeprefix('(?i)'))}, {_q(to.replace('$1$2', chr(92) + '1' + chr(92) + '2'))}, '{flags}')"
    return out


_T = f"trim({_clean_sql(text.CLEAN_STEPS, 'trim(narration)')}, ' -:,./')"
_EVAL = f"CASE WHEN length({_T}) > 0 THEN {_T} ELSE narration END"
_STRONG = f"trim(regexp_replace(trim({_clean_sql(text.STRONG_STEPS, 'trim(narration)')}), '^[^0-9A-Za-z_]+|[^0-9A-Za-z_]+$', '', 'g'))"
_DEEP = f"lower(array_to_string(list_filter(string_split({_clean_sql(text.DEEP_STEPS, 'upper(trim(narration))')}, ' '), lambda t: length(t) >= 2), ' '))"


def _rule_sql(expr: str, rule_list: tuple, default: str | None = None) -> str:
    whens = " ".join(f"WHEN regexp_matches(upper({expr}), {_q(rf'\b({w})\b' if kind == 'word' else w)}) THEN {_q(label)}" for label, kind, w in rule_list)
    return f"CASE {whens} ELSE {_q(default) if default else 'NULL'} END"


def _word_sql(expr: str, words: str) -> str:
    return rf"regexp_matches(upper({expr}), {_q(rf'\b({words})\b')})"


_VAL = "CASE WHEN replace(replace({0}, 'Rs.', ''), ',', '') IN ('', '0', '0.0', '0.00', '-', 'nan', 'None') THEN false ELSE true END"
_HD, _HC = _VAL.format("debit"), _VAL.format("credit")
_DIR = f"""CASE WHEN {_HD} AND NOT {_HC} THEN 'Debit' WHEN {_HC} AND NOT {_HD} THEN 'Credit' WHEN cr_dr = 'CR' THEN 'Credit' WHEN cr_dr = 'DR' THEN 'Debit' ELSE
 CASE WHEN {_word_sql('eval_text', rules.DEBIT_PHRASES)} THEN 'Debit' WHEN {_word_sql('eval_text', rules.CREDIT_WORDS)} AND NOT {_word_sql('eval_text', rules.DEBIT_WORDS)} THEN 'Credit'
 WHEN {_word_sql('eval_text', rules.DEBIT_WORDS)} THEN 'Debit' ELSE 'Debit' END END"""


def _person_sql(pattern: str, veto: str) -> str:
    name = f"trim(regexp_extract(upper(narration), {_q(pattern)}, 1))"
    words = f"list_filter(string_split({name}, ' '), lambda w: w <> '')"
    return f"(len({words}) >= 2 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^[A-Z]+$'))) = 0 AND NOT {_word_sql(name, veto)})"


_PURPOSE = f"coalesce({_rule_sql('narration', rules.PURPOSE)}, CASE WHEN {_person_sql(rules.PERSON, rules.NOT_PERSONS)} OR regexp_matches(upper(narration), {_q(rules.SALUTED)}) THEN 'Personal / P2P Transfer' END)"
_WEAK_PURPOSE = f"coalesce({_rule_sql('narration', rules.WEAK_PURPOSE)}, CASE WHEN {_person_sql(rules.WEAK_PERSON, rules.WEAK_NOT_PERSONS)} THEN 'Personal / P2P Transfer' END)"
_B = f"WITH b AS ({BRIDGE}), e AS (SELECT *, {_EVAL} AS eval_text FROM b)"
_EXEMPLAR = """length(phrase) >= 12 AND len(list_filter(string_split(phrase, ' '), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$'))) >= 3
 AND NOT regexp_matches(phrase, '^([0-9]+\\s+upi|collect request|esb|hdfc0|upi$|[0-9]+$)')
 AND len(list_filter(string_split(phrase, ' '), lambda t: regexp_matches(t, '^[0-9]+$'))) <= 0.5::DOUBLE * greatest(len(list_filter(string_split(phrase, ' '), lambda t: t <> '')), 1)"""
_WEAK = f"""{_B}, d AS (SELECT *, {_DEEP} AS phrase FROM e), g AS (SELECT * FROM d WHERE {_EXEMPLAR}),
u AS (SELECT 'Transaction Mode' AS domain, {_rule_sql('narration', rules.WEAK_MODE)} AS label, phrase FROM g
 UNION ALL SELECT 'Transaction Direction', CASE WHEN {_HD} THEN 'Debit' WHEN {_HC} THEN 'Credit' WHEN cr_dr = 'CR' THEN 'Credit' WHEN cr_dr = 'DR' THEN 'Debit' END, phrase FROM g
 UNION ALL SELECT 'Transaction Purpose', {_WEAK_PURPOSE}, phrase FROM g UNION ALL SELECT 'Bank / Institution', {_rule_sql('narration', rules.WEAK_BANK)}, phrase FROM g),
w AS (SELECT DISTINCT domain, label, phrase FROM u WHERE label IS NOT NULL)"""
_V = """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1.0::DOUBLE ELSE sqrt(list_dot_product(e, e)) END) AS v FROM n),
s AS (SELECT q.vec_id AS id, p.label, list_dot_product(q.v, p.v) AS s FROM v q, v p WHERE p.vec_id < 100 AND q.vec_id >= 100),
m AS (SELECT id, label, max(s) AS mx, avg(s) AS mean, list_sum(list_slice(list_reverse_sort(list(s)), 1, 3)) / least(3, count(*)) AS top3 FROM s GROUP BY id, label)"""


def _b(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(bridge(spark, sf_dir))


def _derived(make: Callable[[Column], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    """What is derived from narrations, once for each distinct one."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = bridge(spark, sf_dir).select("o_orderkey", "narration")
        return ledger.per_distinct(rows, "narration", make).drop("narration")

    return run


def _evald(df: DataFrame) -> DataFrame:
    return df.withColumn("eval_text", text.eval_text(F.col("narration")))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", vectors.normalise(F.col("embedding")).alias("v"))


def _scores(spark: SparkSession, sf_dir: str, pool: str = "max") -> DataFrame:
    """Exemplars are the vectors below 100, the bound of their number."""
    v = _unit(spark, sf_dir)
    prototypes = v.where("vec_id < 100").select(F.col("label").cast("string").alias("label"), F.col("label").alias("label_rank"), "v")
    return vectors.label_scores(v.where("vec_id >= 100").select(F.col("vec_id").alias("id"), "v"), prototypes, pool)


def _pooled(pool: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _scores(s, d, pool).select("id", F.col("label").cast("int").alias("label"), (F.round("score", 4) + 0.0).alias("score"))


def _balances(df: DataFrame) -> DataFrame:
    """Every fifth row direct; the others with two, one or no raw amounts, the second a running sum in cents."""
    order = Window.partitionBy("file_id").orderBy("txn_date", "o_orderkey")
    run = F.sum(F.when(F.col("debit") != "", -F.col("amount")).otherwise(F.col("amount"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,2)")
    rows = df.withColumn("run", run.cast("string")).withColumn("row_idx", F.row_number().over(order))
    amounts = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 11 == 0, F.array("run")).when(F.col("o_orderkey") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("amount").cast("string"), F.col("run")))
    shaped = rows.select(
        F.col("o_orderkey"), F.col("file_id").cast("string").alias("source_file"), F.lit(1).alias("page_num"), "row_idx", F.col("narration").alias("description"), (F.col("o_orderkey") % 5 == 0).alias("direct"),
        "debit", "credit", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Rs. "), F.col("run"))).alias("balance"), amounts.alias("raw_amounts"),
    )
    return ledger.balance_engine(shaped).select("o_orderkey", "debit", "credit", "balance")


_W1 = f"""WITH b AS ({BRIDGE}), r AS (SELECT *, CAST(sum(CASE WHEN debit <> '' THEN -amount ELSE amount END) OVER (PARTITION BY file_id ORDER BY txn_date, o_orderkey ROWS UNBOUNDED PRECEDING) AS DECIMAL(18, 2)) AS run,
 CASE WHEN o_orderkey % 5 = 0 THEN 9 WHEN o_orderkey % 11 = 0 THEN 1 WHEN o_orderkey % 13 = 0 THEN 0 ELSE 2 END AS k FROM b),
p AS (SELECT *, last_value(CASE WHEN k > 0 THEN run::DOUBLE END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY txn_date, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
c AS (SELECT *, CASE WHEN prev IS NULL THEN regexp_matches(lower(narration), 'by clg|cr|salary|deposit|upi/cr') ELSE round(run::DOUBLE - prev, 2) > 0 END AS up FROM p)
SELECT o_orderkey, CASE WHEN k = 9 THEN debit WHEN k = 2 AND NOT up THEN 'Rs. ' || amount::VARCHAR ELSE '' END AS debit,
 CASE WHEN k = 9 THEN credit WHEN k = 2 AND up THEN 'Rs. ' || amount::VARCHAR ELSE '' END AS credit, CASE WHEN k > 0 THEN 'Rs. ' || run::VARCHAR ELSE '' END AS balance FROM c"""



def _classified(df: DataFrame) -> DataFrame:
    return ledger.classify(df, flag="cr_dr").select("o_orderkey", "mode", "direction", "purpose", "bank")


def _under_many_names(df: DataFrame) -> DataFrame:
    """Entries and flags under several of the names that statements use, a side now here, now there."""
    odd = F.col("o_orderkey") % 2 == 1
    spread = {"Debit": F.lit(" - "), "Withdrawal Amt.": F.when(odd, F.col("debit")), "Dr": F.when(~odd, F.concat(F.lit("Rs. "), "debit")), "Credit Amount": F.when(odd, F.col("credit")), "Cr": F.when(~odd, F.col("credit")), "Type": F.lit("transfer"), "CR_DR": F.lower("cr_dr")}
    rows = df.select("o_orderkey", "narration", *[c.alias(n) for n, c in spread.items()])
    return ledger.classify(rows, debit=None, credit=None).select("o_orderkey", "direction")


_CLASSIFIED = f"""{_B} SELECT o_orderkey, {_rule_sql('eval_text', rules.MODE, 'Other')} AS mode, {_DIR} AS direction, coalesce({_PURPOSE}, 'General Transfer') AS purpose,
 {_rule_sql('eval_text', rules.BANK, 'Not Mentioned')} AS bank FROM e"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whatever its language."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, words, vector, cluster): K-means on TF-IDF."""
    return clusters.k_means(clusters.tf_idf(_texts(spark, sf_dir), "doc_id", "text")[0].drop("text"))[0]


def _tfidf_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.sizes(_clustered(spark, sf_dir))


def _keyword_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.keyword_ranks(_clustered(spark, sf_dir))


#: What queries with SQL leave out; a caller's own list goes in the same way.
STOP = ["the", "and", "of", "to", "in", "de", "la", "der", "die", "und", "el", "le"]
_STOPPED = ", ".join(_q(w) for w in STOP)


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by a rule, five of six of them with records."""
    return _texts(spark, sf_dir).select((F.col("doc_id") % 5).cast("int").alias("cluster"), clusters.word_list(F.col("text"), STOP).alias("words"))


def _ruled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ruled(spark, sf_dir)
    return clusters.whole_report(clusters.keyword_ranks(rows), clusters.sizes(rows), 6)


_WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS word FROM documents"
_RANKED = f"""w AS ({_WORDS}), f AS (SELECT (doc_id % 5)::INT AS cluster, word AS keyword, count(*) AS frequency FROM w WHERE word NOT IN ({_STOPPED}) GROUP BY ALL),
n AS (SELECT (doc_id % 5)::INT AS cluster, count(*) AS total_records FROM documents GROUP BY ALL),
r AS (SELECT cluster, total_records, (row_number() OVER (PARTITION BY cluster ORDER BY frequency DESC, keyword))::INT AS rank, keyword, frequency FROM f JOIN n USING (cluster))"""
_REPORT = f"""WITH {_RANKED}, c AS (SELECT i::INT AS cluster, coalesce(total_records, 0) AS n, coalesce((SELECT max(rank) FROM r WHERE r.cluster = i), 0) AS words FROM range(6) k(i) LEFT JOIN n ON n.cluster = i)
SELECT cluster, rank::BIGINT AS line_no, format('{{:<40s}} | {{:<10d}}', keyword, frequency) AS line FROM r
UNION ALL SELECT cluster, x.no, x.line FROM c, LATERAL (VALUES (-4, repeat('=', 80)), (-3, format('CLUSTER {{}} (Total Records: {{}})', cluster, n)), (-2, repeat('=', 80)), (-1, format('{{:<40s}} | {{:<10s}}', 'Keyword', 'Frequency')), (0, repeat('-', 80)), (words + 2, ''), (words + 3, '')) x(no, line)
UNION ALL SELECT cluster, 1, CASE WHEN n = 0 THEN 'No records in this cluster.' ELSE 'No distinctive keywords found.' END FROM c WHERE words = 0
UNION ALL SELECT 0, x.no, x.line FROM (VALUES (-8, repeat('=', 80)), (-7, repeat(' ', 17) || 'K-MEANS CLUSTERING KEYWORDS & FREQUENCY REPORT'), (-6, repeat('=', 80)), (-5, '')) x(no, line)"""


def _svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.singular_values(clusters.tf_idf(_texts(spark, sf_dir), "doc_id", "text")[0])


def _svd_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = clusters.svd(clusters.tf_idf(_texts(spark, sf_dir), "doc_id", "text")[0])
    return found.select("doc_id", F.col("svd")[0].alias("x"), F.col("svd")[1].alias("y"))


def _embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = _unit(spark, sf_dir).select("vec_id", array_to_vector("v").alias("vector"))
    return clusters.sizes(clusters.k_means(rows, 2)[0])


def merged_exemplars(df: DataFrame) -> DataFrame:
    """(domain, label, rank, exemplar): the taxonomy's, then the best of the ledger's own."""
    return ledger.merge_exemplars(ledger.taxonomy(df.sparkSession), ledger.top_exemplars(ledger.weak_labels(df)))


def _merged(df: DataFrame) -> DataFrame:
    return merged_exemplars(df).groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n_exemplars"))


_BASE = "base(domain, label, phrase) AS (VALUES " + ", ".join(f"({_q(d)}, {_q(label)}, {_q(e)})" for d, labels in TAXONOMY.items() for label, es in labels.items() for e in es) + ")"
_MERGED = f"""{_WEAK}, t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY domain, label ORDER BY length(phrase) DESC, phrase) <= 6), {_BASE},
n AS (SELECT domain, label FROM base UNION ALL SELECT domain, label FROM t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.domain = t.domain AND b.label = t.label AND b.phrase = t.phrase))
SELECT domain, label, count(*) AS n_exemplars FROM n GROUP BY ALL"""

_PLACED = "placed(domain, label, rank, exemplar) AS (VALUES " + ", ".join(f"({_q(d)}, {_q(label)}, {i}, {_q(e)})" for d, labels in TAXONOMY.items() for label, es in labels.items() for i, e in enumerate(es)) + ")"
_RANKED_EXEMPLARS = f"""{_WEAK}, {_PLACED}, t AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY length(phrase) DESC, phrase) AS k FROM w QUALIFY k <= 6),
fresh AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM placed b WHERE b.domain = t.domain AND b.label = t.label AND b.exemplar = t.phrase)),
merged AS (SELECT domain, label, rank::INT AS rank, exemplar FROM placed UNION ALL
 SELECT domain, label, ((SELECT count(*) FROM placed b WHERE b.domain = f.domain AND b.label = f.label) + row_number() OVER (PARTITION BY domain, label ORDER BY k) - 1)::INT, phrase FROM fresh f)"""

SWEEP = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]

#: name: (query, SQL or None)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "t1_clean_description": (_derived(lambda t: {"cleaned": text.clean_description(t)}), f"{_B} SELECT o_orderkey, {_T} AS cleaned FROM b"),
    "t2_strong_clean": (_derived(lambda t: {"cleaned": text.strong_clean(t)}), f"{_B} SELECT o_orderkey, {_STRONG} AS cleaned FROM b"),
    "t3_deep_clean": (_derived(lambda t: {"cleaned": text.deep_clean(t)}), f"{_B} SELECT o_orderkey, {_DEEP} AS cleaned FROM b"),
    "t4_eval_text": (_b(lambda b: _evald(b).select("o_orderkey", "eval_text")), f"{_B} SELECT o_orderkey, eval_text FROM e"),
    "t5_encoder_text": (_b(lambda b: _evald(b).select("o_orderkey", F.concat(F.lit("search_document: "), "eval_text").alias("t"))), f"{_B} SELECT o_orderkey, 'search_document: ' || eval_text AS t FROM e"),
    "t6_amount": (_b(lambda b: b.select("o_orderkey", text.amount(F.concat(F.lit("Rs. "), "debit")).alias("value"))), f"{_B} SELECT o_orderkey, coalesce(TRY_CAST(debit AS DOUBLE), 0.0::DOUBLE) AS value FROM b"),
    "t7_title_case": (
        _b(lambda b: b.select("o_orderkey", text.title_case(F.col("narration")).alias("t"))),
        f"{_B} SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(narration, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1]) || lower(substr(r, 2))), '') AS t FROM b",
    ),
    "t8_slug": (_b(lambda b: b.select("o_orderkey", text.slug(F.concat("narration", F.lit(" / A/B"))).alias("slug"))), f"{_B} SELECT o_orderkey, replace(replace(replace(lower(concat(narration, ' / A/B')), ' / ', '_'), ' ', '_'), '/', '_') AS slug FROM b"),
    "t9_tokens": (
        lambda s, d: _texts(s, d).select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")),
        f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word",
    ),
    "t9_words_without_stop_words": (
        lambda s, d: _texts(s, d).select("doc_id", F.size(clusters.word_list(F.col("text"), STOP)).alias("n_words")),
        f"WITH w AS ({_WORDS}), c AS (SELECT doc_id, count(*) FILTER (WHERE word NOT IN ({_STOPPED})) AS n FROM w GROUP BY doc_id) SELECT doc_id, coalesce(n, 0)::INT AS n_words FROM documents LEFT JOIN c USING (doc_id)",
    ),
    "r1_mode": (_b(lambda b: _evald(b).select("o_orderkey", rules.first_rule(F.col("eval_text"), rules.MODE).alias("mode"))), f"{_B} SELECT o_orderkey, {_rule_sql('eval_text', rules.MODE)} AS mode FROM e"),
    "r2_r3_direction": (_b(lambda b: _classified(b).select("o_orderkey", "direction")), f"{_B} SELECT o_orderkey, {_DIR} AS direction FROM e"),
    "r2_named_columns": (_b(_under_many_names), f"{_B} SELECT o_orderkey, {_DIR} AS direction FROM e"),
    "r4_r5_purpose": (_b(lambda b: b.select("o_orderkey", rules.purpose_rule(F.col("narration")).alias("purpose"))), f"{_B} SELECT o_orderkey, {_PURPOSE} AS purpose FROM b"),
    "r6_bank": (_b(lambda b: _evald(b).select("o_orderkey", rules.first_rule(F.col("eval_text"), rules.BANK).alias("bank"))), f"{_B} SELECT o_orderkey, {_rule_sql('eval_text', rules.BANK)} AS bank FROM e"),
    "r7_counterparty": (_derived(lambda t: {"party": rules.counterparty(t)}), None),
    "r8_weak_mode": (_b(lambda b: b.select("o_orderkey", rules.first_rule(F.col("narration"), rules.WEAK_MODE).alias("label"))), f"{_B} SELECT o_orderkey, {_rule_sql('narration', rules.WEAK_MODE)} AS label FROM b"),
    "r9_weak_direction": (
        _b(lambda b: b.select("o_orderkey", rules.weak_direction(text.has_value(F.col("debit")), text.has_value(F.col("credit")), F.col("cr_dr")).alias("label"))),
        f"{_B} SELECT o_orderkey, CASE WHEN {_HD} THEN 'Debit' WHEN {_HC} THEN 'Credit' WHEN cr_dr = 'CR' THEN 'Credit' WHEN cr_dr = 'DR' THEN 'Debit' END AS label FROM b",
    ),
    "r10_weak_purpose": (_b(lambda b: b.select("o_orderkey", rules.weak_purpose(F.col("narration")).alias("label"))), f"{_B} SELECT o_orderkey, {_WEAK_PURPOSE} AS label FROM b"),
    "r11_weak_bank": (_b(lambda b: b.select("o_orderkey", rules.first_rule(F.col("narration"), rules.WEAK_BANK).alias("label"))), f"{_B} SELECT o_orderkey, {_rule_sql('narration', rules.WEAK_BANK)} AS label FROM b"),
    "r12_channel": (_b(lambda b: b.select("o_orderkey", rules.channel(F.col("narration")).alias("label"))), f"{_B} SELECT o_orderkey, {_rule_sql('narration', rules.CHANNEL, 'Bank Transfer')} AS label FROM b"),
    "r13_category": (_b(lambda b: b.select("o_orderkey", rules.category(text.strong_clean(F.col("narration")), F.col("narration")).alias("label"))), f"{_B}, c AS (SELECT *, concat({_STRONG}, ' ', narration) AS both_ FROM b) SELECT o_orderkey, {_rule_sql('both_', rules.CATEGORY, 'Personal / Transfer')} AS label FROM c"),
    "classify_ledger": (_b(_classified), _CLASSIFIED),
    "w1_balance_engine": (_b(_balances), _W1),
    "w4_k4_row_style": (
        _b(lambda b: ledger.row_style(b.withColumn("source_file", F.col("file_id")), ["txn_date", "o_orderkey"]).select("o_orderkey", "row_style")),
        f"{_B} SELECT o_orderkey, CASE WHEN debit <> '' THEN 'debit' WHEN credit <> '' THEN 'credit' WHEN row_number() OVER (PARTITION BY file_id ORDER BY txn_date, o_orderkey) % 2 = 0 THEN 'even' ELSE 'odd' END AS row_style FROM b",
    ),
    "a1_a2_a3_summary": (
        _b(lambda b: ledger.summary(b)),
        f"{_B} SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE debit <> '') AS BIGINT) AS n_debits, CAST(count(*) FILTER (WHERE credit <> '') AS BIGINT) AS n_credits, round(sum(coalesce(TRY_CAST(debit AS DOUBLE), 0)), 2) AS total_debit, round(sum(coalesce(TRY_CAST(credit AS DOUBLE), 0)), 2) AS total_credit FROM b",
    ),
    "a4_mode_breakdown": (_b(lambda b: ledger.breakdown(_classified(b), "mode")), f"WITH c AS ({_CLASSIFIED}) SELECT mode, count(*) AS n FROM c GROUP BY mode ORDER BY n DESC, mode"),
    "a4_purpose_breakdown": (_b(lambda b: ledger.breakdown(_classified(b), "purpose")), f"WITH c AS ({_CLASSIFIED}) SELECT purpose, count(*) AS n FROM c GROUP BY purpose ORDER BY n DESC, purpose"),
    "a6_w2_keyword_ranks": (_keyword_ranks, None),
    "a6_w2_ranks_of_ruled_clusters": (lambda s, d: clusters.keyword_ranks(_ruled(s, d)), f"WITH {_RANKED} SELECT cluster, total_records, rank, keyword, frequency FROM r"),
    "c5_k8_whole_report": (_ruled_report, _REPORT),
    "a7_weak_labels": (_b(lambda b: ledger.weak_labels(b)), f"{_WEAK} SELECT domain, label, phrase FROM w"),
    "a8_rows_per_file": (_b(lambda b: b.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))), f"{_B} SELECT file_id, count(*) AS n FROM b GROUP BY file_id"),
    "a9_exemplars_per_domain": (
        _b(lambda b: ledger.weak_labels(b).groupBy("domain").agg(F.count_distinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n"))),
        f"{_WEAK} SELECT domain, count(DISTINCT label) AS n_labels, count(*) AS n FROM w GROUP BY domain",
    ),
    "a10_blank_columns": (_b(lambda b: ledger.blank_columns(b.withColumn("branch", F.lit("")), ["debit", "cr_dr", "branch"])), f"{_B} SELECT bool_and(debit = '') AS debit, bool_and(cr_dr = '') AS cr_dr, true AS branch FROM b"),
    "f1_search": (_b(lambda b: ledger.search(b, " ZomatO ", ["narration", "debit", "credit"]).select("o_orderkey", "narration")), f"{_B} SELECT o_orderkey, narration FROM b WHERE contains(lower(narration), 'zomato') OR contains(lower(debit), 'zomato') OR contains(lower(credit), 'zomato')"),
    "f2_debits_only": (_b(lambda b: ledger.with_entry(b, "debit").select("o_orderkey", "debit")), f"{_B} SELECT o_orderkey, debit FROM b WHERE debit <> ''"),
    "f3_transactions_only": (_b(lambda b: ledger.transactions_only(b.select("narration", "o_orderkey"), "narration")), f"{_B} SELECT narration, o_orderkey FROM b WHERE trim(narration) <> ''"),
    "f6_blank_after_clean": (_b(lambda b: b.withColumn("cleaned", text.strong_clean(F.col("narration"))).where("cleaned <> ''").select("o_orderkey", "cleaned")), f"{_B}, c AS (SELECT o_orderkey, {_STRONG} AS cleaned FROM b) SELECT * FROM c WHERE cleaned <> ''"),
    "f8_exemplar_gate": (_b(lambda b: b.select("o_orderkey", text.deep_clean(F.col("narration")).alias("phrase")).withColumn("good", text.is_exemplar(F.col("phrase")))), f"{_B}, d AS (SELECT o_orderkey, {_DEEP} AS phrase FROM b) SELECT o_orderkey, phrase, {_EXEMPLAR} AS good FROM d"),
    "f11_has_value": (_b(lambda b: b.select("o_orderkey", text.has_value(F.col("debit")).alias("has_debit"))), f"{_B} SELECT o_orderkey, {_HD} AS has_debit FROM b"),
    "o1_top_exemplars": (
        _b(lambda b: ledger.top_exemplars(ledger.weak_labels(b)).select("domain", "label", "rank", "phrase")),
        f"{_WEAK} SELECT domain, label, CAST(row_number() OVER (PARTITION BY domain, label ORDER BY length(phrase) DESC, phrase) AS INT) AS rank, phrase FROM w QUALIFY rank <= 6",
    ),
    "o4_preview": (_b(lambda b: b.orderBy("o_orderkey").limit(15).select("o_orderkey", "narration")), f"{_B} SELECT o_orderkey, narration FROM b ORDER BY o_orderkey LIMIT 15"),
    "u2_merged_exemplars": (_b(_merged), _MERGED),
    "u2_merged_ranks": (_b(merged_exemplars), f"{_RANKED_EXEMPLARS} SELECT domain, label, rank, exemplar FROM merged"),
    "v2_normalise": (lambda s, d: _unit(s, d).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 4).alias("norm2")), f"{_V} SELECT vec_id, round(list_dot_product(v, v), 4) AS norm2 FROM v"),
    "v4_label_score": (_pooled("max"), f"{_V} SELECT id, label, round(mx, 4) AS score FROM m"),
    "v5_v6_best_label": (
        lambda s, d: vectors.best_label(_scores(s, d), 0.3, "none").select("id", "label", F.round("score", 4).alias("score")),
        f"{_V}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mx DESC, label) AS r FROM m) SELECT id, CASE WHEN mx >= 0.3::DOUBLE THEN label::VARCHAR ELSE 'none' END AS label, round(mx, 4) AS score FROM k WHERE r = 1",
    ),
    "v8_top3_score": (_pooled("top3"), f"{_V} SELECT id, label, round(top3, 4) AS score FROM m"),
    "v9_mean_score": (_pooled("mean"), f"{_V} SELECT id, label, round(mean, 4) + 0.0::DOUBLE AS score FROM m"),
    "v10_presence": (
        lambda s, d: vectors.presence(_scores(s, d), ["0", "1", "2"], 0.3, {"2": 0.25}),
        f"{_V} SELECT id, " + ", ".join(f"round(max(mx) FILTER (WHERE label = {i}), 4) AS score_{i}" for i in range(3)) + ", " + ", ".join(f"CASE WHEN round(max(mx) FILTER (WHERE label = {i}), 4) >= {t}::DOUBLE THEN 'Yes' ELSE 'No' END AS has_{i}" for i, t in enumerate((0.3, 0.3, 0.25))) + " FROM m GROUP BY id",
    ),
    "v11_threshold_sweep": (
        lambda s, d: vectors.threshold_sweep(_scores(s, d).select("id", "score"), SWEEP),
        f"{_V}, t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in SWEEP)}]) AS threshold), c AS (SELECT threshold, id, count(*) FILTER (WHERE mx >= threshold) AS k FROM m, t GROUP BY ALL) SELECT threshold, count(*) FILTER (WHERE k > 0) AS classified, count(*) FILTER (WHERE k = 0) AS unclassified, round(avg(k), 4) AS avg_matches, round(100.0::DOUBLE * count(*) FILTER (WHERE k > 0) / count(*), 4) AS percentage FROM c GROUP BY threshold",
    ),
    "v11_class_counts": (
        lambda s, d: vectors.class_counts(_scores(s, d), SWEEP).select("threshold", F.col("label").cast("int").alias("label"), "n"),
        f"{_V} SELECT threshold, label, count(*) FILTER (WHERE mx >= threshold) AS n FROM m, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in SWEEP)}]) AS threshold) GROUP BY ALL",
    ),
    "v12_classify_one": (lambda s, d: vectors.classify_one(_scores(s, d).where("id = 100"), 0.2).select("id", "top", F.array_join("matches", ",").alias("matches")), f"{_V} SELECT id, (arg_max(label, [mx, -label]))::VARCHAR AS top, coalesce(string_agg(label::VARCHAR, ',' ORDER BY label::VARCHAR) FILTER (WHERE mx >= 0.2::DOUBLE), '') AS matches FROM m WHERE id = 100 GROUP BY id"),
    "v13_label_centroids": (
        lambda s, d: vectors.centroids(_unit(s, d), ["label"]).select("label", F.posexplode("v").alias("pos", "x")).select("label", "pos", F.round("x", 4).alias("x")),
        f"{_V}, p AS (SELECT label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM v), a AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY ALL) SELECT label, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 4) AS x FROM a",
    ),
    "v14_domain_centroid": (
        lambda s, d: vectors.centroids(vectors.centroids(_unit(s, d), ["label"]).withColumn("domain", F.lit(1)), ["domain"]).select(F.posexplode("v").alias("pos", "x")).select("pos", F.round("x", 4).alias("x")),
        f"{_V}, p AS (SELECT label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM v), a AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM a), g AS (SELECT pos, avg(x) AS x FROM c GROUP BY pos) SELECT pos::INT AS pos, round(x / sqrt(sum(x * x) OVER ()), 4) AS x FROM g",
    ),
    "c2_tfidf_kmeans": (_tfidf_clusters, None),
    "c3_a5_embedding_kmeans": (_embedding_clusters, None),
    "c5_k8_keyword_report": (lambda s, d: clusters.keyword_report(_keyword_ranks(s, d)), None),
    "c6_svd": (_svd, None),
    "c6_k12_svd_coordinates": (_svd_coordinates, None),
    "c7_pca": (lambda s, d: clusters.project_pca(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding"), None),
}

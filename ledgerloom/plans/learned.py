"""Queries that encode texts, build prototypes, weigh terms and lay out workbooks, with their SQL.

The encoder is the hashing one, which SQL can repeat: a text's words, each at a place by its MD5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import GATES
from ..operators import clusters, encoder, ledger, workbook
from . import queries as q

_SIZE = 256
_HASHED = encoder.hashing_encoder(_SIZE)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.bridge(spark, sf_dir)
    scores = encoder.exemplar_scores(ledger.undecided(rows), ledger.taxonomy(spark), _HASHED)
    best = encoder.best_by_domain(scores.withColumn("score", F.round("score", 9)))  # equal cosines stay equal, however they were added up
    return ledger.classify(rows, flag="cr_dr", scored=best).select("o_orderkey", "mode", "direction", "purpose", "bank")


def _prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of labels, of domains, and of classes, place by place, of all phrases that the ledger's weak labels give."""
    parts = encoder.prototypes(ledger.weak_labels(q.bridge(spark, sf_dir)).withColumnRenamed("phrase", "exemplar"), _HASHED)
    each = [parts[k].select(F.lit(k).alias("part"), "domain", (F.col("label") if k == "labels" else F.lit("")).alias("label"), F.posexplode("v").alias("pos", "x")) for k in ("labels", "domains", "classes")]
    return each[0].unionByName(each[1]).unionByName(each[2]).where("x <> 0").withColumn("x", F.round("x", 6))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's metadata over the taxonomy's exemplars and the best of the ledger's own."""
    return encoder.store_metadata(q.merged_exemplars(q.bridge(spark, sf_dir))).withColumn("exemplars", F.array_join("exemplars", "|"))


def _place(text: str) -> str:
    """(…, b, n): how often each place is hit by a text's words; `text` names a relation with a column `t` and a key `k`."""
    words = f"SELECT k, unnest(regexp_extract_all(lower({q._q(encoder.PREFIX)} || t), '[a-z0-9]+')) AS w FROM {text}"
    return f"SELECT k, CAST(concat('0x', substr(md5(w), 1, 4)) AS INT) % {_SIZE} AS b, count(*)::DOUBLE AS n FROM ({words}) GROUP BY ALL"


_TAX = "tax(domain, label, label_rank, k, t) AS (VALUES " + ", ".join(
    f"({q._q(d)}, {q._q(label)}, {i}, {q._q(f'{d}|{label}|{j}')}, {q._q(e)})" for d, labels in q.TAXONOMY.items() for i, (label, es) in enumerate(labels.items()) for j, e in enumerate(es)
) + ")"
_UNIT = "SELECT k, b, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS x"
_EXEMPLAR_UNIT = f"{_TAX}, tp AS ({_place('tax')}), tu AS ({_UNIT} FROM tp)"
_GATED = " UNION ALL ".join(f"SELECT {q._q(d)} AS domain, {gate}::DOUBLE AS gate" for d, (gate, _) in GATES.items())
_MEANT = ", ".join(f"coalesce({rule}, max(label) FILTER (WHERE domain = {q._q(d)}), {q._q(GATES[d][1])}) AS {name}" for d, name, rule in (
    ("Transaction Mode", "mode", "any_value(r_mode)"), ("Transaction Direction", "direction", "any_value(r_direction)"), ("Transaction Purpose", "purpose", "any_value(r_purpose)"), ("Bank / Institution", "bank", "any_value(r_bank)"),
))
_OPEN_DIRECTION = q._DIR.replace("THEN 'Debit' ELSE 'Debit' END END", "THEN 'Debit' END END")
_CLASSIFIED_SQL = f"""{q._B}, {_EXEMPLAR_UNIT}, texts AS (SELECT DISTINCT eval_text AS k, eval_text AS t FROM e), qp AS ({_place('texts')}), qu AS ({_UNIT} FROM qp),
c AS (SELECT qu.k, tu.k AS p, sum(qu.x * tu.x) AS s FROM qu JOIN tu USING (b) GROUP BY ALL),
m AS (SELECT c.k, domain, label, label_rank, round(max(s), 9) AS s FROM c JOIN tax ON c.p = tax.k GROUP BY ALL),
best AS (SELECT k, domain, label FROM m JOIN ({_GATED}) USING (domain) QUALIFY row_number() OVER (PARTITION BY k, domain ORDER BY s DESC, label_rank) = 1 AND s >= gate),
ruled AS (SELECT o_orderkey, eval_text, {q._rule_sql('eval_text', q.rules.MODE)} AS r_mode, {_OPEN_DIRECTION} AS r_direction, {q._PURPOSE} AS r_purpose, {q._rule_sql('eval_text', q.rules.BANK)} AS r_bank FROM e)
SELECT o_orderkey, {_MEANT} FROM ruled LEFT JOIN best ON eval_text = k GROUP BY o_orderkey"""
_PROTOTYPES_SQL = f"""{q._WEAK}, tax AS (SELECT domain, label, concat(domain, '|', label, '|', phrase) AS k, phrase AS t FROM w), tp AS ({_place('tax')}), tu AS ({_UNIT} FROM tp), pu AS (SELECT domain, label, tax.k, b, x FROM tu JOIN tax USING (k)),
ln AS (SELECT domain, label, count(DISTINCT k) AS n FROM pu GROUP BY ALL), l0 AS (SELECT domain, label, b, sum(x) / any_value(n) AS x FROM pu JOIN ln USING (domain, label) GROUP BY ALL),
l AS (SELECT domain, label, b, x / sqrt(sum(x * x) OVER (PARTITION BY domain, label)) AS x FROM l0),
pd AS (SELECT domain, b, x / sqrt(sum(x * x) OVER (PARTITION BY domain)) AS x FROM (SELECT domain, b, sum(x) AS x FROM l GROUP BY ALL)),
pc AS (SELECT domain, b, x / sqrt(sum(x * x) OVER (PARTITION BY domain)) AS x FROM (SELECT domain, b, sum(x) AS x FROM pu GROUP BY ALL))
SELECT 'labels' AS part, domain, label, b AS pos, round(x, 6) AS x FROM l UNION ALL SELECT 'domains', domain, '', b, round(x, 6) FROM pd UNION ALL SELECT 'classes', domain, '', b, round(x, 6) FROM pc"""
_METADATA_SQL = f"""{q._RANKED_EXEMPLARS}, tax AS (SELECT domain, label, exemplar AS t FROM merged) SELECT CAST(CASE domain {' '.join(f'WHEN {q._q(d)} THEN {i}' for d, i in encoder.DOMAIN_IDS.items())} ELSE {encoder.OTHER} END AS INT) AS domain_id, domain,
concat(domain_id, '_', replace(replace(replace(lower(domain), ' / ', '_'), ' ', '_'), '/', '_')) AS folder_key, label, string_agg(t, '|' ORDER BY t) AS exemplars FROM tax GROUP BY domain, label"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


#: What the query leaves out; a caller's own list goes in the same way.
_STOP = ["the", "and", "of", "to", "in", "de", "la", "der", "die", "und", "el", "le"]


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = clusters.tf_idf_weights(_documents(spark, sf_dir), "doc_id", "text", stop=_STOP)
    return found.select("doc_id", "word", F.round("weight", 6).alias("weight"))


def _centre_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, vocabulary = clusters.tf_idf(_documents(spark, sf_dir), "doc_id", "text")
    return clusters.centre_terms(spark, clusters.k_means(found)[1], vocabulary)


def weights_sql(stop: list[str]) -> str:
    """The SQL of c1_tf_idf_weights with a stop list."""
    listed = ", ".join(q._q(w) for w in stop)
    return f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) AS word FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word NOT IN ({listed}) GROUP BY ALL), v AS (SELECT word, count(*) AS df FROM tf GROUP BY word ORDER BY sum(tf) DESC, word LIMIT 500),
x AS (SELECT doc_id, word, tf * (ln((1.0::DOUBLE + (SELECT count(DISTINCT doc_id) FROM documents)) / (1 + df)) + 1) AS x FROM tf JOIN v USING (word))
SELECT doc_id, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x"""


COLUMNS = ["Txn Date", "Description", "Debit", "Credit", "Balance"]
_FIELDS = "CASE file_id % 3 WHEN 0 THEN map_from_arrays(array('Bank Name', 'PAN', 'Opening Balance'), array('Some Bank', concat('P', file_id), '10.00')) WHEN 1 THEN map_from_arrays(array('Bank Name', 'Interest Rate', 'Nominee', 'Client Address'), array('Other Bank', '3%', 'N', '')) END"


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten statements of the bridge; a third have no metadata."""
    rows = q.bridge(spark, sf_dir)
    day = F.date_format("txn_date", "yyyy-MM-dd")
    shown = rows.select(F.col("file_id").alias("source_file"), "o_orderkey", day.alias("Txn Date"), F.col("narration").alias("Description"), F.col("debit").alias("Debit"), F.col("credit").alias("Credit"), F.col("amount").alias("Balance"))
    fields = rows.select("file_id").distinct().selectExpr("file_id AS source_file", f"{_FIELDS} AS fields")
    return workbook.statement_cells(shown, COLUMNS, ["Txn Date", "o_orderkey"], fields)


def _workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbook_cells(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit("<none>")))


def workbook_sql() -> str:
    """Each statement's cells, from the places that its number of fields gives; the box is listed pair by pair."""
    lit, none = q._q, q._q(workbook.NONE)
    n, mid = 9, 4
    value = {"Bank Name": f"coalesce(bank, {none})", "Opening Balance": f"CASE WHEN kind = 0 THEN 'Rs. 10.00' ELSE {none} END"}
    pairs = lambda box: ", ".join(f"({i}, {lit(label)}, {value.get(field, none)})" for i, (label, field) in enumerate(box))
    extra = {"left": "SELECT s, 9, CASE kind WHEN 0 THEN 'PAN' ELSE 'Nominee' END, CASE kind WHEN 0 THEN concat('P', s) ELSE 'N' END, 'l' FROM f WHERE kind < 2", "right": "SELECT s, 11, 'Interest Rate', '3%', 'r' FROM f WHERE kind = 1"}
    boxes = [f"SELECT s, 4 + p.i AS r, p.label, p.value, '{side[0]}' AS side FROM f, LATERAL (VALUES {pairs(box)}) p(i, label, value)" for side, box in (("left", workbook.LEFT_BOX), ("right", workbook.RIGHT_BOX))]
    cell = lambda sheet, row, col, span, val, style, at, of, more="": f"SELECT s AS source_file, {lit(sheet)} AS sheet, {row} AS row, {col} AS col, {span} AS span, {val} AS value, {lit(style)} AS style, {lit(at)} AS align FROM {of} {more}"
    first, second = workbook.LEDGER, workbook.METADATA
    before, after = workbook.TITLE.split("{}")
    parts = [
        cell(first, 1, 1, n, f"concat({lit(before)}, upper(coalesce(bank, 'BANK STATEMENT')), {lit(after)})", "title", "center", "f"), cell(first, 3, 1, mid, lit(workbook.LEFT_TITLE), "section", "left", "f"),
        cell(first, 3, mid + 1, n - mid, lit(workbook.RIGHT_TITLE), "section", "left", "f"), cell(first, "top - 1", 1, n, lit(workbook.LEDGER_TITLE), "ledger_title", "left", "f"),
        *[cell(first, "top", i, 1, lit(c), "header", "center", "f") for i, c in enumerate(COLUMNS, 1)],
        *[cell(first, "r", col + at, (1, span)[at], ("label", "value")[at], ("label", "value")[at], "left", "x", f"WHERE side = '{side}'") for side, col, span in (("l", 1, mid - 1), ("r", mid + 1, n - mid - 1)) for at in (0, 1)],
        *[cell(second, 1, i, 1, lit(x), "field_header", "center", "f", "WHERE kind < 2") for i, x in enumerate(("Metadata Field", "Extracted Value"), 1)],
        *[cell(second, "i + 1", at, 1, ("k", "v")[at - 1], "field", "left", "m") for at in (1, 2)],
    ]
    body = [f"SELECT s, {lit(first)}, top + p, {i}, 1, {val}, style, {lit(workbook.align(c))} FROM l" for i, (c, val) in enumerate(zip(COLUMNS, ("day", "narration", "debit", "credit", "CAST(amount AS VARCHAR)"), strict=True), 1)]
    return f"""WITH b AS ({q.BRIDGE}), f AS (SELECT DISTINCT file_id AS s, file_id % 3 AS kind, CASE file_id % 3 WHEN 0 THEN 'Some Bank' WHEN 1 THEN 'Other Bank' END AS bank, CASE file_id % 3 WHEN 1 THEN 14 ELSE 13 END AS top FROM b),
x(s, r, label, value, side) AS ({' UNION ALL '.join(boxes)} UNION ALL {extra['left']} UNION ALL {extra['right']}),
m AS (SELECT s, p.* FROM f, LATERAL (VALUES (0, 1, 'Bank Name', 'Some Bank'), (0, 2, 'Opening Balance', '10.00'), (0, 3, 'PAN', concat('P', s)), (1, 1, 'Bank Name', 'Other Bank'), (1, 2, 'Client Address', ''), (1, 3, 'Interest Rate', '3%'), (1, 4, 'Nominee', 'N')) p(of, i, k, v) WHERE of = kind),
l AS (SELECT *, CASE WHEN debit <> '' THEN 'debit' WHEN credit <> '' THEN 'credit' WHEN p % 2 = 0 THEN 'even' ELSE 'odd' END AS style FROM (
 SELECT file_id AS s, substr(CAST(txn_date AS VARCHAR), 1, 10) AS day, narration, debit, credit, amount, row_number() OVER (PARTITION BY file_id ORDER BY txn_date, o_orderkey) AS p FROM b) JOIN f USING (s))
{' UNION ALL '.join([*parts, *body])}"""


REGISTRY = {
    "v1_classify_with_prototypes": (_classified, _CLASSIFIED_SQL),
    "k9_v13_v15_prototypes": (_prototypes, _PROTOTYPES_SQL),
    "k9_store_metadata": (_metadata, _METADATA_SQL),
    "c1_tf_idf_weights": (_weights, weights_sql(_STOP)),
    "c4_o2_centre_terms": (_centre_terms, None),
    "k3_statement_workbook": (_workbook, workbook_sql()),
}

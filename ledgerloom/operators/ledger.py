"""The ledger: running-balance inference, classification, filters, summaries, training exemplars."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.taxonomy import GATES, TAXONOMY
from .running import numbered


def balance_engine(rows: DataFrame) -> DataFrame:
    """Debit, credit and balance of rows (source_file, page_num, row_idx, description, direct, debit, credit, balance, raw_amounts).

    The last known balance before a row is a window over each row's own balance: one shuffle by
    file, nothing recursive. A difference of zero is a debit.
    """
    raw = F.col("raw_amounts")
    own_text = F.when(F.col("direct"), F.col("balance")).when(F.size(raw) >= 2, F.get(raw, F.lit(1))).when(F.size(raw) == 1, F.get(raw, F.lit(0)))
    own = F.replace(F.replace(own_text, F.lit("Rs."), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    before = Window.partitionBy("source_file").orderBy("page_num", "row_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", own).withColumn("_prev", F.last("_own", ignorenulls=True).over(before))
    hint = F.lower(F.coalesce("description", F.lit(""))).rlike("by clg|cr|salary|deposit|upi/cr")
    credit = F.when(F.col("_prev").isNotNull(), F.round(F.col("_own") - F.col("_prev"), 2) > 0).otherwise(hint)
    sum_ = F.concat(F.lit("Rs. "), F.get(raw, F.lit(0)))
    two = F.size(raw) >= 2
    pick = lambda name, cond: F.when(F.col("direct"), F.coalesce(name, F.lit(""))).when(two & cond, sum_).otherwise("")
    balance = F.when(F.col("direct"), F.coalesce("balance", F.lit(""))).when(F.size(raw) >= 1, F.concat(F.lit("Rs. "), own_text)).otherwise("")
    return rows.select(*[c for c in rows.columns if c not in ("debit", "credit", "balance", "_own", "_prev")], pick("debit", ~credit).alias("debit"), pick("credit", credit).alias("credit"), balance.alias("balance"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(domain, label, label_rank, exemplar_rank, exemplar)."""
    rows = [(d, label, i, j, e) for d, labels in TAXONOMY.items() for i, (label, es) in enumerate(labels.items()) for j, e in enumerate(es)]
    return spark.createDataFrame(rows, "domain string, label string, label_rank int, exemplar_rank int, exemplar string")


def per_distinct(df: DataFrame, column: str, *steps: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """`df` with the columns that `steps` derive from a text column, worked out once for each distinct text and joined back.

    Narrations repeat, and a dozen patterns cost more than a text's way through a shuffle. A step may use the columns of those
    before it, which then stand once and aren't worked out again for each mention. Null is a text like any other; a column that
    is there already is replaced.
    """
    # Adaptive plans join partitions by their bytes, and a few bytes of text are much work here: the number stays as the session says.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(column).alias("_text")).distinct().repartition(parts, "_text")
    for step in steps:
        texts = texts.withColumns(step(F.col("_text")))
    made = [c for c in texts.columns if c != "_text"]
    return df.drop(*made).join(texts, F.col(column).eqNullSafe(F.col("_text")), "left").drop("_text")


_NAMES = {"Transaction Mode": "mode", "Transaction Direction": "direction", "Transaction Purpose": "purpose", "Bank / Institution": "bank"}


def classify(ledger: DataFrame, description: str = "narration", debit: str | None = "debit", credit: str | None = "credit", flag: str | None = None, scored: DataFrame | None = None, null_as_nan: bool = True) -> DataFrame:
    """Five labels for each row: rules first, then the nearest prototype of the domain if it passes the gate, else the domain's default.

    `scored` (eval_text, domain, label, score) comes from an encoder for the texts no rule
    decides; without it the defaults stand. Mode, direction and bank look at the cleaned text,
    purpose and counterparty at the raw one. With `debit` and `credit` None a row's entries and flags are looked for
    under all names that statements give them.
    """
    by_columns = rules.direction_of_table(ledger.columns) if debit is None or credit is None else rules.direction_of_columns(text.has_value(F.col(debit)), text.has_value(F.col(credit)), F.col(flag) if flag else None)
    cleaned = per_distinct(ledger.withColumn("_raw", text.raw_text(F.col(description), null_as_nan)).withColumn("_by_columns", by_columns), "_raw", _cleaned, _readings)
    if scored is not None:
        gates = reduce(lambda c, d: F.when(F.col("domain") == d, GATES[d][0]).otherwise(c), GATES, F.lit(2.0))
        best = scored.where(F.col("score") >= gates).groupBy("eval_text").pivot("domain", list(GATES)).agg(F.first("label"))
        cleaned = cleaned.join(best.select("eval_text", *[F.col(f"`{d}`").alias(f"_{n}") for d, n in _NAMES.items()]), "eval_text", "left")
    chosen = {}
    for domain, name in _NAMES.items():
        ruled = [F.col("_by_columns"), F.col(name)] if name == "direction" else [F.col(name)]
        chosen[name] = F.coalesce(*ruled, *([F.col(f"_{name}")] if scored is not None else []), F.lit(GATES[domain][1]))
    return cleaned.withColumns(chosen).drop("_raw", "_by_columns", *[f"_{n}" for n in _NAMES.values()])


def _cleaned(raw: Column) -> dict[str, Column]:
    return {"eval_text": text.eval_text(raw)}


def _readings(raw: Column) -> dict[str, Column]:
    """What the rules say of a raw text and of its cleaned one; null where they say nothing."""
    cleaned = F.col("eval_text")
    return {
        "mode": rules.first_rule(cleaned, rules.MODE), "direction": rules.direction_of_text(cleaned), "purpose": rules.purpose_rule(raw), "bank": rules.first_rule(cleaned, rules.BANK),
        "counterparty": rules.counterparty(raw),
    }


def undecided(ledger: DataFrame, description: str = "narration") -> DataFrame:
    """Distinct texts that some domain's rules leave open: all that an encoder need see."""
    raw = text.raw_text(F.col(description))
    open_ = rules.first_rule(F.col("t"), rules.MODE).isNull() | rules.direction_of_text(F.col("t")).isNull() | rules.purpose_rule(F.col("r")).isNull() | rules.first_rule(F.col("t"), rules.BANK).isNull()
    return ledger.select(text.eval_text(raw).alias("t"), raw.alias("r")).where(open_).select(F.col("t").alias("eval_text")).distinct()


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any column, as text, holds the query as it is, whatever the case."""
    q = query.strip().lower()
    return df.where(F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]), lambda c: F.contains(F.lower(c), F.lit(q)))) if q else df


def with_entry(df: DataFrame, side: str) -> DataFrame:
    return df.where(F.col(side) != "")


def transactions_only(df: DataFrame, description: str, junk: str = "txn date|date|account holders") -> DataFrame:
    """Without header and junk rows: blank or header words as description, or a first column that says so."""
    d = F.lower(text.strip(F.col(description)))
    first = F.lower(F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("")))
    return df.where(F.col(description).isNotNull() & ~d.isin("", "description", "narration", "particulars", "nan") & ~first.rlike(junk))


def promote_header(df: DataFrame, order: str) -> DataFrame:
    """The first row (by `order`) that reads like a header names the columns, and what is above it goes; one small aggregate decides."""
    cells = [c for c in df.columns if c != order]
    line = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cells]))
    is_header = F.contains(line, F.lit("description")) & line.rlike("txn date|date|cheque")
    found = df.where(is_header).agg(F.min_by(F.array(*[F.col(c).cast("string") for c in cells]), order), F.min(order)).first()
    if found[1] is None or cells[0].lower().startswith("txn"):
        return df
    names = [" ".join((n or "").split()) for n in found[0]]
    return df.where(F.col(order) > found[1]).select(order, *[F.col(c).alias(n) for c, n in zip(cells, names, strict=True)])


def sanitise(df: DataFrame, description: str) -> DataFrame:
    """Every other column as text, without `nan` and `None` inside, the watermark, and extra space."""
    def one(c: Column) -> Column:
        t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("None")), "nan|None", "")
        return text.collapse(F.replace(t, F.lit("SYNTHETIC DATA - MACHINE GENERATED"), F.lit("")))

    return df.select(*[F.col(c) if c == description else one(F.col(c)).alias(c) for c in df.columns])


def description_column(columns: list[str]) -> str:
    wanted = ("description", "narration", "particulars", "transaction remarks", "details")
    return next((c for c in columns if c.strip().lower() in wanted), columns[0])


def target_column(df: DataFrame, target: str) -> str:
    """By name, by name in any case, by position, else the first column with a cell that is, or holds, the target."""
    t = target.strip().lower()
    named = [c for c in df.columns if c == target] or [c for c in df.columns if c.strip().lower() == t]
    if named:
        return named[0]
    if t.isdigit() and int(t) < len(df.columns):
        return df.columns[int(t)]
    cells = {c: F.lower(F.trim(F.col(c).cast("string"))) for c in df.columns}
    row = df.agg(*[F.max(F.struct(cells[c] == t, F.contains(cells[c], F.lit(t)))) for c in df.columns]).first()
    for at in (0, 1):
        for c, (got) in zip(df.columns, row, strict=True):
            if got and got[at]:
                return c
    raise ValueError(f"no column for {target!r}")


def summary(ledger: DataFrame) -> DataFrame:
    """Row count, entries and totals of either side."""
    return ledger.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("debit") != "").alias("n_debits"), F.count_if(F.col("credit") != "").alias("n_credits"),
        F.round(F.sum(text.amount(F.col("debit"))), 2).alias("total_debit"), F.round(F.sum(text.amount(F.col("credit"))), 2).alias("total_credit"),
    )


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def blank_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether each column is blank or null throughout."""
    return df.agg(*[F.bool_and(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in columns])


def row_style(df: DataFrame, order: list[str], place: str | None = None) -> DataFrame:
    """`row_style` by entry, else by parity of the row's number in its file, from 1, which `place` names if it is wanted.

    Numbers come from a range sort, so no task holds a file; the files are few enough to have a small row each broadcast.
    """
    number = F.col(place or "_number")
    df = numbered(df, ["source_file"], order, place or "_number", few=True)
    filled = lambda c: text.strip(F.coalesce(F.col(c), F.lit(""))) != ""
    style = F.when(filled("debit"), "debit").when(filled("credit"), "credit").when(number % 2 == 0, "even").otherwise("odd")
    styled = df.withColumn("row_style", style)
    return styled if place else styled.drop("_number")


def weak_labels(rows: DataFrame, description: str = "narration", flag: str = "cr_dr") -> DataFrame:
    """(domain, label, phrase): deep-cleaned narrations of quality with each label their rules give, once each."""
    direction = rules.weak_direction(text.has_value(F.col("debit")), text.has_value(F.col("credit")), F.col(flag))
    # A narration's other labels are its own, whatever row it stands in.
    raws = rows.select(F.col(description).alias("_raw"), direction.alias("_direction")).distinct()
    raws = raws.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_raw")  # as in per_distinct
    # In a generator the cleaner stands once; a filter on its column would repeat it, inlined, for each mention.
    good = raws.select("_raw", "_direction", F.explode(F.filter(F.array(text.deep_clean(F.col("_raw"))), text.is_exemplar)).alias("phrase"))
    raw = F.col("_raw")
    found = {"Transaction Mode": rules.first_rule(raw, rules.WEAK_MODE), "Transaction Direction": F.col("_direction"), "Transaction Purpose": rules.weak_purpose(raw), "Bank / Institution": rules.first_rule(raw, rules.WEAK_BANK)}
    labels = F.array(*[F.struct(F.lit(d).alias("domain"), label.alias("label")) for d, label in found.items()])
    return good.select("phrase", F.inline(labels)).where("label is not null").select("domain", "label", "phrase").distinct()


def top_exemplars(labelled: DataFrame, n: int = 6) -> DataFrame:
    """The longest phrases of each label; ties in order of the text."""
    place = F.row_number().over(Window.partitionBy("domain", "label").orderBy(F.desc(F.length("phrase")), "phrase"))
    return labelled.withColumn("rank", place).where(F.col("rank") <= n)


def merge_exemplars(base: DataFrame, real: DataFrame) -> DataFrame:
    """(domain, label, rank, exemplar): base ones in order, then real ones that the base lacks; labels that only data have are added."""
    n = base.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("_n"))
    new = real.join(base.select("domain", "label", F.col("exemplar").alias("phrase")), ["domain", "label", "phrase"], "left_anti").join(n, ["domain", "label"], "left")
    place = F.row_number().over(Window.partitionBy("domain", "label").orderBy("rank"))
    new = new.select("domain", "label", (F.coalesce("_n", F.lit(0)) + place - 1).cast("int").alias("rank"), F.col("phrase").alias("exemplar"))
    return base.select("domain", "label", F.col("exemplar_rank").alias("rank"), "exemplar").unionByName(new)

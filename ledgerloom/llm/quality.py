"""Quality rules: base statistics of each text, and cross-document line frequency by host.

One Python pass reads the whole texts once and leaves a small row for each document: its
statistics, and the hashes and word counts of its normalised lines. Documents that hold a line
are counted by host, lines above the limits go from every document of that host, and documents
that this depletes are rejected. Those are joins and aggregations of the small rows; lines are
cut from texts in the JVM.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, per_text

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED_PERCENT = 30
#: A line is boilerplate when more documents of its host hold it than both limits.
LINE_DOCS = 10
LINE_SHARE = 0.01
#: A document is depleted when the removal leaves fewer words than this, or a smaller share.
LEFT_WORDS = 10
LEFT_SHARE = 0.3

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<int>"


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Number of words inside windows that are found twice or more. Exact: windows are numbered by doubling, not hashed."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    x = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    if len(number) > n - window:  # so few words come again that no window can
        return 0
    width = 1
    while width < window:
        x = np.unique(x[:-width] * (n + 1) + x[width:], return_inverse=True)[1]
        width *= 2
    again = np.bincount(x)[x] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_hash(words: list[bytes]) -> int:
    """What line_key() gives in the JVM: XXH64 of a line's words, joined by one space, A-Z lower-cased."""
    h = xxhash.xxh64_intdigest(b" ".join(words).lower(), 42)
    return h - (1 << 64) if h >> 63 else h


def line_key(line: Column) -> Column:
    words = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def stats_of(text: str | None) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    n_dup = 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            n_dup += line in seen
            seen.add(line)
            key = line_hash(own)
            lines[key] = lines.get(key, 0) + len(own)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), n_dup, repeat_words(words), list(lines), list(lines.values())


def measured(docs: DataFrame, text_col: str, host_col: str, carried: list[Column]) -> DataFrame:
    """The columns `carried`, host, the statistics and a number for each row, `_row`: written, so that all of it stays as it is."""
    plain = docs.select(*carried, F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return keep(per_text(plain, stats_of, STATS).withColumn("_row", F.monotonically_increasing_id()), "stats")


def frequent_lines(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line): lines that more documents of the host hold than the limits; a document holds a line once."""
    by_line = rows.select("host", F.explode("line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs)
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    limited = by_line.alias("l").join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    return limited.where(F.col("n") > F.col("n_docs") * line_share).select("l.host", "line")


def verdicts(rows: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(_row, n_removed_words, removed_lines) of the rows that lose lines."""
    often = frequent_lines(rows, line_docs, line_share)
    lines = rows.select("_row", "host", F.inline(F.arrays_zip("line", "line_words")))
    return (
        lines.alias("a")
        .join(often.alias("b"), (F.col("a.line") == F.col("b.line")) & F.col("a.host").eqNullSafe(F.col("b.host")))
        .groupBy("_row")
        .agg(F.sum("line_words").alias("n_removed_words"), F.collect_list("a.line").alias("removed_lines"))
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def depleted(removed: Column) -> Column:
    left = F.col("n_words") - removed
    return (removed > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """One row for each row of `docs`: doc_id, the base statistics, base_failed, kept, n_removed_words, removed_lines.

    Every document of a host loses the host's frequent lines. A document is rejected if
    base_failed, or if the removal depletes it. removed_lines has the hashes of the normalised
    lines that go. Each row is a document, those that repeat an id or have none as well, and
    copies of one text count each time. Null texts count as empty ones, null hosts as one host.
    Texts are taken whole; an empty table gives no rows; other columns are not read.
    """
    rows = measured(docs, text_col, host_col, [F.col(id_col).cast("long").alias("doc_id")])
    lost = verdicts(rows, line_docs, line_share)
    removed = F.coalesce("n_removed_words", F.lit(0))
    return rows.join(lost, "_row", "left").select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~depleted(removed)).alias("kept"),
        removed.cast("long").alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"),
    )


def without_lines(text: Column, removed: Column) -> Column:
    """A text without the lines whose key is among `removed`; null or no keys leave it as it is."""
    left = F.filter(F.split(text, "\n", -1), lambda line: ~F.array_contains(removed, line_key(line)))
    return F.when(removed.isNull(), text).otherwise(F.array_join(left, "\n"))


def content(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def apply_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """`docs` without rejected rows, and without the removed lines in the others' texts; columns as they were, whatever their names.

    Rows are judged as in quality_rules; rows of one id, host and text are judged alike, so
    verdicts, which are narrow, meet the texts by these, and no text is written.
    """
    rows = measured(docs, text_col, host_col, [F.col(id_col).cast("string").alias("id"), *content(F.col(text_col))])
    lost = verdicts(rows, line_docs, line_share)
    good = rows.where(~base_failed()).join(lost, "_row", "left").where(~depleted(F.coalesce("n_removed_words", F.lit(0))))
    key = lambda id_, host: F.struct(id_.alias("id"), host.alias("host"), "k1", "k2")
    good = good.select(key(F.col("id"), F.col("host")).alias("good"), F.array_sort("removed_lines").alias("removed")).dropDuplicates(["good"])
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("string").alias("id"), F.col(host_col).cast("string").alias("host"), *content(F.col(text_col)))
    joined = whole.select("doc", key(F.col("id"), F.col("host")).alias("key")).join(good.hint("shuffle_hash"), F.col("key") == F.col("good"))
    doc = F.col("doc")
    return joined.select(*[without_lines(doc[c], F.col("removed")).alias(c) if c == text_col else doc[c].alias(c) for c in docs.columns])

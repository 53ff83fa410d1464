"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only.

A source's weight changes over training time as from + (to - from) * t; its integral up to t,
as a share of the whole, says how much of the source's target is due by then. Documents of a
source stand in hash order, once or twice over; the words before a document are inverted
through that integral to its training position, and rows are range-sorted by position.

The words before a document come from two levels of prefix sums: over ranges of a source's
hash order, and within a range. Neither a source nor the rows of one id are ever one group.
Positions are found on narrow rows; texts meet them once, by row key, and are then range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running
from .common import keep, n_words, ordered_key

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_TIMES = 2
#: A source's rows meet its target in so many slices.
SLICES = 4096
#: Weight at the start and at the end of training, by source in turn: even, fading in, fading out.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, target, no) from (source, size): weights in turn by code point, null last; targets capped, the excess reshared.

    The level that no uncapped target exceeds is found in closed form: with sources in order of
    cap / weight, the capped ones come first. One row for each source goes through one task here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most_times)
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(F.col("cap") / F.col("weight"), "no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("total", F.sum("source_size").over(every) * share).withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # The level if all before this source, in that order, are capped and this one is not.
    level = (F.col("total") - (F.sum("cap").over(upto) - F.col("cap"))) / F.col("rest")
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    per = per.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "no", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"), "no")


def position(share: Column, start: Column, end: Column) -> Column:
    """Training time in [0, 1] by which a share of a source's target is due: the inverse of the integral of its weight."""
    slope, whole = (end - start) / 2, (start + end) / 2
    due = share * whole
    return F.when(slope == 0, share).otherwise(2 * due / (start + F.sqrt(F.greatest(start * start + 4 * slope * due, F.lit(0.0)))))


def positions(sized: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """(kept, h, size, source_size, target, taken, at_first, at_second) from narrow rows (kept, id, source, size, tie)."""
    hashed = sized.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    # Written, as words are counted once and rows that are alike are told apart by their place.
    sized = keep(hashed.withColumn("row", F.monotonically_increasing_id()), "sized").withColumn("part", F.pmod("row", F.lit(SLICES)))
    targets = source_targets(sized.select("source", "size")).alias("t")
    parts = sized.select(F.col("source").alias("of"), F.col("part").alias("p")).distinct()
    per = parts.join(targets, F.col("of").eqNullSafe(F.col("t.source"))).select("of", "p", "source_size", "target", "no")
    rows = running(sized, ["source"], ["h", "id", "size", "tie", "row"], {"upto": F.col("size")})
    rows = rows.join(per, rows["source"].eqNullSafe(per["of"]) & (rows["part"] == per["p"]))
    first, whole = F.col("upto") - F.col("size"), F.floor("target")
    taken_at = lambda at: F.greatest(F.least(whole - at, F.col("size")), F.lit(0))
    pick = lambda i: F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), (F.col("no") % len(schedules) + 1).cast("int"))
    when = lambda at: F.when(taken_at(at) > 0, position(at / F.col("target"), pick(0), pick(1)))
    second = first + F.col("source_size")
    return rows.select("kept", "h", "size", "source_size", "target", (taken_at(first) + taken_at(second)).cast("long").alias("taken"), when(first).alias("at_first"), when(second).alias("at_second"))


OWN = ("size", "source_size", "target", "taken", "at_first", "at_second")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: tuple = SCHEDULES, with_text: bool = True) -> DataFrame:
    """`docs` with size, source_size, target, taken, at_first and at_second (training positions of the first and second time, or null).

    size counts the words of the whole text (null: 0). taken counts the words that the mix
    takes: a document's words before its source's target, at most twice its size. Sums of
    taken equal targets, rounded down. Empty documents take nothing and have no position;
    null sources are one source; rows that repeat an id are rows of their own. Same rows, same
    result: order follows a hash of id, then size and a hash of the text. An empty table gives
    no rows. Extra columns pass through, whatever their names; those named like the columns
    added are replaced. Without `with_text` the text column is left out, no text is shuffled, and
    rows are range-sorted by their first position, those without one last.
    """
    passed = [c for c in docs.columns if c not in OWN and (with_text or c != text_col)]
    narrow = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie")]
    if not with_text:
        found = positions(docs.select(F.struct(*passed).alias("kept"), *narrow), schedules)
        # Rows without a position are many: their hashes spread them.
        return range_sorted(found, F.col("at_first").asc_nulls_last(), "h").select(*[F.col("kept")[c].alias(c) for c in passed], *OWN)
    whole = ordered_key(docs.select(F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_doc")), "_id")
    doc = F.col("_doc")
    narrow = [F.col("_id").alias("id"), doc[source_col].alias("source"), n_words(doc[text_col]).alias("size"), F.xxhash64(doc[text_col]).alias("tie")]
    found = positions(whole.select(F.col("key").alias("kept"), *narrow), schedules)
    # The positions are the smaller side; hashing them spares sorting the texts.
    joined = whole.join(found.hint("shuffle_hash"), F.col("key") == F.col("kept"))
    return joined.select(*[doc[c].alias(c) for c in passed], *OWN)


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is trained on, with its `position`, range-sorted by it; a column of that name is replaced."""
    rows = mixed.withColumn("position", F.explode(F.filter(F.array("at_first", "at_second"), lambda x: x.isNotNull()))).drop("at_first", "at_second")
    return range_sorted(rows, "position")


def range_sorted(rows: DataFrame, *order: Column | str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

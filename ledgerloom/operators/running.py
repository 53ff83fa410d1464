"""Numbers and running totals within keys, without a task that holds a key.

Rows are sorted by ranges, so a key of any size spans as many partitions as it needs. Each
partition counts for itself; what a key has before the partition follows from one small row for
each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import keep

_PART_BITS = 33  # of the numbers that Spark gives rows, those below are the place in the partition


def running(df: DataFrame, keys: list[str], order: list[Column | str], totals: dict[str, Column]) -> DataFrame:
    """`df` with a column for each of `totals`: the sum of the expression over the key's rows up to this one, itself included.

    Null keys are keys like any other; expressions are longs without nulls. Rows that tie in `order` are in any order, but the
    same for all totals. The sorted rows are written to the shared folder, so numbers stay if executors are lost. A column of
    `df` with a total's name is replaced.
    """
    rest = df.drop(*[c for c in totals if c not in keys])
    sums = {f"_t{i}": c for i, c in enumerate(totals.values())}
    spread = df.select(*rest.columns, *[c.cast("long").alias(n) for n, c in sums.items()]).orderBy(*[F.col(k).asc_nulls_first() for k in keys], *order)
    rows = keep(spread.withColumn("_at", F.monotonically_increasing_id()), "running")
    part, key = F.shiftright("_at", _PART_BITS), F.struct(*keys)
    in_part = Window.partitionBy("_part").orderBy("_at")
    begun = rows.withColumn("_part", part).withColumn("_key", key)
    begun = begun.withColumn("_new", ~F.col("_key").eqNullSafe(F.lag("_key").over(in_part)) | (F.lag("_at").over(in_part).isNull()))
    begun = begun.withColumn("_start", F.last(F.when(F.col("_new"), F.col("_at")), ignorenulls=True).over(in_part))
    in_key = Window.partitionBy("_part", "_start").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = begun.select("*", *[F.sum(n).over(in_key).alias(f"{n}_here") for n in sums])
    names = [f"{n}_before" for n in sums]
    # One row for each partition, and those are as many as the session says.
    ends = rows.withColumn("_part", part).groupBy("_part").agg(F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"))
    tails = rows.withColumn("_part", part).join(F.broadcast(ends), "_part").where(key.eqNullSafe(F.col("last"))).groupBy("_part").agg(*[F.sum(n).alias(n) for n in sums])
    before, carried, table = None, [0] * len(sums), []
    for r in sorted(ends.join(tails, "_part").collect(), key=lambda r: r["_part"]):
        here = carried if before is not None and r["first"] == before else [0] * len(sums)
        table.append((r["_part"], *here))
        own = [r[n] for n in sums]
        carried = [a + b for a, b in zip(here, own, strict=True)] if r["first"] == r["last"] else own
        before = r["last"]
    first_at = F.first("_at").over(in_part)
    offsets = df.sparkSession.createDataFrame(table, ", ".join(["_part long", *[f"{n} long" for n in names]]))
    both = local.withColumn("_first", F.col("_start") == first_at).join(F.broadcast(offsets), "_part", "left")
    out = [(F.col(f"{n}_here") + F.when(F.col("_first"), F.col(f"{n}_before")).otherwise(F.lit(0))).alias(name) for n, name in zip(sums, totals, strict=True)]
    return both.select(*rest.columns, *out)


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank", few: bool = False) -> DataFrame:
    """`df` with the row's number among those of its key, from 1.

    `few` says that keys with the session's partitions are a small table. A row's number then follows from its place among the
    sorted rows and that of its key's first row in the partition: sorted rows are read as they were written, not shuffled again.
    """
    if not few:
        return running(df, keys, order, {name: F.lit(1)})
    rest = df if name in keys else df.drop(name)
    rows = keep(rest.orderBy(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_at", F.monotonically_increasing_id()), "running")
    part, named = F.shiftright("_at", _PART_BITS), [f"_k{i}" for i in range(len(keys))]
    begun = rows.groupBy(part.alias("_part"), *[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A key's partitions are one short array; what it has before each of them is a sum over that array.
    spans = begun.groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("_first", "_part", "_n"))).alias("_spans"))
    before = F.transform("_spans", lambda span, i: F.struct(span["_part"].alias("_part"), span["_first"].alias("_first"), F.aggregate(F.slice("_spans", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + x["_n"]).alias("_before")))
    begun = spans.select(*named, F.inline(before))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)]
    both = rows.join(F.broadcast(begun), [part == F.col("_part"), *same])
    # Columns of statements have names with dots.
    return both.select(*[F.col(f"`{c.replace('`', '``')}`") for c in rest.columns], (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))

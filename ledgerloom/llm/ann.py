"""Approximate nearest neighbours by a permutation index.

Pivots are rows drawn by hash (their number follows the square root of the rows, within
bounds). A vector is represented by its ORDER nearest pivots in order and posted, with its
place, in the inverted file of each. A query reads the files of its own pivots, which adds up
Spearman's footrule to every row that shares one; only rows whose footrule is good enough are
scored by cosine. What is good enough is found for each query on a bounded sample of the rows:
KEPT of them, fewer where the best ones stand out, as in clusters; never under TOP + 1 a block.

Rows lie in blocks of about BLOCK classes by their nearest pivot, near pivots side by side, and a
query is sent to a block only if one of the block's pivots is, in the query's own order, no later than
the nearest pivots of the sampled rows that it would keep. So in clusters a query meets few blocks; without structure
it meets most. A block's queries are dealt out as well, so a task's work is bounded whatever pivot is popular.

Equal vectors are one class: only the class is posted, with the ids that can be among any
query's nearest (the smallest TOP + 1).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import keep

TOP = 5
PIVOTS = (256, 1024)
ORDER = 128
#: Rows (the first by hash) on which a query's least nearness by footrule is found.
SAMPLE = 2048
#: Share of the rows that footrule leaves to be scored, at every size, and the share of the way from the sample's middle nearness to its third best below which none is.
KEPT = 0.1
CLOSE = 0.4
BLOCK = 4096
QUERY_BLOCK = 4096


def usable(vector: F.Column) -> F.Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def permutations(x: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties to the earlier pivot."""
    return np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :order]


class Files:
    """The inverted files of some rows: for each pivot, the rows that have it and how near it is to them (ORDER for the nearest, down to 1)."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        self.n, self.order = perms.shape
        flat = perms.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.place = (by // self.order).astype(np.int32), (self.order - by % self.order).astype(np.int32)
        self.edge = np.searchsorted(flat[by], np.arange(n_pivots + 1))

    def nearness(self, perm: np.ndarray) -> np.ndarray:
        """For each row, half of what shared pivots take off the largest footrule: that is order * (order + 1) - 2 * nearness, a pivot that one lacks standing at its end."""
        total = np.zeros(self.n, np.int32)
        for j, p in enumerate(perm.tolist()):
            file = slice(self.edge[p], self.edge[p + 1])
            total[self.rows[file]] += np.minimum(self.place[file], self.order - j)
        return total


def least_nearness(near: np.ndarray) -> int:
    """From the sample's nearness: what a row must reach to be scored for this query."""
    found = np.sort(near)[::-1]
    middle, third = int(found[len(found) // 2]), int(found[min(2, len(found) - 1)])
    return max(int(found[min(len(found) - 1, int(KEPT * len(found)))]), middle + math.ceil(CLOSE * (third - middle)))


def blocks_of(sizes: dict[int, int], pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pivot's first block and number of blocks: files of near pivots share a block up to BLOCK rows, larger ones have several."""
    left, at, order = set(range(len(pivots))), 0, []
    sims = pivots @ pivots.T
    while left:  # a chain from each pivot to the nearest that is left
        left.discard(at)
        order.append(at)
        rest = np.fromiter(left, dtype=np.int64, count=len(left))
        at = int(rest[np.argmax(sims[at, rest])]) if left else at
    first, many = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    block, filled = 0, 0
    for p in order:
        n = sizes.get(p, 0)
        if filled and filled + n > BLOCK:
            block, filled = block + 1, 0
        first[p], many[p] = block, max(1, math.ceil(n / BLOCK))
        block, filled = (block + int(many[p]), 0) if n > BLOCK else (block, filled + n)
    return first, many


def selected(files: Files, perm: np.ndarray, least: int, top: int) -> np.ndarray:
    """Rows of a block to be scored: at least TOP + 1, ties with the last one too."""
    near = files.nearness(perm)
    most = min(top + 1, len(near))
    return np.flatnonzero(near >= min(least, np.partition(near, -most)[-most]))


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores wherever they stand."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum(axis=-1)))


def _search(n_pivots: int, top: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["is_query"].to_numpy(bool)
        queries, rows = pdf[is_query], pdf[~is_query]
        q, c, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(queries) and len(rows):
            x, ids = matrix(rows["vector"]), rows["cid"].to_numpy(np.int64)
            files = Files(np.array(rows["perm"].tolist()), n_pivots)
            for qid, v, perm, least in zip(queries["cid"], matrix(queries["vector"]), queries["perm"], queries["least"], strict=True):
                j = selected(files, np.asarray(perm), least, top)
                s = cosines(v, x[j])
                best = np.lexsort((ids[j], -s))[: top + 1]
                q.append(np.full(len(best), qid))
                c.append(ids[j[best]])
                score.append(s[best])
        return pd.DataFrame({"q": np.concatenate(q), "c": np.concatenate(c), "score": np.concatenate(score)})

    return run


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of `vectors` to each row of `queries`, but for the query's own id.

    Score is the cosine in double precision. Ties go to the smaller vec_id. Rows without an
    id, or whose vector is null, zero, of another length than most, or holds null or
    non-finite components, take no part. Repeated ids with equal vectors count once. An
    empty table gives no rows; a query without candidates none. Other columns are not read.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("vector")).distinct()

    rows, wanted = clean(vectors), clean(queries)
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, wanted = rows.where(F.size("vector") == dims["d"]), wanted.where(F.size("vector") == dims["d"])
    members, asked, dealt, n_pivots = deal(rows, wanted, top)
    near = dealt.groupBy("block", "part").applyInPandas(_search(n_pivots, top), "q long, c long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    near = near.withColumn("no", F.row_number().over(best)).where(F.col("no") <= top + 1).select("q", "c", "score")
    # Classes back to ids: each query of a vector has that vector's classes, and their smallest ids but its own.
    asked_ids = wanted.join(asked, "vector").select(F.col("id").alias("query_id"), F.col("cid").alias("q"))
    hits = near.join(members.select(F.col("cid").alias("c"), "ids"), "c").join(asked_ids, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def deal(rows: DataFrame, wanted: DataFrame, top: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Classes of `rows` (id, vector), classes of the queries `wanted`, rows and queries by (block, part) as they meet, and the number of pivots."""
    spark = rows.sparkSession
    ship(spark)
    # Classes of equal vectors, with their smallest ids. Tasks cut a class to these before it is dealt out.
    alike = rows.withColumn("no", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("no") <= top + 1)
    members = keep(alike.groupBy("vector").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    n = members.count()
    n_pivots = int(min(max(PIVOTS[0], math.sqrt(n)), PIVOTS[1], n))
    chosen = members.select("vector", F.xxhash64("cid").alias("h")).orderBy("h").limit(n_pivots).collect()  # PIVOTS[1] vectors at most
    pivots = spark.sparkContext.broadcast(unit(np.array([r["vector"] for r in chosen])))
    order = min(ORDER, n_pivots)

    @F.pandas_udf("array<int>")
    def perm(v: pd.Series) -> pd.Series:
        return pd.Series(list(permutations(matrix(v), pivots.value, order).astype(np.int32)))

    posted = keep(members.select("cid", "vector", perm("vector").alias("perm")), "posted")
    sample = posted.select("perm", F.xxhash64("cid").alias("h")).orderBy("h").limit(SAMPLE).collect()
    sampled = spark.sparkContext.broadcast(np.array([r["perm"] for r in sample], np.int32))
    nearest = F.get("perm", F.lit(0))
    sizes = {r["p"]: r["count"] for r in posted.groupBy(nearest.alias("p")).count().collect()}  # a row for each pivot
    first, many = blocks_of(sizes, pivots.value)

    @F.pandas_udf("struct<least: int, blocks: array<int>>")
    def plan(perms: pd.Series) -> pd.DataFrame:
        files, out = Files(sampled.value, n_pivots), []
        for p in perms:
            near = files.nearness(np.asarray(p))
            least = least_nearness(near)
            place = np.full(n_pivots, order)
            place[np.asarray(p)] = np.arange(order)
            last = place[sampled.value[near >= least, 0]].max(initial=0)
            wanted = np.flatnonzero(place <= last)
            out.append((least, sorted({int(b) for w in wanted for b in range(first[w], first[w] + many[w])})))
        return pd.DataFrame(out, columns=["least", "blocks"])

    asked = keep(wanted.groupBy("vector").agg(F.min("id").alias("cid")).withColumn("perm", perm("vector")).select("*", plan("perm").alias("plan")), "asked")
    met = asked.select("cid", "vector", "perm", F.col("plan.least").alias("least"), F.explode("plan.blocks").alias("block"))
    # Queries of a block are dealt out by QUERY_BLOCK; the block's rows travel to each of these.
    queried = keep(met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts")), "queried")
    at = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), nearest)
    block = (at(first) + F.pmod(F.xxhash64(F.lit(7), "cid"), at(many))).cast("int")
    rows_dealt = posted.withColumn("block", block).join(queried, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "vector", "perm", F.lit(0).alias("least"), F.lit(False).alias("is_query"))
    queries_dealt = met.join(queried, "block").select("block", F.pmod(F.xxhash64(F.lit(7), "cid"), F.col("parts")).cast("int").alias("part"), "cid", "vector", "perm", "least", F.lit(True).alias("is_query"))
    return members, asked, rows_dealt.unionByName(queries_dealt), n_pivots

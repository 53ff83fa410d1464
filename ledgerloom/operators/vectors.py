"""Vector operators: normalisation, prototype scores, gates, centroids, pooled class scores.

Prototypes are the exemplars of a taxonomy, a few hundred; their size is checked before they
are sent to every task. Beyond PROTOTYPES each task streams them from a written table, a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyarrow import dataset
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import keep
from ..shipping import ship
from ..sources.files import opened

PROTOTYPES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def label_scores(vectors: DataFrame, prototypes: DataFrame, pool: str = "max") -> DataFrame:
    """(id, label, label_rank, score) of unit vectors (id, v) against unit prototypes (label, label_rank, v), pooled over a label's.

    pool: `max`, `top3` (mean of the three best) or `mean`. Prototypes go to every task as one matrix, so
    rows are neither multiplied nor shuffled before their scores are ready. A vector that is null, of another
    length, or has a null or NaN inside has null scores; such a prototype takes no part. Prototypes of two lengths are an error.
    """
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    given = prototypes.select("label", "label_rank", "v").where(whole)
    found = given.limit(PROTOTYPES + 1).toArrow()
    if found.num_rows > PROTOTYPES:
        return _streamed_scores(vectors, given, pool)
    rows = found.to_pylist()
    groups: dict[tuple, list] = {}
    for r in rows:
        key = r["label"]
        groups.setdefault((r["label_rank"], tuple(key.items()) if isinstance(key, dict) else key), []).append(r)
    keys = sorted(groups, key=lambda k: (k[0], str(k[1])))
    schema = T.StructType([T.StructField("pos", T.IntegerType()), *[given.schema[c] for c in ("label", "label_rank")]])
    labels = vectors.sparkSession.createDataFrame([(i, groups[k][0]["label"], k[0]) for i, k in enumerate(keys)], schema)
    pooled = _pooled([np.array([r["v"] for r in groups[k]], dtype=float) for k in keys], pool)
    scored = vectors.select("id", F.posexplode(pooled(F.col("v"))).alias("pos", "score"))
    return scored.join(F.broadcast(labels), "pos").select("id", "label", "label_rank", "score")


def _pooled(groups: list[np.ndarray], pool: str) -> Callable[[Column], Column]:
    """Column of vectors to their score for each group, by one matrix product a slice of rows."""
    matrix = np.concatenate(groups) if groups else np.zeros((0, 0))
    starts = np.cumsum([0, *map(len, groups)])
    at_once = max(1, 4_000_000 // max(1, len(matrix)))

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series) -> pd.Series:
        whole = np.array([x is not None and len(x) == matrix.shape[1] and not np.isnan(np.asarray(x, dtype=float)).any() for x in v], dtype=bool)
        out = np.full((len(v), len(starts) - 1), None, dtype=object)
        for some in np.array_split(np.flatnonzero(whole), -(-int(whole.sum()) // at_once) or 1):
            if len(some) and len(matrix):
                sims = np.stack([np.asarray(v.iloc[i], dtype=float) for i in some]) @ matrix.T
                for g, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    part = sims[:, a:b]
                    out[some, g] = part.max(axis=1) if pool == "max" else (np.sort(part, axis=1)[:, -3:] if pool == "top3" else part).mean(axis=1)
        return pd.Series(list(out), dtype=object)

    return scores


def _streamed_scores(vectors: DataFrame, prototypes: DataFrame, pool: str) -> DataFrame:
    """The same for any number of whole prototypes: written once, and read by each task a block at a time, for a batch of its vectors."""
    sizes = prototypes.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"prototypes of {sizes[0]} and of {sizes[1]} places")
    # Labels are those of a taxonomy: every vector gets a score for each.
    ship(vectors.sparkSession)
    labels = keep(prototypes.select("label", "label_rank").distinct().withColumn("pos", F.row_number().over(Window.orderBy("label_rank", "label")) - 1), "labels")
    numbered = prototypes.join(F.broadcast(labels), ["label", "label_rank"]).select("pos", F.transform("v", lambda x: x.cast("double")).alias("v"))
    stored = keep(numbered.sortWithinPartitions("pos"), "prototypes")
    pooled = _pooled_from(stored.kept_at, sizes[0], labels.count(), pool)
    scored = vectors.select("id", F.posexplode(pooled(F.col("v"))).alias("pos", "score"))
    return scored.join(F.broadcast(labels), "pos").select("id", "label", "label_rank", "score")


def _pooled_from(path: str, size: int, n_labels: int, pool: str) -> Callable[[Column], Column]:
    """Column of vectors to their score for each label, with partial maxima, three best and sums over blocks of prototypes."""
    block = PROTOTYPES

    def scores_of(x: np.ndarray) -> np.ndarray:
        best, total, n = np.full((len(x), n_labels, 3), -np.inf), np.zeros((len(x), n_labels)), np.zeros(n_labels)
        system, root = opened(path)
        for batch in dataset.dataset(root, filesystem=system, format="parquet").to_batches(batch_size=block):
            if not batch.num_rows:
                continue
            pos, rows = batch.column("pos").to_numpy(), np.stack(batch.column("v").to_numpy(zero_copy_only=False))
            sims = x @ rows.T
            for g in np.unique(pos):
                part = sims[:, pos == g]
                best[:, g] = np.sort(np.concatenate([best[:, g], part], axis=1), axis=1)[:, -3:]
                total[:, g] += part.sum(axis=1)
                n[g] += part.shape[1]
        if pool == "max":
            return best[:, :, 2]
        return total / n if pool == "mean" else np.where(np.isinf(best), 0.0, best).sum(axis=2) / np.minimum(n, 3)

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series) -> pd.Series:
        out = np.full((len(v), n_labels), None, dtype=object)
        good = np.flatnonzero([x is not None and len(x) == size and not np.isnan(np.asarray(x, dtype=float)).any() for x in v])
        for some in np.array_split(good, -(-len(good) * block // 40_000_000) or 1):
            if len(some):
                out[some] = scores_of(np.stack([np.asarray(v.iloc[i], dtype=float) for i in some]))
        return pd.Series(list(out), dtype=object)

    return scores


def best_label(scores: DataFrame, gate: float | None = None, default: str | None = None) -> DataFrame:
    """(id, label, score): the best label, the first by rank among equals, or the default below the gate."""
    best = scores.groupBy("id").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label_rank"))).alias("b")).select("id", "b.label", "b.score")
    return best if gate is None else best.withColumn("label", F.when(F.col("score") >= gate, F.col("label")).otherwise(default))


def centroids(vectors: DataFrame, keys: list[str], unit: bool = True) -> DataFrame:
    """(keys, v): mean of each group's vectors, to unit length unless zero. Positions are averaged, partly before the shuffle."""
    long = vectors.select(*keys, F.posexplode("v").alias("pos", "x"))
    mean = long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return out.withColumn("v", normalise(F.col("v"))) if unit else out


def presence(scores: DataFrame, labels: list[str], threshold: float = 0.58, own: dict[str, float] | None = None) -> DataFrame:
    """One row for each id: each label's rounded score, and Yes or No against its threshold."""
    wide = scores.groupBy("id").pivot("label", labels).agg(F.round(F.first("score"), 4))
    return wide.select("id", *[F.col(f"`{x}`").alias(f"score_{x}") for x in labels], *[F.when(F.col(f"`{x}`") >= (own or {}).get(x, threshold), "Yes").otherwise("No").alias(f"has_{x}") for x in labels])


def class_counts(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, label, n): how many ids reach each threshold for a label, which has a row even where none does; one pass."""
    counts = scores.groupBy("label").agg(*[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return counts.select("label", F.inline(F.array(*[F.struct(F.lit(t).cast("double").alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])))


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, classified, unclassified, avg_matches, percentage) over (id, score): one pass, a column for each threshold."""
    per = scores.groupBy("id").agg(*[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    each = per.select(F.explode(F.array(*[F.struct(F.lit(t).cast("double").alias("threshold"), F.col(f"t{i}").alias("m")) for i, t in enumerate(thresholds)])).alias("e")).select("e.*")
    return each.groupBy("threshold").agg(F.count_if(F.col("m") > 0).alias("classified"), F.count_if(F.col("m") == 0).alias("unclassified"), F.round(F.avg("m"), 4).alias("avg_matches"), F.round(100.0 * F.count_if(F.col("m") > 0) / F.count(F.lit(1)), 4).alias("percentage"))


def classify_one(scores: DataFrame, threshold: float = 0.58) -> DataFrame:
    """(id, top, matches, all_scores) of a few texts."""
    return scores.groupBy("id").agg(
        F.max_by("label", F.struct("score", -F.col("label_rank"))).alias("top"), F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, F.col("label")))).alias("matches"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.round("score", 4).alias("score"))))).alias("all_scores"),
    )

"""Texts to unit vectors with a plug-in encoder, and class prototypes made of them.

An encoder is a function without arguments that loads a model and returns a function from a list
of texts to a matrix with a row for each. It is called once in each Python worker's task, so a
model is loaded once, not once a batch. Encode distinct texts: narrations repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..shared import keep
from ..shipping import ship
from . import vectors

Encoder = Callable[[], Callable[[list[str]], np.ndarray]]
PREFIX = "search_document: "
#: Domains' numbers in a store's folder names; any other has OTHER. Fixed values.
DOMAIN_IDS = {"Transaction Mode": 1, "Transaction Direction": 2, "Transaction Purpose": 3, "Bank / Institution": 4}
OTHER = 9


def hashing_encoder(size: int = 256) -> Encoder:
    """Counts of words `[a-z0-9]+`, each at the place that its MD5 gives: no model, the same everywhere. For tests and for want of a model."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for w in re.findall("[a-z0-9]+", t.lower()):
                    out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % size] += 1
            return out

        return run

    return load


def encode(texts: DataFrame, encoder: Encoder, text: str = "eval_text", out: str = "v", prefix: str = PREFIX, batch: int = 32) -> DataFrame:
    """`texts` with `out`, the unit vector of prefix and text (zero stays zero); a null text has a null vector."""
    ship(texts.sparkSession)

    @F.pandas_udf("array<double>")
    def vectors_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder()
        for part in parts:
            given = [prefix + t for t in part if t is not None]
            rows: list[np.ndarray] = []
            for i in range(0, len(given), batch):
                rows.extend(_unit(np.asarray(run(given[i : i + batch]), dtype=float)))
            found = iter(rows)
            yield pd.Series([None if t is None else next(found) for t in part], dtype=object)

    return texts.withColumn(out, vectors_of(F.col(text)))


def exemplar_scores(texts: DataFrame, exemplars: DataFrame, encoder: Encoder) -> DataFrame:
    """(eval_text, domain, label, label_rank, score): each distinct text's cosine with the nearest exemplar of each label.

    `exemplars` are those of a taxonomy: (domain, label, label_rank, exemplar). A null text has null scores.
    """
    found = encode(texts.select("eval_text").distinct(), encoder).select(F.col("eval_text").alias("id"), "v")
    protos = encode(exemplars, encoder, "exemplar").select(F.struct("domain", "label").alias("label"), "label_rank", "v")
    return vectors.label_scores(found, protos).select(F.col("id").alias("eval_text"), "label.domain", "label.label", "label_rank", "score")


def best_by_domain(scores: DataFrame) -> DataFrame:
    """(eval_text, domain, label, score): the best label of each domain, the first by rank among equals. Feeds `ledger.classify`."""
    best = F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label_rank")))
    return scores.groupBy("eval_text", "domain").agg(best.alias("b")).select("eval_text", "domain", "b.label", "b.score")


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(n == 0, 1.0, n)


def label_sums(exemplars: DataFrame, encoder: Encoder, prefix: str = PREFIX, batch: int = 32) -> DataFrame:
    """(domain, label, n, v): number and sum of the unit vectors of each label's exemplars (domain, label, exemplar), repeats included.

    A text's labels stand together, so it is encoded once for all of them. Vectors are added up where they are made: a
    task gives one sum for each label.
    """
    ship(exemplars.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoded, sums = encoder(), {}
        for pdf in batches:
            at, texts = pd.factorize(pdf["exemplar"])
            given = [prefix + t for t in texts]
            rows = np.concatenate([_unit(np.asarray(encoded(given[i : i + batch]), dtype=float)) for i in range(0, len(given), batch)]) if given else None
            of, labels = pd.factorize(pd.Series(list(zip(pdf["domain"], pdf["label"], strict=True)), dtype=object))
            for i, key in enumerate(labels):
                times, mine = pdf["n"].to_numpy()[of == i], at[of == i]
                n, v = sums.get(key, (0, 0.0))
                sums[key] = (n + int(times.sum()), v + times.astype(float) @ rows[mine])
        yield pd.DataFrame([(*key, n, v) for key, (n, v) in sums.items()], columns=["domain", "label", "n", "v"])

    counted = exemplars.groupBy("domain", "label", "exemplar").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.repartition("exemplar").sortWithinPartitions("exemplar").mapInPandas(run, "domain string, label string, n long, v array<double>")
    return added_up(parts, ["domain", "label"])


def added_up(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, v) of parts (keys, n, v), a row for each task and label."""
    places = sums.select(*keys, "n", F.posexplode("v").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return places.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def _means(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, vectors.normalise(F.transform("v", lambda x: x / F.col("n"))).alias("v"))


def store_metadata(exemplars: DataFrame) -> DataFrame:
    """(domain_id, domain, folder_key, label, exemplars) of exemplars (domain, label, exemplar), blank ones left out."""
    ids = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DOMAIN_IDS.items() for x in kv]), F.col("domain")), F.lit(OTHER))
    metadata = exemplars.where(F.trim("exemplar") != "").groupBy("domain", "label").agg(F.array_sort(F.collect_list("exemplar")).alias("exemplars")).withColumn("domain_id", ids)
    return metadata.select("domain_id", "domain", F.concat(F.col("domain_id").cast("string"), F.lit("_"), slug(F.col("domain"))).alias("folder_key"), "label", "exemplars")


def prototypes(exemplars: DataFrame, encoder: Encoder) -> dict[str, DataFrame]:
    """A store's parts. `exemplars` has (domain, label, exemplar), blank ones left out; labels without any have no row.

    exemplars: (domain, label, exemplar, v). labels: (domain, label, v), the mean of a label's exemplars.
    domains: (domain, v), the mean of its labels' means. classes: (domain, v), the mean of all its exemplars.
    metadata: (domain_id, domain, folder_key, label, exemplars). Means have unit length, and come from one written table of sums by label.
    """
    given = exemplars.where(F.trim("exemplar") != "")
    each = encode(given, encoder, "exemplar").select("domain", "label", "exemplar", "v")
    sums = keep(label_sums(given, encoder), "sums")
    labels = _means(sums, ["domain", "label"])
    return {"exemplars": each, "labels": labels, "domains": vectors.centroids(labels, ["domain"]), "classes": _means(added_up(sums, ["domain"]), ["domain"]), "metadata": store_metadata(exemplars)}

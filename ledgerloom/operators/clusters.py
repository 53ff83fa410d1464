"""Exploration: TF-IDF, K-means, keyword reports, two-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, Normalizer, StandardScaler, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..shared import keep
from ..shipping import ship
from .running import numbered

#: Common English words, as Spark's remover has them.
def stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def words(df: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """(key, word), without stop words (by default Spark's), repeats included. A stop list is small; any other goes in as `stop`."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("word")).where(~F.col("word").isin(stop_words() if stop is None else stop))


def tf_idf_weights(df: DataFrame, key: str, text: str, features: int = 500, stop: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(key, i, word, weight) and the vocabulary: the most frequent terms, smoothed inverse document frequency, rows of unit length.

    The weight is count * (ln((1 + n) / (1 + df)) + 1) over the row's length; documents without a term have no row. Rows
    of one key are one document; null is no key.
    """
    given = df.where(F.col(key).isNotNull())
    n = given.select(key).distinct().count()
    terms = words(given, key, text, stop).groupBy("word").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "word").limit(features)
    chosen = sorted(r["word"] for r in terms.collect())  # `features` rows at most
    # Only the vocabulary's words are shuffled, once, as a sparse vector for each row; no word is empty.
    model = CountVectorizerModel.from_vocabulary(chosen or [""], inputCol="_words", outputCol="_counts")
    counts = model.transform(given.select(key, word_list(F.col(text), stop).alias("_words"))).select(key, "_counts").repartition(key)
    tf = counts.select(key, F.posexplode(vector_to_array("_counts")).alias("i", "x")).where("x > 0").groupBy(key, "i").agg(F.sum("x").alias("x"))
    rows = keep(tf.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("terms")), "terms")  # `features` terms at most
    found = dict(rows.select(F.explode("terms.i").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df")).collect())
    idf = F.lit([float(np.log((1.0 + n) / (1.0 + found[i])) + 1.0) for i in range(len(chosen))] or [0.0])
    said = F.lit(chosen or [""])
    weighed = rows.select(key, F.transform("terms", lambda t: F.struct(t["i"].alias("i"), F.get(said, t["i"]).alias("word"), (t["x"] * F.get(idf, t["i"])).alias("x"))).alias("terms"))
    length = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["x"] * t["x"]))
    return weighed.select(key, length.alias("length"), F.inline("terms")).select(key, "i", "word", (F.col("x") / F.col("length")).alias("weight")), chosen


def word_list(text: Column, stop: list[str] | None = None) -> Column:
    """A text's words without stop words, in order, repeats included."""
    listed = stop_words() if stop is None else stop
    return F.filter(tokens(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(listed))


def tf_idf(df: DataFrame, key: str, text: str, features: int = 500, stop: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """`df` with words and vector (sparse, of unit length), and the vocabulary; each row is a document, whatever its key, and one without a term has the zero vector.

    Weights are those of tf_idf_weights. Words are counted at the vocabulary's places, weighted place by place and scaled: no
    row is taken apart and put together again, so other columns simply stay. Columns named words or vector are replaced.
    """
    # Written, as the texts would be cut up again for the vocabulary, the frequencies and each user of the vectors.
    said = keep(df.drop(*{"vector", "words"} - {key, text}).withColumn("words", word_list(F.col(text), stop)), "words")
    terms = said.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "word").limit(features)
    vocabulary = sorted(r["word"] for r in terms.collect())  # `features` rows at most
    if not vocabulary:
        return said.withColumn("vector", array_to_vector(F.array(F.lit(0.0)))), []
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="_counts").transform(said)
    n, found = counted.select(F.count(F.lit(1)), Summarizer.numNonZeros(F.col("_counts"))).first()
    idf = Vectors.dense(np.log((1.0 + n) / (1.0 + np.asarray(found.toArray()))) + 1.0)
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="_counts", outputCol="_weights").transform(counted)
    return Normalizer(inputCol="_weights", outputCol="vector").transform(weighted).drop("_counts", "_weights"), vocabulary


def k_means(features: DataFrame, k: int = 4, seed: int = 42, vector: str = "vector") -> tuple[DataFrame, list]:
    """`features` with `cluster`, and the centres. The trainer holds the vectors while it runs, and nothing after."""
    model = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="cluster").fit(features)
    return model.transform(features), model.clusterCenters()


def top_terms(centres: list, vocabulary: list[str], n: int = 6) -> list[list[str]]:
    return [[vocabulary[i] for i in sorted(range(len(vocabulary)), key=lambda j: (-c[j], j))[:n]] for c in centres]


def centre_terms(spark: SparkSession, centres: list, vocabulary: list[str], n: int = 6) -> DataFrame:
    """(cluster, rank, term, weight): the heaviest terms of each centre; ties in order of the vocabulary. Centres are few."""
    rows = [(k, i, t, float(c[vocabulary.index(t)])) for k, (c, terms) in enumerate(zip(centres, top_terms(centres, vocabulary, n), strict=True)) for i, t in enumerate(terms, 1)]
    return spark.createDataFrame(rows, "cluster int, rank int, term string, weight double")


def sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster")


def keyword_ranks(clustered: DataFrame, words: str = "words") -> DataFrame:
    """(cluster, total_records, rank, keyword, frequency) of rows with a cluster and their words; numbered by ranges, no task holds a cluster."""
    freq = clustered.select("cluster", F.explode(words).alias("keyword")).groupBy("cluster", "keyword").agg(F.count(F.lit(1)).alias("frequency"))
    ranked = numbered(freq, ["cluster"], [F.desc("frequency"), "keyword"], few=True)
    totals = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("total_records"))
    return ranked.join(totals, "cluster").select("cluster", "total_records", F.col("rank").cast("int").alias("rank"), "keyword", "frequency")


# The report's lines.
_WIDE = 80
_TITLE = " " * 17 + "K-MEANS CLUSTERING KEYWORDS & FREQUENCY REPORT"
_ROW, _LINE = "%-40s | %-10s", "%-40s | %-10d"
_NO_ROWS, _NO_WORDS = "No records in this cluster.", "No distinctive keywords found."


def keyword_report(ranks: DataFrame) -> DataFrame:
    """Lines of fixed width for a text file."""
    return ranks.select("cluster", "rank", F.format_string(_LINE, "keyword", "frequency").alias("line"))


def whole_report(ranks: DataFrame, sizes_: DataFrame, k: int) -> DataFrame:
    """(cluster, line_no, line) of a report: a title before the first of `k` clusters, a head for each, its keywords by rank, two blank lines.

    `sizes_` has (cluster, n). A cluster without records says so, and one whose records have no words.
    """
    rule, thin = "=" * _WIDE, "-" * _WIDE
    heads = ranks.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(sizes_.select(F.col("cluster").cast("int").alias("cluster"), "n"), "cluster", "left")
    named = heads.join(ranks.groupBy("cluster").agg(F.max("rank").alias("words")), "cluster", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "words": F.coalesce("words", F.lit(0))})
    numbered_ = lambda lines, first: [F.struct(F.lit(first + i).cast("long").alias("line_no"), line.alias("line")) for i, line in enumerate(lines)]
    title = numbered_([F.lit(rule), F.lit(_TITLE), F.lit(rule), F.lit("")], -8)
    head = numbered_([F.lit(rule), F.format_string("CLUSTER %d (Total Records: %d)", "cluster", "n"), F.lit(rule), F.lit(_ROW % ("Keyword", "Frequency")), F.lit(thin)], -4)
    none = F.when(F.col("n") == 0, F.lit(_NO_ROWS)).when(F.col("words") == 0, F.lit(_NO_WORDS))
    after = lambda i: F.struct((F.col("words").cast("long") + i).alias("line_no"), F.lit("").alias("line"))
    lines = F.concat(
        F.when(F.col("cluster") == 0, F.array(*title)).otherwise(F.array().cast("array<struct<line_no:bigint,line:string>>")), F.array(*head),
        F.filter(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), none.alias("line"))), lambda x: x["line"].isNotNull()), F.array(after(2), after(3)),
    )
    words = ranks.select(F.col("cluster").cast("int").alias("cluster"), F.col("rank").cast("long").alias("line_no"), F.format_string(_LINE, "keyword", "frequency").alias("line"))
    return named.select("cluster", F.inline(lines)).unionByName(words)


def write_report(report: DataFrame, path: str) -> None:
    """The report as text: its parts, in the order of their names, are the file."""
    report.orderBy("cluster", "line_no").select("line").write.text(path)


def project_pca(features: DataFrame, key: str, array: str) -> DataFrame:
    """(key, x, y): mean-centred principal components."""
    v = features.select(key, array_to_vector(F.transform(array, lambda x: x.cast("double"))).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="vector", withMean=True, withStd=False).fit(v).transform(v)
    out = PCA(k=2, inputCol="vector", outputCol="p").fit(centred).transform(centred)
    return out.select(key, vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y"))


def _passed(features: DataFrame, vector: str, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) for the rows A of `features`: a partial product for each partition, added up place by place."""
    size, width = basis.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, width))
        for pdf in batches:
            if len(pdf):
                rows = np.stack(pdf["a"].to_numpy())
                total += rows.T @ (rows @ basis)
        yield pd.DataFrame({"place": np.arange(size * width), "x": total.ravel()})

    parts = features.select(vector_to_array(vector).alias("a")).mapInPandas(run, "place int, x double")
    out = np.zeros(size * width)
    for r in parts.groupBy("place").agg(F.sum("x").alias("x")).collect():  # vocabulary times width
        out[r["place"]] = r["x"]
    return out.reshape(size, width)


def svd(features: DataFrame, k: int = 2, vector: str = "vector", more: int = 8, steps: int = 8, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """`features` with `svd`, its coordinates U S in the k leading directions, and the k largest singular values; rows aren't centred.

    Randomised: a block of k + `more` random directions is multiplied by A'A and made orthogonal, `steps` times, so that it
    holds the leading ones, equal values or not; what A'A is within the block then gives them exactly. A direction's largest
    component is positive. No rows give zeros.
    """
    ship(features.sparkSession)  # bounds the rows that a worker holds as dense vectors
    first = features.select(vector).first()
    size = len(first[0]) if first is not None else 1
    width = min(size, k + more)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(steps):
        basis = np.linalg.qr(_passed(features, vector, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ _passed(features, vector, basis))
    order = np.argsort(-values)[:k]
    axes = basis @ turn[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)

    @F.pandas_udf("array<double>")
    def coordinates(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()) @ axes)) if len(rows) else pd.Series([], dtype=object)

    return features.withColumn("svd", coordinates(vector_to_array(vector))), np.sqrt(np.maximum(values[order], 0.0))


def singular_values(features: DataFrame, vector: str = "vector") -> DataFrame:
    """(no, value): the two largest singular values of the feature rows."""
    return features.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(svd(features, vector=vector)[1])], "no int, value double")

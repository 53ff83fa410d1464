"""URL filters: host and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

GRAMS = (3, 4, 5)
BUCKETS = 1 << 15
EPOCHS = 800
PENALTY = 1e-5

_DIGITS = re.compile(r"\d+")

#: The labelled table: host, path, 1 to block. Subdomains, domains and languages stand on both sides alike.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(path: str | Path = LABELLED) -> list[tuple[str, str, int]]:
    """Rows (host, path, label) of a small labelled table; the driver trains on it."""
    rows = [line.split("\t") for line in Path(path).read_text().splitlines()[1:]]
    return [(host, url_path, int(label)) for host, url_path, label in rows]


def grams_of(host: str, path: str) -> list[int]:
    """Buckets of the distinct n-grams of host and path, each text with its own mark and ends; a number counts as one digit."""
    found = set()
    for mark, text in (("h", f"^{_DIGITS.sub('0', host)}$"), ("p", f"^{_DIGITS.sub('0', path.lower())}$")):
        for n in GRAMS:
            found.update(f"{mark}{text[i : i + n]}" for i in range(len(text) - n + 1))
    return sorted({xxhash.xxh32_intdigest(g) % BUCKETS for g in found})


def train(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent with momentum, on rows scaled to unit length, both labels of equal weight. Deterministic.

    Buckets that no row has keep the weight zero, so only the others are trained.
    """
    grams = [grams_of(host, path) for host, path, _ in rows]
    used = np.unique(np.concatenate([np.array(g, np.int64) for g in [[], *grams]]))
    x = np.zeros((len(rows), len(used)))
    for i, at in enumerate(grams):
        x[i, np.searchsorted(used, at)] = 1 / np.sqrt(max(1, len(at)))
    y = np.array([r[2] for r in rows], float)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(EPOCHS):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        vw, vb = 0.9 * vw - 2.0 * (x.T @ e + PENALTY * w), 0.9 * vb - 2.0 * e.sum()
        w, b = w + vw, b + vb
    whole = np.zeros(BUCKETS)
    whole[used] = w
    return whole, float(b)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule (host and path together, then in the order given) that fits, as struct(rule, verdict); else null.

    The rule table is a parameter of the job, small enough for one expression.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


OWN = ("host", "path", "rule", "verdict", "block_score")


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple = RULES, labelled: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """`pages` with host, path, rule, verdict and block_score (the model's, for every row).

    The verdict is the rule's, else block where block_score is over a half. Null urls, and
    urls without `://`, have empty host and path and are judged by the model on these. Urls of
    any length are taken whole; an empty table gives no rows. Extra columns pass through,
    whatever their names; those named like the added ones are replaced. Rows are judged one by
    one, so ties and repeats change nothing.
    """
    weights, bias = train(labelled_urls() if labelled is None else labelled)
    spark_weights = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BUCKETS floats

    def score(both: str) -> tuple[float]:
        host, _, path = both.partition("\0")
        at = grams_of(host, path)
        return (float(1 / (1 + np.exp(-(spark_weights.value[at].sum() / np.sqrt(max(1, len(at))) + bias)))),)

    passed = [c for c in pages.columns if c not in OWN]
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = pages.select(F.struct(*passed).alias("page"), host.alias("host"), path.alias("path"), F.concat(host, F.lit("\0"), path).alias("text"))
    scored = per_text(split, score, "block_score double").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored.select(*[F.col("page")[c].alias(c) for c in passed], "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "block_score")

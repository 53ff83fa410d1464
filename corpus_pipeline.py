"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing, SentencePiece sampling.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last return the
columns of `documents`. SQL can't express SimHash's XXH64 nor sampling, so there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, quality, sampled_pieces, simhash, substring_dedup
from ledgerloom.llm.common import keep, ordered_key, remove, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others. Null and empty texts are rejected (under 20 words); repeated rows are judged each."""
    kept = quality.apply_quality(docs.select(*COLUMNS))
    return _counted(kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that with the smallest doc_id, nulls last, the first in the table among rows that repeat it. Null and empty texts are one component."""
    keyed = ordered_key(docs.select(*COLUMNS), "doc_id")
    found = simhash.simhash_components(keyed.select("key", "text"), "key")
    heads = found.where("key = component_id").select(F.col("key").alias("_key"))
    return keyed.join(heads.hint("shuffle_hash"), F.col("key") == F.col("_key"), "left_semi").select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts keep the words that no earlier window covers; texts without repeats, null ones as well, stay as they are. All rows stay."""
    done = substring_dedup.substring_dedup(docs.select(*COLUMNS))
    return _counted(done.withColumn("text", F.col("kept_text")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is trained on, in order of training position; none for documents without words."""
    return mixing.curriculum(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each row, seeded by doc_id; see encode_sampled for null, empty and long texts."""
    return sampled_pieces.encode_sampled(docs.select(*COLUMNS))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece sampling", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, each result written and read again; what a stage wrote for itself goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark, "stage_"):
            done = keep(stage(spark, docs, sf_dir), f"stage_{name.replace(' ', '_')}")
        if hasattr(docs, "kept_at"):
            remove(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

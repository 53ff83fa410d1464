"""Conversation prefix trie by partition refinement.

All conversations start in one class. In each round every class that is still active is split by the
next turn of its members; each part is a node, named by its smallest member. A part of one member
retires at once, and so does one whose members go on alike to their ends (sums of hashes of the turns
still to come say so): what is left of it is a chain without branches, written out without further
rounds. So there are as many rounds as the deepest split is deep. The totals are then folded back from
the deepest round to the root.

Turns stay rows: no conversation and no class is gathered. Classes of over a thousandth of all
conversations, fewer than a thousand, are sent to every task; others are shuffled to their members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .common import keep, n_words, remove

#: A class with over a HEAVY-th of all conversations is broadcast; there are fewer than HEAVY.
HEAVY = 1000
_REST = 1 << 40


def joined(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join with classes (unique keys) of which `size` says how many rows they have."""
    heavy = F.broadcast(classes.where(F.col(size) * HEAVY > total))
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(classes.where(F.col(size) * HEAVY <= total), keys)
    return rows.join(heavy, keys).unionByName(light)


def _turns(turns: DataFrame) -> DataFrame:
    """Each turn with a hash of it, its words, and totals over the turns from it to the end."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = turns.select("conv_id", "place", F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256).alias("turn"), n_words(F.col("text")).alias("words"))
    mix = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col("place"), F.col("turn")), F.lit(_REST))
    rest = running(said, ["conv_id"], [F.desc("place")], {"left": F.lit(1), "rest_words": F.col("words"), "rest_a": mix(1), "rest_b": mix(2)})
    return rest.withColumn("length", F.col("place") + F.col("left") - 1)


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of conversations (conv_id, place from 1 without gaps, role, text).

    nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens: words of the last
    turns below and in the node, once for each member but one. ends: (conv_id, depth, member), the node at which each member ends.
    `conversations` may name more (conv_id), which have no turns. Null roles and texts count as empty, null conv_ids take no
    part, other columns are left out. No conversation at all gives no node, not even a root.
    """
    given = turns.where(F.col("conv_id").isNotNull())
    table = keep(_turns(given), "turns")
    lengths = table.where("place = 1").select("conv_id", "length")
    if conversations is not None:
        more = conversations.where(F.col("conv_id").isNotNull()).select("conv_id").distinct()
        lengths = more.join(lengths, "conv_id", "full").select("conv_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    active = keep(_rooted(lengths), "active")
    total = active.count()
    first, rounds, depth = active, [], 0
    while not active.where(F.col("length") > depth).isEmpty():
        depth += 1
        here = table.where(F.col("place") == depth).select("conv_id", "turn", "words", "rest_words", "rest_a", "rest_b")
        members = active.where(F.col("length") >= depth).select("conv_id", F.col("node").alias("parent"), "length").join(here, "conv_id")
        rest = F.struct("length", "rest_a", "rest_b")
        classes = members.groupBy("parent", "turn").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), (F.min(rest) == F.max(rest)).alias("retired"))
        classes = keep(classes, "classes")
        split = joined(members, classes, ["parent", "turn"], "n", total)
        split = keep(split.select(F.lit(depth).cast("long").alias("depth"), "conv_id", "parent", "node", "n", "retired", "length", "words", "rest_words"), "split")
        remove(classes)
        rounds.append(split)
        active = split.where("not retired").select("conv_id", "node", "length")
    ends = first.where("length = 0").select(F.col("node").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    if rounds:
        ended = _together(rounds).where("retired or length = depth")
        ends = ends.unionByName(ended.select(F.col("node").alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member")))
    return _fold(first, rounds, table), ends


def _together(tables: list[DataFrame]) -> DataFrame:
    """Kept tables of one schema, read in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.kept_at for t in tables])


def _rooted(lengths: DataFrame) -> DataFrame:
    """Every conversation in the one class of the root."""
    smallest = lengths.agg(F.min("conv_id")).first()[0]
    return lengths.select("conv_id", F.lit(smallest).cast("long").alias("node"), "length")


def _fold(first: DataFrame, rounds: list[DataFrame], table: DataFrame) -> DataFrame:
    """All nodes with their totals: level by level from the deepest, each written, and the chains in closed form."""
    saved = (F.col("n") - 1) * F.col("rest_words")
    levels: list[DataFrame] = []
    for split in reversed(rounds):
        own = split.where("conv_id = node").select("depth", "node", "parent", "n", "retired", "length", "words", "rest_words")
        level = _summed(own, levels[-1] if levels else None).select(
            F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(F.col("retired"), (F.col("length") > F.col("depth")).cast("long")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.when(F.col("retired"), 1).otherwise(F.coalesce("leaves", F.lit(1))).cast("long").alias("n_leaves"),
            F.when(F.col("retired"), saved).otherwise((F.col("n") - 1) * F.col("words") + F.coalesce("more", F.lit(0))).alias("saved_tokens"),
        )
        levels.append(keep(level, "level"))
    root = first.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    top = _summed(root, levels[-1] if levels else None).select(
        F.col("node").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("more", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    if not rounds:
        return top
    retired = _together(rounds).where("conv_id = node and retired").select("conv_id", "n", F.col("depth").alias("_top"))
    chain = retired.join(table, "conv_id").where("place > _top").select(
        "conv_id", F.col("place").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("left") > 1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"),
    )
    return top.unionByName(_together(levels)).unionByName(chain)


def _summed(own: DataFrame, below: DataFrame | None) -> DataFrame:
    """Nodes of a level with what their children add up to; added up before the shuffle."""
    if below is None:
        nothing = F.lit(None).cast("long")
        return own.withColumns({"children": nothing, "leaves": nothing, "more": nothing})
    up = below.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("more"))
    return own.join(up, "node", "left")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, sha256): hex digest of a node's members that end there, ascending, in decimal, joined by commas.

    A digest is a chain, so one task takes a node's members in order, one at a time, and holds the digest only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, rows = None, None, []
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "said")), strict=True):
                if key[:2] != node:
                    if digest is not None:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = key[:2], hashlib.sha256(key[2].encode())
                else:
                    digest.update(f",{key[2]}".encode())
            yield _batch(rows)
            rows = []
        if digest is not None:
            yield _batch([(*node, digest.hexdigest())])

    # Members of a stretch of ids, at most as many as it is long, go together.
    stretch = F.floor(F.col("member") / 4096)
    said = ends.groupBy("conv_id", "depth", stretch.alias("_stretch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("said"))
    return said.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "_stretch").mapInArrow(run, "conv_id long, depth long, sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "depth", "sha256"])


def digest_or_empty(sha256: Column) -> Column:
    return F.coalesce(sha256, F.lit(hashlib.sha256(b"").hexdigest()))

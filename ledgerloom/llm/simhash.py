"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints at three or fewer differing bits have a 32-bit half that differs
in one bit at most. Each distinct fingerprint is indexed under every one-wildcard variant
of both halves (64 keys); an equality on the key finds the candidates, which are verified.

A key shared by more than GROUP distinct fingerprints is divided by the same rule on the
other half (two 16-bit segments, then two 8-bit ones). After the last division a key
leaves at most eleven bits open, so no group exceeds 2,048 fingerprints, whatever the data.
Within a group a spanning forest of verified links is emitted, never all its pairs.

Both sides of every join grow with the documents and may be small on disk, so all are sort-merge
joins by hint: the driver holds no table for a broadcast.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import keep, per_text, remove, words_of

SHINGLE = 3
MOST_BITS = 3
GROUP = 2048
SEED = 42


def fingerprint_of(text: str | None) -> int:
    """SimHash of the XXH64 of three-word shingles, A-Z lower-cased; 0 without words; as a signed number."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    n = max(1, len(words) - SHINGLE + 1)
    ends = (starts + lens)[-n:]
    xx = xxhash.xxh64_intdigest
    h = np.fromiter([xx(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64, n)
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(n, 64)
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # 255 ones fit a byte
        set_in += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_text(plain, lambda text: (fingerprint_of(text),), "fp long")


def forest(fps: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints."""
    if len(fps) == 2:
        return [(int(fps[0]), int(fps[1]))] if np.bitwise_count((fps[:1] ^ fps[1:]).view(np.uint64))[0] <= most else []
    x = np.asarray(fps, np.int64).view(np.uint64)
    left = np.ones(len(x), bool)
    found = []
    while left.any():  # breadth first from one of those not yet reached
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front:
            i = front.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(x[rest] ^ x[i]) <= most]
            left[near] = False
            found += [(int(fps[i]), int(fps[j])) for j in near]
            front += near.tolist()
    return found


def _variants(level: int, fp: str = "fp") -> F.Column:
    """The one-wildcard variants of a fingerprint's segments at a level: 2 x 32, then 2 x 16, then 2 x 8 bits of what is open."""
    bits = 32 >> level
    return F.expr(
        f"transform(sequence(0, {2 * bits - 1}), i -> named_struct('seg', i div {bits}, 'pos', i % {bits}, "
        f"'rest', shiftrightunsigned({fp}, cast((i div {bits}) * {bits} as int)) & ((1L << {bits}) - 1) & ~(1L << (i % {bits}))))"
    )


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): verified links that connect what links of three or fewer bits connect, among distinct fingerprints `fp`."""
    ship(fps.sparkSession)
    forests = F.pandas_udf(lambda groups: groups.map(lambda x: [{"a": a, "b": b} for a, b in forest(np.asarray(x, np.int64))]), "array<struct<a:long,b:long>>")
    # Dealt out before 64 rows are made of each: fingerprints are small, and few tasks would hold them. By a hash, since Spark drops a second dealing by the same column.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    # `open_` holds the bits that the key leaves open, moved to the low end.
    rows = fps.select("fp", F.explode(_variants(0)).alias("v")).select(
        "fp", F.xxhash64(F.lit(0), "v.seg", "v.pos", "v.rest").alias("k"), F.expr("shiftrightunsigned(fp, cast((1 - v.seg) * 32 as int)) & 4294967295L").alias("open_")
    )
    found = None
    for level in (1, 2, 3):
        shared = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = keep(rows.join(shared.hint("merge"), "k"), f"variants{level}")
        small = rows if level == 3 else rows.where(F.col("n") <= group)
        pairs = small.groupBy("k").agg(F.collect_list("fp").alias("g")).select(F.explode(forests("g")).alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        large = rows.where(F.col("n") > group)
        if level == 3 or large.isEmpty():
            break
        bits = 32 >> level
        rows = large.select("fp", "k", "open_", F.explode(_variants(level, "open_")).alias("v")).select(
            "fp", F.xxhash64("k", "v.seg", "v.pos", "v.rest").alias("k"), F.expr(f"shiftrightunsigned(open_, cast((1 - v.seg) * {bits} as int)) & ((1L << {bits}) - 1)").alias("open_")
        )
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that links reach; only nodes with links.

    Large-star and small-star steps by turns, as joins, until the links stop changing; a
    node with very many links is pre-aggregated, and its join is one that Spark can split.
    """
    now, before = keep(edges.select("a", "b").where("a <> b"), "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Links now point from larger to smaller; each node's smaller neighbours and itself go under the smallest.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = keep(small, "links")
        remove(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the row's own included. Null and
    empty texts have fingerprint zero and are linked like any other. Rows that repeat an id
    are rows of their own. A null id stays null and is no component's name unless nothing
    else is there. Long texts are taken whole; other columns are not read. An id column with the
    name of a result is called doc_id in it.
    """
    marked = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(distinct.select("fp")))
    named = distinct.join(rooted.hint("merge"), distinct["fp"] == rooted["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots.hint("merge"), "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp").select(F.col("doc_id").alias("doc_id" if id_col in ("fingerprint", "component_id") else id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

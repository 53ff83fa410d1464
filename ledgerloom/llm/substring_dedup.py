"""Substring dedup by Relative Lempel-Ziv parsing against indexed reference blocks.

Every run of window starts that share an anchor (the smallest 10-word hash inside
the 20-word window) is a *reference block*. Equal windows have equal anchors, so a
block's bucket, chosen by its anchor, brings together all places that can hold a
window. Per bucket each window learns its earliest place in the corpus; windows that
advance in step with their places form a run, which a *factor* (start, words, reference
document, reference start) copies. A document is parsed greedily from left to right: at
each word the longest factor that a run offers, else on to the next run. Factors, of 20 words and more,
are the duplicate spans; windows that reach over the end of a factor are looked up
there, since they may repeat another block. Nothing else goes. A run follows its windows' earliest
places, so a longer copy whose parts also stand earlier elsewhere is parsed as several factors.

One shuffle carries about nine bytes for each window, with repeats inside a task
already folded into their first place, so that a passage held by a third of the
corpus reaches a bucket once for each million windows. Windows that differ but share a
frequent anchor (a line of 10 to 19 words between other words) are blocks of their own,
dealt out by their own hash, so that no anchor makes a bucket hot.

Windows are compared by 64-bit polynomial hashes of 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import ordered_key, words_of

WINDOW = 20
ANCHOR = 10
FLUSH = 1 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 256
#: Text whose anchors are counted to find the heavy ones, how many of these there may be, and the windows in it from which one is heavy.
SAMPLE_BYTES = 32 << 20
HEAVY_ANCHORS = 4096
HEAVY_WINDOWS = 64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_KINDS = ("<u1", "<u2", "<u4", "<i8")
FACTOR = ("start", "n_words", "ref_doc", "ref_start")
DONE = (
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("kept_sha256", pa.string()),
    ("kept_text", pa.string()),
    ("factors", pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))),
)
RUN = "doc_id long, start int, len int, ref_doc long, ref_start int"


class WordHashes(dict):
    """Word to 64-bit hash, computed once for each word and emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type, after a byte that names it."""
    top = int(x.max()) if len(x) else 0
    kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    return bytes([kind]) + x.astype(_KINDS[kind]).tobytes()


def _unsmall(b: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    kind = np.dtype(_KINDS[b[at]])
    end = at + 1 + n * kind.itemsize
    return np.frombuffer(b[at + 1 : end], kind).astype(np.int64), end


def pack_blocks(doc: np.ndarray, pos: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> bytes:
    """Blocks in order of document: first document, steps to the next, starts, lengths, then a hash for each window."""
    return struct.pack("<Iq", len(doc), doc[0]) + _small(np.diff(doc, prepend=doc[0])) + _small(pos) + _small(count) + hashes.astype("<u8").tobytes()


def unpack_blocks(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and hash of each window."""
    n, first = struct.unpack_from("<Iq", b)
    view = memoryview(b)
    step, at = _unsmall(view, 12, n)
    pos, at = _unsmall(view, at, n)
    count, at = _unsmall(view, at, n)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first + np.cumsum(step), count), np.repeat(pos, count) + within, np.frombuffer(view[at:], "<u8")


def runs_of(doc: np.ndarray, pos: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray) -> dict[str, np.ndarray]:
    """Windows, in order of (doc, pos), joined where both places advance in step."""
    if not len(doc):
        return {k: np.zeros(0, np.int64) for k in ("doc_id", "start", "len", "ref_doc", "ref_start")}
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_pos[1:] != ref_pos[:-1] + 1)
    at = np.flatnonzero(new)
    return {"doc_id": doc[at], "start": pos[at], "len": np.diff(at, append=len(doc)), "ref_doc": ref_doc[at], "ref_start": ref_pos[at]}


def hashed(x: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hash and anchor of the window that starts at each word."""
    n = len(x)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _powers(_BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n)
    whole = _mix((sums[window:] - sums[:-window]) * back[: n - window + 1])
    low = _mix((sums[anchor:] - sums[:-anchor]) * back[: n - anchor + 1] ^ np.uint64(0x2545F4914F6CDD1D))
    span = window - anchor + 1
    size = 1
    while size * 2 <= span:  # smallest of 2, 4, 8 ... neighbours
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    return whole, low


def blocks_of(ids: list[int], arrays: list[np.ndarray], buckets: int, heavy: np.ndarray | None = None, window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[tuple[int, bytes | None, bytes | None]]:
    """Rows (bucket, blocks, runs already known to be repeats) for some documents' word hashes."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    lens = np.array([len(arrays[i]) for i in order])
    x = np.concatenate([arrays[i] for i in order])
    whole, low = hashed(x, window, anchor)
    doc_no = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    at = np.arange(len(whole))
    at = at[at + window <= (first + lens)[doc_no[at]]]
    doc, pos, h, a = np.array(ids, np.int64)[order][doc_no[at]], at - first[doc_no[at]], whole[at], low[at]
    by = np.argsort(h, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = h[by][1:] != h[by][:-1]
    origin = np.empty(len(by), np.int64)
    origin[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    fresh = origin == np.arange(len(by))
    again = np.flatnonzero(~fresh & ((doc != doc[origin]) | (pos != pos[origin])))
    if len(again):
        runs = runs_of(doc[again], pos[again], doc[origin[again]], pos[origin[again]])
        yield int(h[again[0]] % np.uint64(buckets)), None, np.stack([v.astype("<i8") for v in runs.values()]).tobytes()
    doc, pos, h, a = doc[fresh], pos[fresh], h[fresh], a[fresh]
    if heavy is not None and len(heavy):  # windows of a heavy anchor are blocks of their own, dealt by their own hash
        a = np.where(heavy[np.minimum(np.searchsorted(heavy, a), len(heavy) - 1)] == a, h, a)
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (a[1:] != a[:-1])
    start = np.flatnonzero(new)
    count = np.diff(start, append=len(h))
    bucket = (a[start] >> np.uint64(20)) % np.uint64(buckets)
    runs_by = np.argsort(bucket, kind="stable")
    h = h[np.argsort(np.repeat(bucket, count), kind="stable")]
    doc, pos, count, bucket = doc[start][runs_by], pos[start][runs_by], count[runs_by], bucket[runs_by]
    edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1)))
    ends = np.cumsum(count)
    for lo, hi in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        yield int(bucket[lo]), pack_blocks(doc[lo:hi], pos[lo:hi], count[lo:hi], h[ends[lo] - count[lo] : ends[hi - 1]]), None


def _index(buckets: int, heavy: list[int]):
    heavy_sorted = np.sort(np.array(heavy, np.int64).view(np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = WordHashes()

        def packed(ids: list[int], arrays: list[np.ndarray]) -> pd.DataFrame:
            return pd.DataFrame(blocks_of(ids, arrays, buckets, heavy_sorted), columns=["bucket", "blocks", "known"])

        ids: list[int] = []
        arrays: list[np.ndarray] = []
        held = 0
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                ids.append(key)
                arrays.append(np.fromiter(map(of.__getitem__, words), np.uint64, len(words)))
                held += len(words)
                if held >= FLUSH:
                    yield packed(ids, arrays)
                    ids, arrays, held = [], [], 0
        if ids:
            yield packed(ids, arrays)

    return run


def earliest(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the windows that also start earlier, as runs, with their earliest places."""
    known = [np.frombuffer(b, "<i8").reshape(5, -1) for b in pdf["known"] if b is not None]
    parts = [unpack_blocks(b) for b in pdf["blocks"] if b is not None]
    if parts:
        doc, pos, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        by = np.argsort(h, kind="stable")
        hs = h[by]
        same = hs[1:] == hs[:-1]
        shared = np.zeros(len(by), bool)
        shared[1:] |= same
        shared[:-1] |= same
        by = by[shared]
        by = by[np.lexsort((pos[by], doc[by], h[by]))]
        new = np.ones(len(by), bool)
        new[1:] = h[by][1:] != h[by][:-1]
        origin = by[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else by
        late = (doc[by] != doc[origin]) | (pos[by] != pos[origin])
        by, origin = by[late], origin[late]
        o = np.lexsort((pos[by], doc[by]))
        by, origin = by[o], origin[o]
        known.append(np.stack(list(runs_of(doc[by], pos[by], doc[origin], pos[origin]).values())))
    all_runs = np.concatenate(known, axis=1) if known else np.zeros((5, 0), np.int64)
    return pd.DataFrame({k: v.astype(t) for k, v, t in zip(("doc_id", "start", "len", "ref_doc", "ref_start"), all_runs, (np.int64, np.int32, np.int32, np.int64, np.int32), strict=True)})


def factors_of(starts: np.ndarray, lens: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy parse: at each word take the longest factor that a run offers there, else step to the next run."""
    found, at = [], 0
    for i in np.lexsort((lens, starts)):
        s, n = int(starts[i]), int(lens[i])
        at_run = max(at, s)
        if at_run < s + n:
            words = s + n - 1 + window - at_run
            found.append((at_run, words, int(ref_doc[i]), int(ref_start[i]) + at_run - s))
            at = at_run + words
    return found


def covered(spans: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    """The words of a text that factors copy."""
    edge = np.zeros(n + 1, np.int64)
    for start, words, *_ in spans:
        edge[start] += 1
        edge[start + words] -= 1
    return np.cumsum(edge[:-1]) > 0


def straddling(gone: np.ndarray, spans: list[tuple[int, int, int, int]], starts: np.ndarray, lens: np.ndarray, window: int = WINDOW) -> None:
    """Check the windows that reach over the end of a factor: those that repeat another block go as well.

    The parse passes over no other window that repeats: one that begins after a factor's end begins a factor itself.
    """
    n = len(gone)
    ends = np.array([start + words for start, words, *_ in spans], np.int64)
    over, repeats, more = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.add.at(over, np.maximum(ends - window + 1, 0), 1)
    np.add.at(over, ends, -1)
    np.add.at(repeats, starts, 1)
    np.add.at(repeats, starts + lens, -1)
    checked = np.flatnonzero((np.cumsum(over[:-1]) > 0) & (np.cumsum(repeats[:-1]) > 0))
    more[checked] += 1
    more[checked + window] -= 1
    gone |= np.cumsum(more[:-1]) > 0


def _apply(with_text: bool, window: int = WINDOW):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, lens, ref_doc, ref_start in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "lens", "ref_doc", "ref_start")), strict=True):
                words = words_of(text)
                n, spans = len(words), []
                if starts:
                    runs = [np.asarray(x) for x in (starts, lens, ref_doc, ref_start)]
                    spans = factors_of(*runs, window)
                    gone = covered(spans, n)
                    straddling(gone, spans, runs[0], runs[1], window)
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                row = (n, n - len(words), hashlib.sha256(kept).hexdigest())
                if with_text:
                    row += (text if n == len(words) else kept.decode("utf-8", "surrogatepass"), [dict(zip(FACTOR, x, strict=True)) for x in spans])
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(DONE[: 5 if with_text else 3])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_rest"), *(pa.array(x, t) for x, (_, t) in zip(columns, DONE, strict=False))],
                names=["_id", "_rest", *(name for name, _ in DONE[: len(columns)])],
            )

    return run


def heavy_anchors(plain: DataFrame, n_bytes: int) -> list[int]:
    """Anchors that many windows share, from a sample of the documents: at most HEAVY_ANCHORS.

    They only say which blocks to spread; any list gives the same result.
    """
    every = max(1, n_bytes // SAMPLE_BYTES)
    sample = plain.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", "text")
    counts = sample.mapInPandas(_count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "anchor").limit(HEAVY_ANCHORS).collect()
    return sorted(r["anchor"] for r in top if r["n"] >= HEAVY_WINDOWS)


def _count_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    of = WordHashes()
    for pdf in batches:
        found = []
        for text in pdf["text"]:
            words = words_of(text)
            if len(words) >= WINDOW:
                x = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
                found.append(np.stack(hashed(x)))
        if found:
            h, a = np.concatenate(found, axis=1)  # equal windows weigh once: they fold
            a, n = np.unique(a[np.unique(h, return_index=True)[1]], return_counts=True)
            many = n > 1
            yield pd.DataFrame({"anchor": a[many].view(np.int64), "n": n[many]})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove the words covered by a 20-word window that also starts earlier in the corpus.

    Returns every row of `docs`, its columns, and n_words, n_removed, kept_sha256; with
    `with_text` also kept_text (the text unchanged where nothing goes, else the kept words
    joined by single spaces) and factors (start, n_words, ref_doc, ref_start: copies from
    reference blocks, in the greedy parse; ref_doc is the row's key).

    Null or empty texts have no words. A text of any length is taken whole. Rows that repeat
    an id, or have none, stay apart: they count as documents in the order of (id, nulls last,
    place in the table). Among windows with equal words only the earliest stays. Extra columns
    pass through; internal columns start with an underscore.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    # Rows travel as id, text and one struct of the rest, so no column of theirs can clash.
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))).alias("_rest"))
    plain = ordered_key(plain, "_id")
    n_bytes = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, math.ceil(n_bytes / BUCKET_BYTES))
    blocks = plain.select("key", "text").mapInPandas(_index(buckets, heavy_anchors(plain, n_bytes)), "bucket int, blocks binary, known binary")
    runs = blocks.groupBy("bucket").applyInPandas(earliest, RUN)
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "ref_doc", "ref_start")).alias("_runs"))
    # The runs are the smaller side; hashing them spares sorting the texts.
    joined = plain.join(by_doc.hint("shuffle_hash"), plain["key"] == by_doc["doc_id"], "left")
    fed = joined.select("_id", "_rest", "text", *[F.col("_runs")[c].alias(to) for c, to in (("start", "starts"), ("len", "lens"), ("ref_doc", "ref_doc"), ("ref_start", "ref_start"))])
    out = "n_words long, n_removed long, kept_sha256 string" + (", kept_text string, factors array<struct<start:int,n_words:int,ref_doc:long,ref_start:int>>" if with_text else "")
    schema = T.StructType([fed.schema["_id"], fed.schema["_rest"], *T._parse_datatype_string(out).fields])
    done = fed.mapInArrow(_apply(with_text), schema)
    own = [f.name for f in schema.fields[2:]]
    return done.select(F.col("_id").alias(id_col), *[F.col("_rest")[c].alias(c) for c in rest if c not in own], *own)

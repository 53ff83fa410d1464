"""Periodic runs, the conversation trie and byte-pair encoding against brute force and the library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, prefix_trie, queries, runs

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_runs(w):
    """By the definition: every period, every stretch; of stretches that are the same, the smallest period."""
    n, seen, out = len(w), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9), st.integers(1, 40)), max_size=6), st.sampled_from([8, 1 << 16]))
def test_runs_are_exact(parts, window):
    w = [c.encode() for unit, times, cut in parts for c in (unit * times)[:cut]]
    kept, runs.WINDOW = runs.WINDOW, window
    try:
        assert runs.runs_of(w) == brute_runs(w)
    finally:
        runs.WINDOW = kept


def test_runs_of_long_periods_and_long_texts():
    w = [str(i % 5000).encode() for i in range(23_456)]
    assert runs.runs_of(w) == [(0, 23_456, 5000)]
    assert runs.runs_of([b"a"] * 60_000) == [(0, 60_000, 1)]
    assert runs.runs_of([str(i // 2).encode() for i in range(30_000)]) == []
    assert runs.collapse([b"x", *[b"a", b"b"] * 4, b"y"], [(1, 8, 2)]) == [b"x", b"a", b"b", b"y"]


def test_find_runs_query_and_odd_rows(spark):
    rows = [(1, "a b " * 5 + "c", "x"), (1, "a b " * 5 + "c", "x"), (2, None, None), (3, "", "y"), (4, " \n\t ", "y"), (None, "q " * 40_000, "y"), (5, "no run here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(runs.find_runs(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (None, 40_000, [(0, 40_000, 1)], "q"), (1, 11, [(0, 10, 2)], "a b c"), (1, 11, [(0, 10, 2)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 3, [], "no run here"),
    ]
    assert runs.find_runs(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op11_periodic_runs(spark, DATA).collect():
        w, h = (texts[r.doc_id] or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = brute_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def brute_trie(conversations):
    """{(depth, conv_id): (parent, n_convs, n_children, n_leaves, saved, ends)} of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for p, m in members.items():
        below = [x for x in members if x[: len(p)] == p]
        saved = sum((len(members[x]) - 1) * len((x[-1][1] or "").encode().split()) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        out[len(p), min(m)] = (min(members[p[:-1]]) if p else None, len(m), sum(len(x) == len(p) + 1 for x in below), leaves, saved, sorted(c for c in m if conversations[c] == list(p)))
    return out


def _trie(nodes, ends):
    at = defaultdict(list)
    for r in ends.collect():
        at[r.depth, r.conv_id].append(r.member)
    return {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sorted(at[r.depth, r.conv_id])) for r in nodes.collect()}


def test_trie_is_exact(spark):
    rng = np.random.default_rng(1)
    say = lambda k: ("user" if rng.random() < 0.5 else "bot", " ".join(["w"] * int(rng.integers(0, k))))
    convs = {i: [say(3) for _ in range(int(rng.integers(0, 5)))] for i in range(60)}
    convs |= {100 + i: convs[3] + [("user", "same")] * 9 for i in range(40)} | {200: [("a", "b c")] * 12, 201: [("a", "b c")] * 11 + [("a", "b")], 202: []}
    rows = [(c, i + 1, r or None, t or None, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows.append((None, 1, "user", "lost", "x"))
    turns = spark.createDataFrame(rows, "conv_id long, place long, role string, text string, node string").repartition(3)
    every = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    want = brute_trie(convs)
    nodes, ends = prefix_trie.prefix_trie(turns, every)
    assert _trie(nodes, ends) == want
    digests = {(r.depth, r.conv_id): r.sha256 for r in prefix_trie.ends_digest(ends).collect()}
    assert digests == {k: hashlib.sha256(",".join(map(str, v[5])).encode()).hexdigest() for k, v in want.items() if v[5]}
    nodes, ends = prefix_trie.prefix_trie(turns.limit(0))
    assert nodes.count() == 0 and ends.count() == 0
    nodes, ends = prefix_trie.prefix_trie(turns.limit(0), every.where("conv_id in (5, 202)"))
    assert _trie(nodes, ends) == {(0, 5): (None, 2, 0, 1, 0, [5, 202])}


def test_trie_of_classes_that_are_sent_to_every_task(spark, monkeypatch):
    """No class is heavy, or all are: the same trie."""
    convs = {i: [("u", f"t{i % 3}"), ("b", f"s{i % 7}"), ("u", "x")][: 1 + i % 3] for i in range(50)}
    turns = spark.createDataFrame([(c, i + 1, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)], "conv_id long, place long, role string, text string")
    for heavy in (1, 1000):
        monkeypatch.setattr(prefix_trie, "HEAVY", heavy)
        assert _trie(*prefix_trie.prefix_trie(turns)) == brute_trie(convs)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def agrees(library, text):
    packed = bpe.encoder(PATH)(text)
    ids = library.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids, text
    assert bpe.decode_ids(bpe.load(PATH), packed) == library.decode(ids, skip_special_tokens=False)


_PARTS = st.sampled_from(["a", "b", "th", "he", "ing", "'s", "'LL", " ", "\n", "12", "é", "ß", "İ", "Σ", "σς", "́", "<|endoftext|>", "<|startoftext|>", "<|end", "\x1c", "\x85", " ", "中文", "😀", "aaaa", "!!", "--", "\x00"])


@settings(max_examples=500, deadline=None)
@given(st.lists(_PARTS, max_size=25), st.text(max_size=20), st.text("aeinrst", max_size=60))
def test_bpe_is_the_librarys(parts, odd, letters):
    t = Tokenizer.from_file(PATH)
    for text in ("".join(parts), odd, letters):
        agrees(t, text)


def test_bpe_of_every_character_and_of_long_words(library):
    for low in range(0, 0x20000, 512):
        agrees(library, " ".join(f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(low, low + 512) if not 0xD800 <= c < 0xE000))
    agrees(library, "a" * 30_000 + "-" * 5000 + "ab" * 5000)


def test_bpe_merges_by_rank():
    """The pair table against merging step by step, over words without a whole-word token."""
    v = bpe.load(PATH)
    rng = np.random.default_rng(7)
    letters = [v.inside[ord(c)] for c in "aeinrsthou"]
    for _ in range(2000):
        word = "".join(rng.choice(letters, rng.integers(1, 14)))
        ids = [ord(c) for c in word]
        while True:
            ranked = [(v.made[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in v.made]
            if not ranked:
                break
            made, i = min(ranked)
            ids[i : i + 2] = [made]
        assert v.encode_word(word) == ids


def test_bpe_tables_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    for text in ("the cat sat on the mat xq zzyx " * 3, "qwxyz wxyzq xyzqw yzqwx"):
        agrees(library, text)


def test_bpe_query_and_odd_rows(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op13_bpe(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(1, "Hi there", 5), (1, "Hi there", 5), (None, None, None), (2, "", 0), (3, "x " * 50_000, 1)], "doc_id long, text string, ids long")
    out = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert out.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or 0, r.text[:20]) for r in out.collect()) == [(0, ""), (1, "hi</w> there</w>"), (1, "hi</w> there</w>"), (2, ""), (3, "x</w> x</w> x</w> x<")]
    assert bpe.encode(odd.limit(0), PATH).count() == 0

"""Training-data operators against brute force, round trips and edge rows."""

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import ann, chat, common, mixing, oracle, quality, queries, sampled_pieces, simhash, substring_dedup, toxicity, urls, warc
from ledgerloom.operators import running

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats and ties, a column with a clashing name."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1, "x"), (2, words + " tail", "en", "a", 1, None), (2, words, None, None, None, None), (None, None, None, None, None, None), (None, words, "en", "b", 0, "y"), (5, "", "en", "b", 0, "y"), (6, "\n\t ", "en", "b", 0, "y"), (7, "q " * 30_000, "en", "b", 0, "y"), (7, "q " * 30_000, "en", "b", 0, "y")]
    return spark.createDataFrame(rows, DOC).repartition(3)


def brute_substrings(docs):
    """docs in order: words kept of each."""
    seen, kept = set(), []
    for _, text in docs:
        w = (text or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        kept.append([x for i, x in enumerate(w) if i not in gone])
    return kept


def test_substring_dedup_is_exact(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    for (i, text), kept in zip(rows, brute_substrings(rows), strict=True):
        assert got[i].n_words - got[i].n_removed == len(kept) and got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    words = {i: (t or "").split() for i, t in rows}
    for r in got.values():  # factors copy what their reference says
        for f in r.factors:
            assert words[r.doc_id][f.start : f.start + f.n_words] == words[f.ref_doc][f.ref_start : f.ref_start + f.n_words]
            assert (f.ref_doc, f.ref_start) < (r.doc_id, f.start)


def test_substring_dedup_odd_rows(spark, odd):
    got = substring_dedup.substring_dedup(odd).collect()
    assert len(got) == 9 and {"score", "source"} <= set(got[0].asDict())
    # The first text stays, then "tail" of the next, and one "q": its later windows start later.
    assert sorted(r.n_words - r.n_removed for r in got) == [0] * 6 + [1, 1, 60]
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


def test_simhash_components(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = simhash.simhash_components(docs).orderBy("doc_id").collect()
    fp, ids = np.array([int(r.fingerprint, 16) for r in got], np.uint64), [r.doc_id for r in got]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if int(fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert [r.component_id for r in got] == [ids[find(i)] for i in range(len(fp))]
    text = "One Two three four"
    h = [__import__("xxhash").xxh64_intdigest(s, 42) for s in (b"one two three", b"two three four")]
    assert simhash.fingerprint_of(text) % 2**64 == h[0] & h[1]
    odd_rows = simhash.simhash_components(odd).collect()
    assert len(odd_rows) == 9 and {r.component_id for r in odd_rows if r.fingerprint == "0" * 16} == {5}
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_simhash_broadcasts_no_table(spark, odd, monkeypatch):
    """The driver has no room for them, however small they are on disk."""
    plans, write = [], simhash.keep
    monkeypatch.setattr(simhash, "keep", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    done = simhash.simhash_components(odd)
    plans.append(("result", done._jdf.queryExecution().executedPlan().toString()))
    assert {name for name, _ in plans} >= {"variants1", "links", "result"} and not [name for name, plan in plans if "Broadcast" in plan]


def test_simhash_divides_large_groups(spark):
    rng = np.random.default_rng(1)
    fps = {int(12345678901234567 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))) for _ in range(300)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = {tuple(sorted(r)) for r in simhash.components(simhash.links(df)).collect()}
    divided = {tuple(sorted(r)) for r in simhash.components(simhash.links(df, group=8)).collect()}
    assert whole == divided and whole


def test_quality_rules(spark, odd):
    line = "this common line is everywhere and says nothing at all here"
    body = lambda i: " ".join(f"d{i}x{j}" for j in range(40))
    docs = spark.createDataFrame([(i, f"{line}\n{body(i)}" if i else line, "a") for i in range(30)] + [(99, line + "\n" + line + "\n" + line + " more words of its own so that twenty are reached", "a")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert got[1].n_removed_words == 11 and got[1].kept and got[0].n_removed_words == 11 and not got[0].kept  # too short
    assert got[99].n_dup_lines == 1 and got[99].n_repeat_words == 33 and got[99].base_failed
    texts = {r.doc_id: r.text for r in quality.apply_quality(docs).collect()}
    assert texts[1] == body(1) and 0 not in texts
    short = spark.createDataFrame([(i, f"{line}\nanother of those lines that all pages of this host have\nown words {i}", "a") for i in range(30)], "doc_id long, text string, source string")
    assert {(r.base_failed, r.kept) for r in quality.quality_rules(short).collect()} == {(False, False)} and quality.apply_quality(short).count() == 0  # depleted
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == 9 and all(r.kept is not None for r in rows) and quality.apply_quality(odd).count() > 0
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_chat_folds_and_round_trips(spark):
    e = [
        (1, 0, 0, "delta", "user", "hi <|im_end|> <\\|x| \\"), (1, 1, 1, "delta", "assistant", "dra"), (1, 1, 2, "delta", None, "ft"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "new"), (1, 1, 6, "delta", None, "!"), (1, 1, 5, "edit", None, "fixed"),
        (None, 0, 0, "delta", None, None), (2, 0, 0, "delta", "as\nsistant", "é" * 9), (2, 0, 0, "delta", "as\nsistant", "é" * 9),
    ]
    df = spark.createDataFrame(e, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = {r.conv_id: r for r in chat.parse(chat.format_chat(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi <|im_end|> <\\|x| \\"), ("assistant", "fixed!")] and got[1].loss_text == "fixed!"
    assert [(t.role, t.text) for t in got[2].turns] == [("as\nsistant", "é" * 18)] and [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 9 and all(r.taken <= 2 * r["size"] for r in got)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix(docs).collect()
    total, by = sum(r["size"] for r in rows), defaultdict(int)
    for r in rows:
        by[r.source] += r.taken
    target, cap = {r.source: r.target for r in rows}, {r.source: 2 * r.source_size for r in rows}
    assert all(by[s] == math.floor(target[s]) for s in by) and abs(sum(target.values()) - 1.5 * total) < 1e-3 and all(target[s] <= cap[s] for s in by)
    level = {s: target[s] / (5, 2, 1)[i % 3] for i, s in enumerate(sorted(target))}
    free = [x for s, x in level.items() if target[s] < cap[s] - 1e-6]
    assert max(free) - min(free) < 1e-6
    order = [r.position for r in mixing.curriculum(mixing.mix(docs)).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_rows_stand_in_training_order(spark, monkeypatch):
    """The query's rows are range-sorted by position; rows of one id, alike or not, are no one group, and none is lost."""
    done = queries.op8_mixing(spark, DATA)
    assert "rangepartitioning(at_first" in done._jdf.queryExecution().executedPlan().toString()
    at = [r.at_first for r in done.collect()]
    taken = [x for x in at if x is not None]
    assert at[: len(taken)] == sorted(taken) and not any(x is not None for x in at[len(taken) :])
    docs = spark.range(0, 4000, 1, 4).selectExpr("cast(null as long) AS doc_id", "if(id < 2000, 'a b c', concat('a b ', id)) AS text", "'s' AS source")
    sorted_rows = []
    monkeypatch.setattr(running, "keep", lambda df, name: sorted_rows.append(common.keep(df, name)) or sorted_rows[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = mixing.mix(docs, with_text=False).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted_rows[0].groupBy(F.shiftright("_at", 33)).count().agg(F.max("count")).first()[0] < 2500
    assert len(rows) == 4000 and {r.source_size for r in rows} == {12000} and sum(r.taken for r in rows) == 18000
    starts = sorted(r.at_first for r in rows)
    assert len(set(starts)) == 4000 and all(abs(x - 3 * i / 18000) < 1e-9 for i, x in enumerate(starts))


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://a.net"), (3, "https://a.net/"), (4, "x://b.org/fr/1"), (5, None), (6, "nothing"), (7, "http://porn-jackpot.example.org/en/9"), (8, "http://evilnet/"), (9, "http://example.com/de/#x"), (10, "http://library.example.org/en/5")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, host string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 2, 3, 4, 5, 6, 8, 9)] == [("a.example.net", "/en/x", "example.net/en/"), ("a.net", "", None), ("a.net", "/", "net/"), ("b.org", "/fr/1", "org/fr/"), ("", "", None), ("", "", None), ("evilnet", "/", None), ("example.com", "/de/", "example.com/de/")]
    assert [got[i].verdict for i in (1, 3, 7, 10)] == ["allow", "block", "block", "allow"]
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, page string, text string")).columns == ["page_id", "url", "page", "text", "host", "path", "rule", "verdict", "block_score"]


def test_url_model_on_hosts_that_it_has_not_seen():
    rows = urls.labelled_urls()
    score = lambda w, b, h, p: w[urls.grams_of(h, p)].sum() / math.sqrt(len(urls.grams_of(h, p))) + b
    pairs = []
    for k in range(8):  # no host is on both sides
        fold = lambda h: zlib.crc32(h.encode()) % 8
        w, b = urls.train([r for r in rows if fold(r[0]) != k])
        pairs += [(score(w, b, h, p) > 0, y) for h, p, y in rows if fold(h) == k]
    hit = sum(g and y for g, y in pairs)
    assert hit / sum(g for g, _ in pairs) >= 0.9 and hit / sum(y for _, y in pairs) >= 0.9
    w, b = urls.train(rows)
    for sub in ("", "blog.", "m.", "www.", "shop.", "news."):
        for name in ("thistleford", "ordinaria", "kettering", "bookbinders", "therapeutics"):
            assert score(w, b, f"{sub}{name}.example.com", "/de/1200/") < 0
        for name in ("casino-cheap", "pills-jackpot", "bonus-porn"):
            assert score(w, b, f"{sub}{name}.example.com", "/de/1200/") > 0


def test_sampled_pieces(spark, odd):
    docs = spark.createDataFrame([(1, "Hello  world\nfoo é中\U0001f600 ▁x "), (2, ""), (3, None), (4, "ab")], "doc_id long, text string")
    got = sampled_pieces.encode_sampled(docs, k=4)
    rows = got.collect()
    assert all(r.decoded_ok for r in rows)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        by[r.doc_id].append(r)
    assert len(by[2]) == 1 and by[2][0].ids == [] and all(len({tuple(r.ids) for r in v}) == len(v) for v in by.values())
    assert all(a.perturbed >= b.perturbed for v in by.values() for a, b in zip(v, v[1:]))
    assert abs(sum(math.exp(r.log_prob) for r in by[4]) - 1) < 1e-9  # all segmentations of a short word
    assert sorted(map(str, rows)) == sorted(map(str, sampled_pieces.encode_sampled(docs.repartition(3), k=4).collect()))
    back = {(r.doc_id, r["rank"]): r.decoded for r in sampled_pieces.decode(got).collect()}
    assert back[(1, 1)] == "Hello  world\nfoo é中\U0001f600  x "
    assert sampled_pieces.encode_sampled(odd).where("not decoded_ok").count() == 0


def test_samples_follow_the_lattice():
    pieces = sampled_pieces.Pieces(open(sampled_pieces.MODEL, "rb").read(), 0.2)
    n, text = 4000, "the"
    got = sampled_pieces.sampled(pieces, list(range(n)), [text] * n, 2, 7)
    p = {tuple(i): math.exp(lp) for g in got for i, lp in zip(g[0], g[1])}
    assert abs(sum(p.values()) - 1) < 1e-6
    first, pairs = Counter(tuple(g[0][0]) for g in got), Counter((tuple(g[0][0]), tuple(g[0][1])) for g in got)
    for a, x in p.items():
        assert abs(first[a] / n - x) < 4 * math.sqrt(x * (1 - x) / n) + 1e-9
        for b, y in p.items():
            if a != b:
                q = x * y / (1 - x)  # without replacement
                assert abs(pairs[(a, b)] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-9


def test_warc(spark):
    rows = [(1, "http://b.example.com/x", "same\r\n\r\nWARC/1.1"), (3, "http://a.example.com/%y\n", "same\r\n\r\nWARC/1.1"), (2, None, None), (9, "nope", ""), (None, "http://b.example.com/x", "é"), (4, "http://b.example.com/x", "z" * 5000)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.build_index(warc.scan_archives(warc.write_archives(pages, archive_bytes=400)), block=2)
    got = {r.page_id: r for r in warc.captures(index).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), 3: ("response", None), 2: ("revisit", 9), 9: ("response", None), None: ("response", None), 4: ("response", None)}
    assert all(got[i].payload_digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() and got[i].payload_bytes == len((h or "").encode()) and got[i].url == u for i, u, h in rows)
    asked = spark.createDataFrame([("http://b.example.com/x",), (None,), ("http://none/",), ("http://a.example.com/%y\n",)], "u string")
    for bound in (100, 1):
        hits = warc.lookup(index, asked, bound).collect()
        assert sorted((r.page_id or 0, bytes(r.payload).decode()) for r in hits) == sorted([(0, "é"), (1, "same\r\n\r\nWARC/1.1"), (2, ""), (3, "same\r\n\r\nWARC/1.1"), (4, "z" * 5000)])
        assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.verified(index, pages.select("url"), bound).collect()) == [(0, "response", 0), (1, "revisit", 3), (2, "revisit", 9), (3, "response", 0), (4, "response", 0), (9, "response", 0)]
    assert warc.captures(warc.build_index(warc.scan_archives(warc.write_archives(pages.limit(0))))).count() == 0


def test_ann(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(list)
    for r in queries.op10_permutation_ann(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].append(r.vec_id)
    pdf = rows.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = sum(len(set(ids[np.argsort(-np.where(ids == q, -9, x @ x[list(ids).index(q)]))[:5]]) & set(v)) for q, v in got.items())
    assert hit / (5 * len(got)) >= 0.9 and all(len(v) == 5 for v in got.values())
    bad = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (50, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (None, [1.0, 1.0]), (6, [1.0, None])], "vec_id long, embedding array<float>")
    out = ann.search(bad, bad.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in out] == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 5, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 5, 0.0)]
    assert ann.search(bad.limit(0), bad.limit(0)).count() == 0


@pytest.fixture(scope="module")
def insulted():
    """A model of three insults among invented words, and labelled texts that it hasn't seen."""
    insults, rng = ["moronic", "blockhead", "dimwit"], np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeiourstnlkp"), rng.integers(3, 9)))
    rows = [(" ".join([word() for _ in range(30)] + ([str(rng.choice(insults))] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(600)]
    return toxicity.train(rows[:400]), rows[400:], " ".join(word() for _ in range(30))


def test_toxicity_tolerates_gaps(insulted):
    model, rest, clean = insulted

    def score(t):
        tokens = toxicity.tokens_of(t)
        model.features().learn([tokens])
        return model.score(model.features().of(tokens))

    assert set(model.landmarks) == {"moronic", "blockhead", "dimwit"}
    assert np.mean([(score(t) >= 0.5) == y for t, y in rest]) > 0.97
    every_gap = ["mxoxrxoxnxixc", "bxlxoxcxkxhxexaxd", "dxixmxwxixt", "m1o1r1o1n1i1c", "b1l1o1c1k1h1e1a1d", "m1o2r3o4n5i6c"]
    one = ["moxronic", "moronxic", "moroonic", "dimmwit", "dimxwit", "dimxxwit", "blxockhead", "blockhzead", "blocckhead", "blxockhexad", "mmoorroonniicc", "moronnnnnnic"]
    glued = ["prefixblockheadsuffix", "youmoronicthing", "xdimwitx", "you-absolute-blockhead", "q" * 3000 + "blockhead" + "z" * 3000, "MORONIC", "m-o-r-o-n-i-c", "b l o c k h e a d", "dim-wit"]
    low = [w for w in every_gap + one + glued if score(f"{clean} {w}") < 0.5]
    assert not low and score(clean) < 0.5 and score("") < 0.5
    assert 0 <= score(None) < 0.5 and 0 <= toxicity.train([]).score(np.zeros(0)) <= 1


def test_toxicity_kernel_is_that_of_the_best_part():
    k = toxicity.Kernel(["blockhead", "moron", "scum"])

    def raw(s, t):  # by enumeration of subsequences
        def weights(w):
            found = defaultdict(list)
            for at in itertools.combinations(range(len(w)), toxicity.ORDER):
                found["".join(w[i] for i in at)].append(toxicity.DECAY ** (at[-1] - at[0] + 1))
            return found

        a, b = weights(s), weights(t)
        return sum(x * y for u in a.keys() & b.keys() for x in a[u] for y in b[u])

    def common(s, t):
        row = [0] * (len(t) + 1)
        for x in s:
            row = _lcs_row(row, x, t)
        return row[-1]

    for word in ("blo1ckh1ead", "xmoronx", "moroon", "scrum", "spectrum", "blocked", "mooring", "bllockkhheaadzz"):
        t, m, v = k.of_tokens([word])
        got = defaultdict(float)
        for mark, x in zip(m, v):
            got[k.words[mark]] = max(got[k.words[mark]], x)
        for mark in k.words:
            best = 0.0
            for form in toxicity.forms(word):
                lacking = int(len(mark) >= toxicity.LACKING)
                if common(form, mark) >= len(mark) - lacking:
                    whole = toxicity.EDGE + mark
                    for i in (i for i, x in enumerate(form) if x in whole[: 2 + lacking]):
                        for j in range(i + 3, min(len(form), i + 2 * len(mark) + 3) + 1):
                            own = math.sqrt(raw(form[i:j], form[i:j]) * raw(whole, whole))
                            best = max(best, raw(form[i:j], whole) / own)
            assert got[mark] == pytest.approx(best**toxicity.POWER if best >= toxicity.LEAST else 0.0, abs=1e-4), (word, mark)


def _lcs_row(row, x, t):
    new = [0]
    for j, y in enumerate(t):
        new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
    return new


def test_toxicity_in_spark(spark, odd, insulted):
    model, rest, clean = insulted
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rest)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rest)] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, fitted).collect()}
    assert np.mean([got[i].predicted == y for i, (_, y) in enumerate(rest)]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == 9 and set(rows[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "score", "predicted"} and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels.limit(0)).landmarks == []


def test_toxicity_held_out():
    """Held-out documents of sf0.1: those with an insult are found, few others flagged. A third of its toxic texts have stems that clean ones have too."""
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    marks = dict(zip(*(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()[c] for c in ("doc_id", "toxic")), strict=True))
    rows = [(i, t, marks[i]) for i, t in zip(docs["doc_id"], docs["text"], strict=True) if i in marks]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.train([(t, y) for i, t, y in rows if not held(i)])
    insults = {"trash", "pathetic", "worthless", "idiot", "disgusting", "loser", "scum", "clown", "moron", "stupid"}
    assert insults <= set(model.landmarks)
    found = []
    for i, t, y in rows:
        if held(i):
            tokens = toxicity.tokens_of(t)
            model.features().learn([tokens])
            found.append((model.score(model.features().of(tokens)) >= 0.5, y, not insults.isdisjoint(map(toxicity.clean, tokens))))
    assert np.mean([p for p, y, insult in found if y and insult]) >= 0.95
    assert np.mean([p for p, y, _ in found if y]) >= 0.88  # in whatever language; a twentieth of them says nothing that others say
    assert sum(p for p, y, _ in found if not y) <= 0.02 * sum(not y for _, y, _ in found)


def test_one_insult_is_enough():
    """Trained on texts of several insults each, the model meets each of them alone."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeiourstnlkp"), rng.integers(3, 9)))
    insults = ["moronic", "blockhead", "dimwit", "scoundrel"]
    rows = [(" ".join([word() for _ in range(40)] + (list(rng.choice(insults, 3, replace=False)) if i % 2 else [])), i % 2) for i in range(400)]
    model = toxicity.train(rows)

    def found(text):
        tokens = toxicity.tokens_of(text)
        model.features().learn([tokens])
        return model.score(model.features().of(tokens)) >= 0.5

    for _ in range(20):
        plain = " ".join(word() for _ in range(60))
        assert all(found(f"{plain} {w}") for w in insults) and not found(plain)


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(400)], 80)) for _ in range(6)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[0]), (None, None), (None, ""), (4, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    left, groups = list(range(len(rows))), []
    fps = [simhash.fingerprint_of(t) & (2**64 - 1) for _, t in rows]
    while left:
        group, front = set(), [left[0]]
        while front:
            i = front.pop()
            group.add(i)
            front += [j for j in left if j not in group and (fps[i] ^ fps[j]).bit_count() <= 3 and j not in front]
        left = [i for i in left if i not in group]
        groups.append(group)
    heads = {min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups}
    kept = [r["source"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == sorted(f"s{i}" for i in heads)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_ann_recall_and_pairs_scored(spark, clustered):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12_000, 64))  # three blocks
    if clustered:
        x = 0.35 * x + rng.normal(size=(300, 64))[rng.integers(0, 300, len(x))]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    asked = range(0, len(x), 100)
    got = defaultdict(set)
    for r in ann.search(rows, rows.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {i: set(np.argsort(-np.where(np.arange(len(x)) == i, -9, u @ u[i]))[: ann.TOP].tolist()) for i in asked}
    recall = np.mean([len(got[i] & exact[i]) / ann.TOP for i in asked])
    assert recall >= 0.95, recall
    # Footrule leaves few rows to be scored: about KEPT without structure, fewer in clusters.
    perms = ann.permutations(x, u[:256], ann.ORDER)
    files, sample = ann.Files(perms, 256), ann.Files(perms[: ann.SAMPLE], 256)
    scored = np.mean([len(ann.selected(files, perms[i], ann.least_nearness(sample.nearness(perms[i])), ann.TOP)) for i in asked]) / len(x)
    assert scored <= (0.02 if clustered else 0.115), scored
    places = np.full((2, 256), ann.ORDER)
    for i in (0, 1):
        places[i, perms[i]] = np.arange(ann.ORDER)
    assert np.abs(places[0] - places[1]).sum() == ann.ORDER * (ann.ORDER + 1) - 2 * files.nearness(perms[0])[1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_recall_at_every_size(spark, sf):
    """One rule, no switch: every tenth vector asks."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = defaultdict(set)
    for r in ann.search(rows, rows.where("vec_id % 10 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    pdf = rows.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 10 == 0)
    recall = np.mean([len(got[ids[i]] & set(ids[np.argsort(-np.where(np.arange(len(x)) == i, -9, u @ u[i]))[: ann.TOP]].tolist())) / ann.TOP for i in asked])
    assert recall >= 0.9, recall


def test_ann_queries_meet_few_blocks_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 256)
    rng = np.random.default_rng(4)
    x = 0.2 * rng.normal(size=(12_000, 64)) + rng.normal(size=(300, 64))[rng.integers(0, 300, 12_000)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    _, _, dealt, _ = ann.deal(rows, rows.where("id % 20 = 0"), ann.TOP)
    groups = dealt.groupBy("block", "part").agg(F.count_if("is_query").alias("q"), F.count_if(~F.col("is_query")).alias("r")).collect()
    assert dealt.where("not is_query").select("cid").distinct().count() == 12_000  # each row lies in a block that some query meets
    assert sum(g.q + g.r for g in groups) < 600 * 12_000 / 20 / 20  # rows shuffled
    assert sum(g.q * g.r for g in groups) < 600 * 12_000 / 5 and max(g.r for g in groups) <= 2 * ann.BLOCK  # pairs ranked


def test_factors_and_their_ends_decide():
    """Without the factors nothing goes; with them, and the windows over their ends, just the windows that repeat."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, window = int(rng.integers(4, 60)), 4
        pos = np.flatnonzero(rng.random(n - window + 1) < 0.5)
        ref = np.cumsum(rng.integers(1, 3, len(pos)))
        if not len(pos):
            continue
        runs = substring_dedup.runs_of(np.zeros(len(pos), np.int64), pos, np.ones(len(pos), np.int64), ref)
        args = [runs[k] for k in ("start", "len", "ref_doc", "ref_start")]
        spans = substring_dedup.factors_of(*args, window)
        want = np.zeros(n, bool)
        for p in pos:
            want[p : p + window] = True
        for found, right in ((spans, want), ([], np.zeros(n, bool))):
            gone = substring_dedup.covered(found, n)
            substring_dedup.straddling(gone, found, args[0], args[1], window)
            assert (gone == right).all()
        assert all(a[0] + a[1] <= b[0] for a, b in itertools.pairwise(spans))


def test_result_names_that_clash(spark):
    rows = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (None, None)], "fingerprint long, text string")
    got = simhash.simhash_components(rows, "fingerprint")
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (1, 1), (3, 1)]
    assert sampled_pieces.encode_sampled(rows.withColumnRenamed("fingerprint", "rank"), "rank").columns[:2] == ["key", "rank"]


def test_frequent_anchors_are_dealt_out(spark):
    rng = np.random.default_rng(2)
    phrase = " ".join(f"licence{i}" for i in range(19))
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 15)) + f" {phrase} " + " ".join(f"w{x}" for x in rng.integers(0, 5000, 15))) for i in range(4000)], "key long, text string")
    heavy = substring_dedup.heavy_anchors(docs, 1 << 20)
    assert 0 < len(heavy) < 100

    def largest(marks):
        rows = docs.mapInPandas(substring_dedup._index(256, marks), "bucket int, blocks binary, known binary").groupBy("bucket").agg(F.sum(F.length("blocks")).alias("n")).toPandas()["n"]
        return rows.max() / rows.sum()

    assert largest([]) > 0.03 and largest(heavy) < 0.02
    got = substring_dedup.substring_dedup(docs.withColumnRenamed("key", "doc_id"), with_text=False).agg(F.sum("n_words") - F.sum("n_removed")).first()[0]
    assert got == sum(map(len, brute_substrings(docs.orderBy("key").collect())))


def test_pipeline_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, ""), stage(spark, odd.limit(0), "")
        assert none.count() == 0 and got.count() <= 18, name
        if name != "sentencepiece sampling":
            assert tuple(got.columns) == corpus_pipeline.COLUMNS
    kept = {name: stage(spark, odd, "").count() for name, stage in corpus_pipeline.STAGES[:3]}
    assert kept == {"quality rules": 4, "simhash near-dedup": 4, "substring dedup": 9}


def test_pipeline_by_brute_force(spark):
    """run() on the smallest tables: rules, links, windows and mixing done plainly, one document after the other."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()]
    ok = [i for i, t, _ in docs if (w := quality.stats_of(t))[0] >= 20 and 100 * w[4] <= 30 * w[0]]
    plain = lambda line: " ".join(line.split()).lower()
    held, hosts = Counter((s, x) for _, t, s in docs for x in {plain(x) for x in (t or "").split("\n")} if x), Counter(s for _, _, s in docs)
    often = {(s, x) for (s, x), n in held.items() if n > 10 and n > 0.01 * hosts[s]}
    left = []
    for i, t, s in docs:
        if i in ok:
            cut = "\n".join(x for x in t.split("\n") if (s, plain(x)) not in often)
            n, m = len(t.split()), len(cut.split())
            if m == n or (m >= 10 and m >= 0.3 * n):
                left.append((i, cut, s))
    fps = [simhash.fingerprint_of(t) & (2**64 - 1) for _, t, _ in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    left = [d for i, d in enumerate(left) if root[i] == i]
    kept = brute_substrings([d[:2] for d in left])
    left = [(i, t if len(k) == len(t.split()) else b" ".join(k).decode(), s) for (i, t, s), k in zip(left, kept, strict=True)]
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(left, columns=["doc_id", "text", "source"]))
    times = {i: (a is not None) + (b is not None) for i, a, b in con.execute(f"SELECT doc_id, at_first, at_second FROM ({oracle.OP8})").fetchall()}
    rows = corpus_pipeline.run(spark, DATA).where("rank = 1")
    got = sampled_pieces.decode(rows).select("doc_id", "decoded", "decoded_ok").collect()
    assert all(r.decoded_ok for r in got) and Counter(r.doc_id for r in got) == Counter({i: n for i, n in times.items() if n})
    texts = {i: t.replace("\u2581", " ") for i, t, _ in left}
    assert all(r.decoded == texts[r.doc_id] for r in got)


def test_row_keys_broadcast_no_table(spark, odd):
    """Keys of rows grow with the table, however small they are on disk."""
    assert "Broadcast" not in common.ordered_key(odd, "doc_id")._jdf.queryExecution().executedPlan().toString()

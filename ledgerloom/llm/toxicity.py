"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words counts the subsequences of three letters that they share, each
weighted down by the stretch it takes in either word, so that gaps and inserted characters
cost little. It is normalised and raised to a power, which keeps it a kernel. Landmarks are
words of the labelled texts that tell toxic from other texts. A word's value at a landmark is
the largest kernel of any part of it, wherever the part begins and ends, so that what
is glued to an insult costs nothing; a text has the values of its BEST best words there. Nyström's map makes features of the values, and a linear
SVM with squared hinge loss is trained on labelled texts and on copies of the toxic ones whose
landmarks have inserted, doubled or interleaved characters. Platt's logistic turns its decision
into a score.

A word is a run of non-space characters, of which letters and digits count; single
characters in a row with spaces between them are read as one word as well. A word is met in
other forms too: letters alone, runs of a letter as one, and without a character that fills
two fifths of it. Where a word begins is a letter of its own, to the kernel.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: At most so many labelled texts of each label are fitted on: the first by a hash of doc_id.
SAMPLE = {1: 1500, 0: 2500}
LANDMARKS = 80
#: Lengths of stems that may become landmarks, and of the longest whole word that may.
SHORTEST, STEM, LONGEST = 4, 7, 14
#: Least log-likelihood ratio of a landmark, and its least share of the largest one's.
LEAST_RATIO, LEAST_SHARE = 12.0, 0.05
#: Of how many words a text's values at a landmark are kept: a stem that clean texts have once in a while, toxic ones have in several words.
BEST = 3
#: Share of the toxic texts that have a landmark of which one word is enough, if no other text has it.
COMMON = 0.1
ORDER = 3
DECAY = 0.5
POWER = 2
LEAST = 0.2
LACKING = 7
CACHE = 300_000
#: A longer word is met in pieces of so many characters, which overlap by half: no part is longer than that.
PIECE = 64
#: Words, and starts of parts, that are held at a time.
WORDS, WINDOWS = 20_000, 4096
PENALTY = 1e-4
#: Where a word begins.
EDGE = "^"

_RUN = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens, lower-cased, of letters and digits only; spaced-out letters also joined."""
    if not text:
        return set()
    text = text.lower()
    found = set(map(clean, text.split()))
    found.update(clean(re.sub(r"\s", "", m)) for m in _SPACED.findall(text))
    return found - {""}


def clean(token: str) -> str:
    return token if token.isalnum() else "".join(filter(str.isalnum, token))


def forms(token: str) -> set[str]:
    """What a token may stand for; forms shorter than the kernel's order say nothing."""
    word = clean(token)
    found = {word}
    if len(word) > SHORTEST:
        if not word.isalpha():
            found.add("".join(filter(str.isalpha, word)))
        for w in tuple(found):
            found.add(_RUN.sub(r"\1", w))
        c = max(set(word), key=word.count)
        if 5 * word.count(c) >= 2 * len(word):
            found.add(word.replace(c, ""))
    return {EDGE + w for w in found if len(w) >= ORDER}


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points of each word in a row, zero beyond its end."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def _kept(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """Where letters of word pairs are equal, and the weights of all shorter subsequences before each pair of letters, by the kernel's recursion over prefixes."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    same = [[((s[:, i] == t[:, j]) & (s[:, i] > 0)) for j in range(b)] for i in range(a)]
    kept = np.ones((a + 1, b + 1, n), np.float32)
    for _ in range(order - 1):
        new = np.zeros_like(kept)
        for i in range(1, a + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, b + 1):
                run = decay * (run + decay * kept[i - 1, j - 1] * same[i - 1][j - 1])
                new[i, j] = decay * new[i - 1, j] + run
        kept = new
    return same, kept


def raw_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of word pairs, for all pairs at a time."""
    same, kept = _kept(s, t, order, decay)
    total = np.zeros(len(s), np.float64)
    for i in range(s.shape[1]):
        for j in range(t.shape[1]):
            total += decay * decay * kept[i, j] * same[i][j]
    return total


def prefix_kernels(s: np.ndarray, t: np.ndarray | None = None, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of each prefix of `s`, a column for its length less one, with the whole of `t`, or with itself."""
    same, kept = _kept(s, s if t is None else t, order, decay)
    gained = np.zeros((s.shape[1], len(s)), np.float64)
    for i in range(s.shape[1]):
        for j in range(s.shape[1] if t is None else t.shape[1]):
            gained[max(i, j) if t is None else i] += decay * decay * kept[i, j] * same[i][j]
    return np.cumsum(gained, axis=0).T


class Kernel:
    """Powers of the normalised kernel of landmarks with the best part of each word; zero below LEAST.

    A word has all letters of a landmark, in its order, or counts as zero; one may lack in
    landmarks of LACKING letters and more. Parts begin with the first letter (or the second,
    where one may lack), or where the word does, and are twice as long as the landmark, and two more, at most.
    """

    def __init__(self, landmarks: list[str]):
        self.words = landmarks
        if not landmarks:
            return
        self.lens = np.array([len(w) for w in landmarks])
        self.codes = codes([EDGE + w for w in landmarks], LONGEST + 1)
        self.lacking = (self.lens >= LACKING).astype(np.int64)
        self.norm = np.sqrt(raw_kernel(self.codes, self.codes))
        alphabet = sorted({ord(x) for w in landmarks for x in w})
        self.letter = np.zeros(1 << 16, np.int32)  # by the low 16 bits: rare others may be taken for a letter here, never by the kernel
        for i, x in enumerate(alphabet):
            self.letter[x & 0xFFFF] = i + 1
        # For each landmark and letter, the places where it has it.
        self.places = np.zeros((len(landmarks), len(alphabet) + 1), np.uint64)
        for m, w in enumerate(landmarks):
            for i, x in enumerate(w):
                self.places[m, self.letter[ord(x) & 0xFFFF]] |= np.uint64(1 << i)

    def shared(self, x: np.ndarray, m: int) -> np.ndarray:
        """Length of the longest common subsequence of each row of letters with a landmark, by bits."""
        row = np.full(len(x), ~np.uint64(0))
        at = self.places[m]
        for j in range(x.shape[1]):
            u = row & at[x[:, j]]
            row = (row + u) | (row - u)
        return np.bitwise_count(~row & np.uint64((1 << int(self.lens[m])) - 1)).astype(np.int64)

    def parts(self, c: np.ndarray, m: int) -> np.ndarray:
        """The best part's normalised kernel with a landmark, for rows of code points."""
        width, n = int(2 * self.lens[m] + 3), c.shape[1]
        padded = np.hstack([c, np.zeros((len(c), width), c.dtype)])
        mark = self.codes[m, : self.lens[m] + 1]
        row, start = np.nonzero(np.isin(c, mark[: 2 + self.lacking[m]]))
        best = np.zeros(len(c))
        for lo in range(0, len(row), WINDOWS):
            r, s = row[lo : lo + WINDOWS], start[lo : lo + WINDOWS]
            part = padded[r[:, None], s[:, None] + np.arange(min(width, n))]
            own = np.sqrt(np.maximum(prefix_kernels(part), 1e-30))
            v = prefix_kernels(part, np.broadcast_to(mark, (len(part), len(mark)))) / (own * self.norm[m])
            np.maximum.at(best, r, np.where(np.cumsum(part == 0, axis=1) == 0, v, 0.0).max(axis=1))
        return best

    def of_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers (ascending), landmark numbers and values: the kernel to the power."""
        by_width: dict[int, tuple[list[str], list[int]]] = {}
        for i, token in enumerate(tokens):
            for word in forms(token):
                for piece in (word,) if len(word) <= PIECE else (word[at : at + PIECE] for at in range(0, len(word) - PIECE // 2, PIECE // 2)):
                    of = by_width.setdefault(-(-len(piece) // 8) * 8, ([], []))
                    of[0].append(piece)
                    of[1].append(i)
        got: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for width, (words, owner) in by_width.items() if self.words else ():
            who = np.array(owner, np.int64)
            for lo in range(0, len(words), WORDS):
                c = codes(words[lo : lo + WORDS], width)
                x = self.letter[c & 0xFFFF]
                for m in range(len(self.words)):
                    near = np.flatnonzero(self.shared(x, m) >= self.lens[m] - self.lacking[m])
                    if len(near):
                        v = self.parts(c[near], m)
                        good = v >= LEAST
                        got.append((who[lo + near[good]], np.full(good.sum(), m), v[good] ** POWER))
        t, m, v = (np.concatenate(x) for x in zip(*got, strict=True))
        by = np.argsort(t, kind="stable")
        return t[by], m[by], v[by]

    def among(self) -> np.ndarray:
        """The landmarks' kernel matrix."""
        n, c = len(self.words), self.codes
        i, j = (x.ravel() for x in np.indices((n, n)))
        return ((raw_kernel(c[i], c[j]) / (self.norm[i] * self.norm[j])) ** POWER).reshape(n, n)


class Features:
    """Values of whole texts at the landmarks, words computed once."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.cache: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(self, texts: list[set[str]]) -> None:
        """Words that reach no landmark are held as well, without a row."""
        if len(self.cache) > CACHE:
            self.cache, self.rows = {}, []
        new = list(set().union(*texts).difference(self.cache))
        self.cache.update(dict.fromkeys(new, -1))
        t, m, v = self.kernel.of_tokens(new)
        edges = np.flatnonzero(np.diff(t, prepend=-1))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(t)], strict=True) if len(t) else ():
            self.cache[new[t[lo]]] = len(self.rows)
            self.rows.append((m[lo:hi], v[lo:hi]))

    def of(self, tokens: set[str]) -> np.ndarray:
        """The BEST largest values at each landmark, of as many distinct words: all largest first, then all second ones, and so on."""
        x = np.zeros((BEST, len(self.kernel.words)))
        found = [self.rows[i] for i in map(self.cache.__getitem__, tokens) if i >= 0]
        if found:
            m, v = np.concatenate([m for m, _ in found]), np.concatenate([v for _, v in found])
            by = np.lexsort((-v, m))
            m, v = m[by], v[by]
            place = np.arange(len(m)) - np.searchsorted(m, m)
            x[place[place < BEST], m[place < BEST]] = v[place < BEST]
        return x.ravel()


def landmark_words(texts: list[set[str]], labels: np.ndarray, n: int = LANDMARKS) -> list[str]:
    """Words and stems (beginnings of words) that most raise the odds of the toxic label, by the likelihood ratio of their presence.

    Of words that begin alike the best one stands for all, as the kernel finds it in the others.
    """
    n1, n0 = int(labels.sum()), int((labels == 0).sum())
    scored = set()
    for m in (*range(SHORTEST, STEM + 1), 0):  # beginnings of each length, then whole words: one kind is held at a time
        kinds = lambda found, m=m: {c[:m] if m else c for c in map(clean, found) if len(c) >= SHORTEST and (m or len(c) <= LONGEST)}
        toxic = Counter(w for found, y in zip(texts, labels, strict=True) if y for w in kinds(found))
        toxic = {w: a for w, a in toxic.items() if a >= 2}
        other = Counter(w for found, y in zip(texts, labels, strict=True) if not y for w in kinds(found) & toxic.keys())
        for w, a in toxic.items():
            b = other[w]
            if a / n1 <= b / max(n0, 1):
                continue
            p = (a + b) / (n1 + n0)
            ll = 0.0
            for x, of in ((a, n1), (b, n0)):
                q = x / of if of else 0.0
                ll += (x * math.log(q / p) if x else 0.0) + ((of - x) * math.log((1 - q) / (1 - p)) if of > x else 0.0)
            if ll > LEAST_RATIO:
                scored.add((-round(ll, 6), -len(w), w))
    chosen: list[str] = []
    for ll, _, w in sorted(scored):
        if len(chosen) < n and ll <= LEAST_SHARE * min(scored)[0] and not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    return chosen


def changed(tokens: set[str], marks: list[str], how: int, at: int) -> set[str]:
    """Copies of a text's tokens whose landmarks have a character put in, doubled, or between all letters; `at` says which and where."""
    filler = "xzqj10"[at % 6]
    found = set()
    for t in tokens:
        w = clean(t)
        mark = next((m for m in marks if w.startswith(m)), None)
        if mark:
            i = 1 + at % (len(mark) - 1)
            t = (w[:i] + filler + w[i:], w[:i] + w[i - 1] + w[i:], filler.join(w))[how]
        found.add(t)
    return found


def thinned(tokens: set[str], marks: list[str], pure: set[str], at: int) -> set[str]:
    """Copies of a text's tokens with one word only of those that begin with a landmark: one that begins with a landmark no other text has, `at` says which."""
    marked = sorted(t for t in tokens if any(t.startswith(m) for m in marks))
    alone = [t for t in marked if any(t.startswith(m) for m in pure)]
    return tokens.difference(marked) | {alone[at % len(alone)]} if alone else tokens


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM, squared hinge, classes balanced, by Newton's method on the active rows."""
    s = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-9])
    before = None
    for _ in range(steps):
        active = s * (z @ w) < 1
        if before is not None and (active == before).all():
            break
        before = active
        za, wa = z[active], weight[active][:, None]
        w = np.linalg.solve(ridge + za.T @ (wa * za), za.T @ (wa[:, 0] * s[active]))
    return w[:-1], float(w[-1])


def platt(d: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Logistic from decisions to probabilities, with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        g = np.array([(d * (p - t)).sum(), (p - t).sum()])
        r = p * (1 - p)
        h = np.array([[(d * d * r).sum() + 1e-6, (d * r).sum()], [(d * r).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    """Landmarks and one weight for each, the Nyström map folded in."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.held: Features | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None}

    def features(self) -> Features:
        """Made once in each worker."""
        self.held = self.held or Features(Kernel(self.landmarks))
        return self.held

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -500, 500))))


def train(rows: list[tuple[str | None, int]]) -> Model:
    """Fit on (text, label). Without both labels, or without words that tell them apart, the score is constant."""
    texts = [set(map(sys.intern, tokens_of(t))) for t, _ in rows]
    y = np.array([label for _, label in rows])
    marks = landmark_words(texts, y) if len(set(y.tolist())) == 2 else []
    if not marks:
        share = (y.sum() + 0.5) / (len(y) + 2.0)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    copies = [changed(t, marks, i % 3, i // 3) for i, (t, label) in enumerate(zip(texts, y, strict=True)) if label]
    # One insult is enough where no other text has it and many toxic ones do.
    toxic = [t for t, label in zip(texts, y, strict=True) if label]
    other = set().union(*[t for t, label in zip(texts, y, strict=True) if not label])
    pure = {m for m in marks if not any(w.startswith(m) for w in other) and sum(any(w.startswith(m) for w in t) for t in toxic) >= COMMON * len(toxic)}
    copies += [thinned(t, marks, pure, i) for i, t in enumerate(toxic)]
    copies = [c for c, t in zip(copies, toxic + toxic, strict=True) if c != t]
    texts, y = texts + copies, np.concatenate([y, np.ones(len(copies), y.dtype)])
    kernel = Kernel(marks)
    features = Features(kernel)
    f = np.zeros((len(texts), BEST * len(marks)))
    for lo in range(0, len(texts), 256):
        features.learn(texts[lo : lo + 256])
        f[lo : lo + 256] = [features.of(t) for t in texts[lo : lo + 256]]
    values, vectors = np.linalg.eigh(kernel.among())
    good = values > 1e-6 * values.max()
    nystrom = np.kron(np.eye(BEST), vectors[:, good] / np.sqrt(values[good]))  # one map for the first words, the second ones, and so on
    x = f @ nystrom
    w, b = fit_svm(x, y)
    a, c = platt(x @ w + b, y)
    return Model(marks, a * (nystrom @ w), a * b + c)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] | None = None) -> Model:
    """Train on the labelled documents, whole texts of a bounded sample of each label. Repeated labels of a document: the larger counts; null labels don't."""
    sample = sample or SAMPLE
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    marked = marked.withColumn("_h", F.xxhash64("_id"))
    ids = [r for y, n in sorted(sample.items()) for r in marked.where(F.col("_y") == y).orderBy("_h", "_id").limit(n).collect()]
    if not ids:
        return train([])
    few = docs.sparkSession.createDataFrame([(r["_id"], r["_y"]) for r in ids], "_id long, _y int")
    rows = docs.join(F.broadcast(few), docs[id_col] == few["_id"]).select("_id", text_col, "_y").collect()  # bounded by the sample
    return train([(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1] or ""))])


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with `score` in [0, 1] and `predicted` (1 from a half on); columns of these names are replaced.

    Null texts score as empty ones, each row by itself and whole: ties and repeated rows score
    alike. An empty table gives no rows. Extra columns pass through, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> list[tuple[float, int]]:
        m = sent.value
        features = m.features()
        found = [tokens_of(t) for t in texts]
        features.learn(found)
        scores = [m.score(features.of(t)) for t in found]
        return [(s, int(s >= 0.5)) for s in scores]

    passed = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    rows = docs.select(F.struct(*passed).alias("doc") if passed else F.lit(0).alias("doc"), F.col(text_col).alias("text"))
    scored = per_text(rows, score, "score double, predicted int", chunk=256)
    return scored.select(*[F.col("doc")[c].alias(c) for c in passed], "score", "predicted")

"""Periodic runs of words, by block matching at scales of powers of two.

A run of period q is at least 4 q words long, so it holds a block of L words that begins at a multiple
of L together with its copy q words on, L being the power of two with 2 L <= 3 q + 1 < 4 L. At each scale
the blocks are keys of an Aho-Corasick automaton over sequences of integers, which finds where they
occur in the document; an occurrence at a distance that fits the scale is a seed. Seeds are extended
exactly, both ways, as far as words q apart agree.

Scales and periods go upwards, so a run with a smaller period is known when a multiple of it comes
up, and a seed within it (the two periods meet over more words than both together) is passed over.
Where no word recurs within a scale's distances there can be no run, so only stretches whose words
all do are searched, in windows: memory stays in proportion to the document.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import per_text, words_of

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Symbols of a key, at most.
KEY = 8
#: Words that one automaton's blocks cover, and seeds compared at a time.
WINDOW, AT_ONCE = 1 << 16, 1 << 20
FIELDS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _agree(codes: np.ndarray, at: int, q: int, step: int) -> int:
    """For how many places from `at` on, in the direction of `step`, words q apart agree: found in pieces of doubling size."""
    left, done, size = (len(codes) - q - at, 0, 32) if step > 0 else (at + 1, 0, 32)
    while done < left:
        m = min(size, left - done)
        lo = at + done if step > 0 else at - done - m + 1
        differ = np.flatnonzero(codes[lo : lo + m] != codes[lo + q : lo + q + m])
        if len(differ):
            return done + int(differ[0] if step > 0 else m - 1 - differ[-1])
        done, size = done + m, size * 2
    return done


def _recurrence(codes: np.ndarray) -> np.ndarray:
    """Distance from each place to the nearest other one with the same word."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    gap = np.where(same, np.diff(order), n)
    near = np.full(n, n, dtype=np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    return near


def _stretches(near: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Stretches of words that recur within `hi`, long enough for a run of period `lo`."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (near <= hi).astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= max(LEAST_WORDS, LEAST_PERIODS * lo):
            yield int(a), int(b)


def _named(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers for the sequences of some width at each place, equal ones alike, and that width: blocks of `size` are KEY of them at most."""
    names, width = np.unique(codes, return_inverse=True)[1], 1
    while width * KEY < size:
        names = np.unique(names[:-width] * (int(names.max()) + 1) + names[width:], return_inverse=True)[1]
        width *= 2
    return names, width


def _digits(names: np.ndarray, base: int) -> list[int]:
    """Two digits for each name, each kind with values of its own: no node has more children than the root of the number of names."""
    return np.stack([names // base, base + 1 + names % base], axis=-1).ravel().tolist()


def _seeds(codes: np.ndarray, size: int, lo: int, hi: int, start: int, end: int) -> Iterator[np.ndarray]:
    """(period, place) of blocks of `size` words in [start, end) that occur again `lo` to `hi` words on; ordered within a window.

    The document is searched as sequences of names, one for each remainder of the place by a name's width. A failing match goes
    back through its key one state at a time, so short keys keep the search linear in texts that repeat themselves.
    """
    step = max(WINDOW, 4 * size)
    for first in range(-(-start // size) * size, end - size + 1, step):
        blocks = np.arange(0, min(step, end - size + 1 - first), size)
        names, width = _named(codes[first : min(first + int(blocks[-1]) + size + hi, end)], size)
        places = np.argsort(np.arange(len(names)) % width, kind="stable")
        base, parts = math.isqrt(int(names.max())) + 1, size // width
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        number = np.empty(len(blocks), dtype=np.int64)
        keys = _digits(names[blocks[:, None] + np.arange(parts) * width], base)
        for i in range(len(blocks)):
            key = tuple(keys[2 * parts * i : 2 * parts * (i + 1)])
            number[i] = automaton.get(key, len(automaton))
            automaton.add_word(key, int(number[i]))
        automaton.make_automaton()
        hits = np.array([(at // 2, which) for at, which in automaton.iter(tuple(_digits(names[places], base)))], dtype=np.int64).reshape(-1, 2)
        begun = places[hits[:, 0] - parts + 1]
        whole = places[hits[:, 0]] - begun == (parts - 1) * width  # not over the end of a sequence
        found = np.full(len(names) + hi + size, -1, dtype=np.int64)
        found[begun[whole]] = hits[whole, 1]
        periods, pairs = np.arange(lo, hi + 1), []
        rows = max(1, AT_ONCE // len(periods))
        for i in range(0, len(blocks), rows):
            which, p = np.nonzero(found[blocks[i : i + rows, None] + periods] == number[i : i + rows, None])
            pairs.append(np.stack([periods[p], first + blocks[i : i + rows][which]], axis=1))
        seeds = np.concatenate(pairs)
        yield seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, number = len(words), {}
    if n < LEAST_WORDS:
        return []
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    near = _recurrence(codes)
    known: set[tuple[int, int]] = set()
    out: list[tuple[int, int, int]] = []
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    size = 2
    while LEAST_PERIODS * (lo := -(-(2 * size - 1) // 3)) <= n:
        hi, starts, ends, periods = (4 * size - 2) // 3, [], [], []
        for a, b in _stretches(near, lo, hi):
            for seeds in _seeds(codes, size, lo, hi, a, b):
                for s, e in levels:  # of a level's runs none holds another, so the last to begin is the last to end
                    at = np.searchsorted(s, seeds[:, 1], side="right") - 1
                    seeds = seeds[(at < 0) | (e[at] < seeds[:, 1] + seeds[:, 0] + size)]
                for q, place in seeds.tolist():
                    at = bisect.bisect_right(starts, place) - 1
                    if at >= 0 and ends[at] >= place + q + size and q % periods[at] == 0:
                        continue
                    right = place + q + _agree(codes, place, q, 1)
                    left = place - _agree(codes, place - 1, q, -1) if place else 0
                    if right - left < max(LEAST_WORDS, LEAST_PERIODS * q) or (left, right) in known:
                        continue
                    known.add((left, right))
                    out.append((left, right - left, q))
                    at = bisect.bisect_right(starts, left)
                    starts.insert(at, left)
                    ends.insert(at, right)
                    periods.insert(at, q)
        if starts:
            levels.append((np.array(starts), np.array(ends)))
        size *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run the first period stays, unless another run repeats it."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def _described(text: str | None) -> tuple:
    words = words_of(text)
    runs = runs_of(words)
    kept = b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")
    return len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], kept


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, runs (start, length, period; by start, then period) and collapsed, the kept words joined by spaces, in place of `text`.

    Words are numbered from 0. Texts are searched whole. Null and empty texts have no words, no runs and an empty
    `collapsed`; repeated rows stay, an empty table gives an empty one. Other columns pass; those with the names of
    results are replaced.
    """
    return per_text(docs.drop(*[c for c in ("n_words", "runs", "collapsed") if c != text]), _described, FIELDS, text)

"""Byte-pair encoding by backtracking, and decoding by an offset table.

A word's pieces are found from left to right. One pass of an Aho-Corasick automaton over all
tokens gives the longest token at each place; a token is taken if its boundary to the token
before it is one that merging would have left, which a table of pairs says, and if the place it
ends at isn't known to be a dead end. If not, the next shorter token that is its prefix is
tried, and where there is none the token before is given up and its place marked. A boundary
decides by itself whether merging leaves it, and the result of merging is unique, so the one
way through is what the merges, applied in order of rank, give. No place is left twice: the
time is linear in the word.

Texts are cut at white space, which no token crosses, and pieces that recur are looked up.
Normal form, lower case and the cut into words are the tokenizer file's own.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Pieces between white space (Unicode's White_Space property).
_PIECE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Recurring pieces and pairs that a worker keeps, at most; the tables are emptied when full.
PIECES, PAIRS, PIECE_CHARS = 1 << 18, 1 << 20, 64
#: Below this character normal form C changes nothing, lower case goes by character, and classes are the same in all libraries.
LATIN_END = "\u0250"
#: Ids decoded at a time.
DECODED = 1 << 18


class Vocabulary:
    """A BPE model with word ends: tokens, the merge that made each, and the automaton over those that merging can give.

    The file's ids must follow its merges, as those of trained vocabularies do; anything else is an error.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        given = json.loads(text)
        model, added = given["model"], given["added_tokens"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in added}
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError(f"not a plain BPE vocabulary: {path}")
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.first = len(ids) - len(pairs)  # ids below are symbols
        self.halves = [(-1, -1)] * self.first + [(ids[a], ids[b]) for a, b in pairs]
        self.made = {pair: self.first + i for i, pair in enumerate(self.halves[self.first :])}
        if any(ids.get(a + b) != self.first + i or max(ids[a], ids[b]) >= self.first + i for i, (a, b) in enumerate(pairs)):
            raise ValueError(f"ids don't follow the merges: {path}")
        names = sorted(ids, key=ids.__getitem__)
        # A symbol is one character; one at a word's end is another.
        bare = lambda name: name[: -len(self.end)] if self.end and name.endswith(self.end) else name
        self.inside = {ord(names[i]): chr(i) for i in range(self.first) if bare(names[i]) == names[i]}
        self.last = {bare(names[i]): chr(i) for i in range(self.first) if bare(names[i]) != names[i]} if self.end else {chr(c): s for c, s in self.inside.items()}
        said = [chr(i) for i in range(self.first)]
        for a, b in self.halves[self.first :]:
            said.append(said[a] + said[b])
        self.size = [len(s) for s in said]
        #: The pair table, filled as pairs are met.
        self.table: dict[tuple[int, int], bool] = {}
        self.reachable = self._reachable()
        places = {s: i for i, s in enumerate(said) if self.reachable[i]}
        # Of each token, the longest shorter one that it begins with.
        self.shorter = [next((places[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in places), -1) for s in said]
        self.automaton = ahocorasick.Automaton()
        for s, i in places.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.pool, self.offsets = self._offset_table(names)
        self.text = text

    def _offset_table(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes, each with a space after it, in a row, and where each begins; a number without a token is empty."""
        at = dict(enumerate(names)) | {i: s for s, i in self.special.items()}
        each = [at[i].encode() + b" " if i in at else b"" for i in range(max(at) + 1)]
        return np.frombuffer(b"".join(each), dtype=np.uint8), np.cumsum([0, *map(len, each)])

    def _reachable(self) -> list[bool]:
        """Tokens that merging their own symbols gives: their last merge comes first of all that cross its boundary."""
        good = [True] * len(self.halves)
        for i in range(self.first, len(self.halves)):
            a, b = self.halves[i]
            good[i] = good[a] and good[b] and not self._crossed(a, b, i)
        return good

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge older than `before` joins what stands on both sides of a boundary while merges build the two tokens.

        On either side stands one of the parts that make up the token at the boundary, from the time that it is made until
        it goes into the next larger part. Of equal merges the one to the left comes first: a part on the left side that goes
        into a larger one at the same time is gone before, one on the right side is still there.
        """
        part, gone = left, before
        while part >= 0:
            other, other_gone = right, before
            while other >= 0:
                merge = self.made.get((part, other), before)
                if merge < gone and merge <= other_gone:
                    return True
                other, other_gone = self.halves[other][0], other
            part, gone = self.halves[part][1], part
        return False

    def encode_word(self, symbols: str) -> list[int]:
        """Ids of one word, given as symbols."""
        size, shorter, table = self.size, self.shorter, self.table
        longest, out, at, n = [-1] * len(symbols), [], 0, len(symbols)
        for end, token in self.automaton.iter(symbols):
            longest[end + 1 - size[token]] = token  # later ends are longer
        if n and size[longest[0]] == n:
            return [longest[0]]
        dead = bytearray(n + 1)
        token, before = longest[0] if n else -1, -1
        while at < n:
            while token >= 0:
                if not dead[at + size[token]]:
                    if before < 0:
                        break
                    fits = table.get((before, token))
                    if fits is None:
                        fits = self._look(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                before, token = token, longest[at] if at < n else -1
            else:  # every way on from here was tried
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
        return out

    def _look(self, a: int, b: int) -> bool:
        """Whether merging leaves a boundary between two tokens, into the pair table."""
        if len(self.table) >= PAIRS:
            self.table.clear()
        self.table[a, b] = found = not self._crossed(a, b, len(self.halves))
        return found


def _byte_names() -> list[str]:
    """The character that stands for each byte: visible Latin-1 ones are their own, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers, with tables of recurring pieces and words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        rules = Tokenizer.from_str(vocabulary.text)
        self.plain, self.cut = rules.normalizer, rules.pre_tokenizer
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        given = json.loads(vocabulary.text)
        patterns = [p["pattern"]["Regex"] for p in given["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        kinds = [n["type"] for n in (given["normalizer"] or {}).get("normalizers", [])]
        # For Latin letters the file's steps are these; for others the library takes them.
        self.pattern = regex.compile(patterns[0]) if len(patterns) == 1 and kinds == ["NFC", "Replace", "Lowercase"] else None
        self.names = {b: name for b, name in enumerate(_byte_names())}

    def __call__(self, text: str | None) -> bytes:
        known, parts = self.pieces, []
        for piece in _PIECE.findall(text or ""):
            found = known.get(piece)
            parts.append(self._piece(piece) if found is None else found)
        return b"".join(parts)

    def _piece(self, piece: str) -> bytes:
        if self.marks is None:
            found = self._words(piece)
        else:
            found = b"".join([_pack([self.vocabulary.special[p]]) if p in self.vocabulary.special else self._words(p) for p in self.marks.split(piece) if p])
        return _remember(self.pieces, piece, found)

    def _words(self, piece: str) -> bytes:
        if self.pattern is not None and (piece.isascii() or max(piece) < LATIN_END):
            words = [w.encode().decode("latin-1").translate(self.names) for w in self.pattern.findall(piece.lower())]
        else:
            words = [w for w, _ in self.cut.pre_tokenize_str(self.plain.normalize_str(piece) if self.plain else piece)]
        known = self.words
        return b"".join([known.get(w) or self._word(w) for w in words])

    def _word(self, word: str) -> bytes:
        v = self.vocabulary
        return _remember(self.words, word, _pack(v.encode_word(word[:-1].translate(v.inside) + v.last[word[-1]])))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _remember(table: dict[str, bytes], key: str, value: bytes) -> bytes:
    if len(key) <= PIECE_CHARS:
        if len(table) >= PIECES:
            table.clear()
        table[key] = value
    return value


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    return Encoder(load(path))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def decode_ids(vocabulary: Vocabulary, packed: bytes | None) -> str:
    """Tokens joined by one space, cut out of the offset table."""
    ids, parts = np.frombuffer(packed or b"", dtype="<u4").astype(np.int64), []
    for i in range(0, len(ids), DECODED):
        starts = vocabulary.offsets[ids[i : i + DECODED]]
        sizes = vocabulary.offsets[ids[i : i + DECODED] + 1] - starts
        ends = np.cumsum(sizes)
        parts.append(vocabulary.pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
    return b"".join(parts)[:-1].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `ids`, the text's tokens as little-endian unsigned 32-bit integers, in place of `text`.

    Null and empty texts, and texts of white space, have none; texts are encoded whole. Other columns pass; a column that is
    called `ids` already is replaced. Repeated rows stay, an empty table gives an empty one.
    """
    rest = docs.drop("ids") if text != "ids" else docs
    return per_text(rest, lambda t: (encoder(path)(t),), "ids binary", text)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `text`, its tokens as text joined by single spaces, in place of `ids`; null ids give the empty text."""
    rest = encoded.drop("text") if ids != "text" else encoded
    return per_text(rest, lambda packed: (decode_ids(load(path), packed),), "text string", ids)


def n_tokens(ids: Column) -> Column:
    return F.floor(F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")

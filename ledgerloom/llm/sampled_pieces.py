"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's lattice is the chain of the lattices of its words (no piece crosses a word's start),
whose edges are the pieces of the model. A segmentation has the probability of its pieces'
weights, normalised over the lattice. The k distinct segmentations of a text are the k with
the largest Gumbel-perturbed log-probabilities, found best first: a node is a set of
segmentations that share a path of edges, its bound the perturbed maximum of the set; taking
the best node gives its best member, and divides the rest of it at every later edge of that
member's path into nodes with smaller bounds.

Forward sums and edges are computed once for each distinct word of some documents, for all
words at a time. Random numbers are hashes of (row key, sample, word, step), so a row gets
the same samples wherever and however often it is processed.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SAMPLES = 2
SEED = 42
#: Characters whose lattices are held at a time.
CHUNK = 400_000
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_SLOTS = 1 << 20
# Streams of random numbers apart from those of the edges.
_ROOT, _DIVIDE, _TURN = 1 << 60, 1 << 61, 1 << 62


class Pieces:
    """What sampling needs of a model: a character trie of its pieces in a hash table, weights, bytes."""

    def __init__(self, model: bytes, temperature: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.text = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[self.text[i][0]] = i
        # A merge's score is its rank with a minus; frequencies fall about as one over the rank.
        self.log_weight = np.array([-math.log(10.0 + abs(sp.get_score(i))) if abs(sp.get_score(i)) < 1e8 else -math.log(2.0 * n) for i in range(n)]) * temperature
        node_of: dict[tuple[int, int], int] = {}
        ends = [-1]
        self.longest = 1
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            at, piece = 0, sp.id_to_piece(i)
            self.longest = max(self.longest, len(piece))
            for c in piece:
                at = node_of.setdefault((at, ord(c)), len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        self.ends = np.array(ends, np.int32)
        self.keys, self.nodes = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int32)
        for (at, c), node in node_of.items():
            key = at << 21 | c
            slot = self._slot(np.int64(key))
            while self.keys[slot] >= 0:
                slot = (slot + 1) % _SLOTS
            self.keys[slot], self.nodes[slot] = key, node

    @staticmethod
    def _slot(key):
        with np.errstate(over="ignore"):
            return (np.asarray(key).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's next nodes; 0 where there is none."""
        key = node.astype(np.int64) << 21 | char
        slot, out = self._slot(key), np.zeros(len(key), np.int32)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
            slot[left] = (slot[left] + 1) % _SLOTS
        return out

    def decode(self, ids) -> str:
        """The text of a segmentation: pieces joined, spaces for their mark, without the one put first."""
        return b"".join(map(self.text.__getitem__, ids)).replace(SPACE.encode(), b" ")[1:].decode("utf-8", "replace")


class Lattices:
    """Lattices of distinct words. Cell `first[w] + t` is the place after t characters of word w.

    cum[cell, l - 1]: cumulative probabilities of the last edge's length being up to l, given
    that a segmentation passes the cell; piece[cell, l - 1]: that edge's piece, or -1, or for
    a character beyond ASCII that no piece has, -2 minus its code point (its UTF-8 bytes are
    emitted).
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        self.len = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.len + 1) - self.len - 1
        cells = int((self.len + 1).sum())
        chars = np.zeros(cells, np.int64)  # the character that ends at a cell
        at = np.ones(cells, bool)
        at[self.first] = False
        chars[at] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.arange(cells)
        last = np.repeat(self.first + self.len, self.len + 1)
        starts = starts[starts < last]
        node = np.zeros(len(starts), np.int32)
        for length in range(1, pieces.longest + 1):
            ok = starts + length <= last[starts]
            starts, node = starts[ok], node[ok]
            node = pieces.step(node, chars[starts + length])
            alive = node > 0
            starts, node = starts[alive], node[alive]
            if not len(starts):
                break
            ends = pieces.ends[node]
            edges.append((starts[ends >= 0] + length, ends[ends >= 0]))
        self.width = max(len(edges), 1)
        self.piece = np.full((cells, self.width), -1, np.int32)
        for i, (cell, piece) in enumerate(edges):
            self.piece[cell, i] = piece
        alone = at & (self.piece[:, 0] < 0)
        self.piece[alone, 0] = np.where(chars[alone] < 128, pieces.byte_ids[chars[alone] & 127], -2)
        log_weight = np.append(pieces.log_weight, [-40.0, -np.inf])  # [-2]: by bytes, [-1]: no edge
        # Probabilities of short words can't underflow; those of longer ones are summed as logs.
        short = int(600 // -log_weight[:-1].min())
        self.cum = np.ones((cells, self.width))
        self._forward(np.flatnonzero(self.len <= short), np.exp(log_weight), False)
        self._forward(np.flatnonzero(self.len > short), log_weight, True)
        spelt = np.flatnonzero(self.piece[:, 0] == -2)
        self.piece[spelt, 0] = -2 - chars[spelt]

    def _forward(self, words: np.ndarray, weight: np.ndarray, logs: bool) -> None:
        """Fill `cum` for some words; `weight` (log weight, with `logs`) holds what each piece weighs."""
        alpha = np.full(len(self.cum), 0.0 if logs else 1.0)
        by = words[np.argsort(-self.len[words], kind="stable")]
        ordered = self.len[by]
        back = np.arange(1, self.width + 1)
        for t in range(1, int(ordered.max(initial=0)) + 1):
            cell = self.first[by[: np.searchsorted(-ordered, -t, side="right")]] + t
            w = min(t, self.width)
            c = weight.take(self.piece.take(cell, axis=0)[:, :w])
            before = alpha.take(cell[:, None] - back[:w])
            if logs:
                c += before
                top = c.max(axis=1, keepdims=True)
                p = np.cumsum(np.exp(c - top), axis=1)
                alpha[cell] = top[:, 0] + np.log(p[:, -1])
            else:
                c *= before
                p = np.cumsum(c, axis=1)
                alpha[cell] = p[:, -1]
            self.cum[cell, :w] = p / p[:, -1:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(key: np.ndarray, a: np.ndarray | int) -> np.ndarray:
    """The start of a stream of random numbers."""
    with np.errstate(over="ignore"):
        return _mix(np.asarray(key, np.uint64) + np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def uniforms(key: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1), a function of their arguments alone."""
    return drawn_from(stream(key, a), b)


def drawn_from(start: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = _mix(start + np.asarray(b, np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


class Paths:
    """Edges of some tokens, token by token, each from the word's end to its start: cell, length, probability."""

    def __init__(self, n_steps: np.ndarray, cell: np.ndarray, length: np.ndarray, p: np.ndarray):
        self.n_steps, self.cell, self.length, self.p = n_steps, cell, length, p
        self.logs = p


def sample(lat: Lattices, word: np.ndarray, cell: np.ndarray, key: np.ndarray, sample_no: int, token: np.ndarray) -> Paths:
    """Draw edges backwards from a cell of each word to its start."""
    active = np.flatnonzero(cell > lat.first[word])
    steps = []
    n_steps = np.zeros(len(word), np.int64)
    start, first = stream(key, token.astype(np.int64) * 4096 + sample_no)[active], lat.first[word[active]]
    at = cell[active]
    while len(active):
        cum = lat.cum.take(at, axis=0)
        u = drawn_from(start, at - first)
        below = cum < u[:, None]
        k = np.minimum(np.einsum("ij->i", below.view(np.int8)).astype(np.int64) if lat.width < 128 else below.sum(axis=1), lat.width - 1)
        flat, place = cum.ravel(), np.arange(0, cum.size, lat.width) + k
        p = flat[place] - np.where(k > 0, flat[place - 1], 0.0)
        steps.append((active, at, k + 1, p))
        n_steps[active] += 1
        at = at - (k + 1)
        left = np.flatnonzero(at > first)
        active, at, start, first = active[left], at[left], start[left], first[left]
    offset = np.cumsum(n_steps) - n_steps
    total = int(n_steps.sum())
    out_cell, out_len, out_p = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
    for i, (tok, at, length, p) in enumerate(steps):
        to = offset[tok] + i
        out_cell[to], out_len[to], out_p[to] = at, length, p
    return Paths(n_steps, out_cell, out_len, out_p)


def _gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def _under(bound: float, g: np.ndarray) -> np.ndarray:
    """Gumbel variables, truncated at a bound."""
    top = np.maximum(-bound, -g)
    return -(top + np.log(np.exp(-bound - top) + np.exp(-g - top)))


class Search:
    """The best-first search for one text."""

    def __init__(self, key: int, words: np.ndarray, k: int):
        self.key, self.words, self.k = key, words, k
        self.queue: list[tuple[float, int, int, int, tuple[int, ...]]] = []
        self.found: list[tuple[Paths, float, float]] = []  # path, log-probability, perturbed
        self.token_of: list[np.ndarray] = []
        self.next: tuple | None = None
        self.n_nodes = 0

    def push(self, no: int, path: Paths, g: float, begin: int, excluded: tuple[int, ...], cum: np.ndarray) -> None:
        """Divide what is left of a node when its best member, sample `no`, is taken: a node for each edge from `begin` on."""
        logs = path.logs
        before = np.cumsum(logs) - logs
        gone = path.p.copy()
        if excluded:
            row = cum[path.cell[begin]]
            gone[begin] += sum(row[x - 1] - (row[x - 2] if x > 1 else 0.0) for x in excluded)
        rest = 1.0 - gone[begin:]
        open_ = np.flatnonzero(rest > 1e-12)
        if not len(open_):
            return
        at = open_ + begin
        u = uniforms(np.uint64(self.key), _DIVIDE + no, at)
        free = before[at] + np.log(rest[open_] / -np.log(u))
        # Only so many nodes as there are samples left, and one more, can be taken; truncation keeps their order.
        most = self.k + 1 - no
        top = np.argpartition(-free, most - 1)[:most] if len(free) > most else np.arange(len(free))
        top = top[np.argsort(-free[top], kind="stable")]
        for i, bound in zip(top.tolist(), _under(g, free[top]).tolist(), strict=True):
            heapq.heappush(self.queue, (-bound, self.n_nodes, no, int(at[i]), excluded if at[i] == begin else ()))
            self.n_nodes += 1


def searches(lat: Lattices, keys: list[int], tokens: list[np.ndarray], k: int) -> list[Search]:
    """k samples without replacement of each text, all texts a round at a time."""
    found = [Search(key, t, k) for key, t in zip(keys, tokens, strict=True)]
    todo: list[tuple[Search, float, int, Paths | None, int, int, tuple[int, ...]]] = []
    for s in found:  # the whole lattice is the first node
        todo.append((s, _gumbel(float(uniforms(np.uint64(s.key), _ROOT, 0))), 0, None, 0, 0, ()))
    for no in range(k):
        word, cell, key, token, joins = [], [], [], [], []
        for s, g, first, parent, at, excluded_at, excluded in todo:
            words = s.words[first:]
            cells = lat.first[words] + lat.len[words]
            edge = 0
            if parent is not None:  # another edge at the place where the node was divided off
                c = int(parent.cell[at])
                row = np.diff(lat.cum[c], prepend=0.0)
                row[[x - 1 for x in excluded]] = 0.0
                total = np.cumsum(row)
                edge = int(min(np.searchsorted(total, float(uniforms(np.uint64(s.key), _TURN + no, at)) * total[-1]), lat.width - 1))
                while row[edge] == 0.0 and edge > 0:
                    edge -= 1
                cells = cells.copy()
                cells[0] = c - edge - 1
            word.append(words)
            cell.append(cells)
            key.append(np.full(len(words), s.key, np.uint64))
            token.append(np.arange(first, first + len(words)))
            joins.append(edge)
        if not word:
            break
        drawn = sample(lat, np.concatenate(word), np.concatenate(cell), np.concatenate(key), no, np.concatenate(token))
        t0 = e0 = 0
        again = []
        for (s, g, first, parent, at, _, excluded), words, edge in zip(todo, word, joins, strict=True):
            n = drawn.n_steps[t0 : t0 + len(words)]
            e1 = e0 + int(n.sum())
            part = Paths(n, drawn.cell[e0:e1], drawn.length[e0:e1], drawn.p[e0:e1])
            t0, e0 = t0 + len(words), e1
            if parent is not None:
                c = int(parent.cell[at])
                row = lat.cum[c]
                p = row[edge] - (row[edge - 1] if edge else 0.0)
                upto = np.concatenate([parent.n_steps[:first], [0]]).sum()
                inside = at - int(upto)  # edges of the divided word before the new one
                n = n.copy()
                n[0] += inside + 1
                part = Paths(
                    np.concatenate([parent.n_steps[:first], n]), np.concatenate([parent.cell[:at], [c], part.cell]),
                    np.concatenate([parent.length[:at], [edge + 1], part.length]), np.concatenate([parent.p[:at], [p], part.p]),
                )
            part.logs = np.log(part.p)
            s.found.append((part, float(part.logs.sum()), g))
            s.push(len(s.found), part, g, at, excluded, lat.cum)
            if s.queue and len(s.found) < k:
                bound, _, of, where, gone = heapq.heappop(s.queue)
                source = s.found[of - 1][0]
                tok = int(np.searchsorted(np.cumsum(source.n_steps), where, side="right"))
                again.append((s, -bound, tok, source, where, 0, (*gone, int(source.length[where]))))
        todo = again
    return found


def ids_of(lat: Lattices, pieces: Pieces, path: Paths) -> np.ndarray:
    """Piece ids in reading order; characters without a piece by their bytes."""
    n = path.n_steps
    first = np.cumsum(n) - n
    within = np.arange(len(path.cell)) - np.repeat(first, n)
    ids = np.empty(len(path.cell), np.int32)
    ids[np.repeat(first + n - 1, n) - within] = lat.piece[path.cell, path.length - 1]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        spelt = [pieces.byte_ids[list(chr(-2 - i).encode("utf-8", "surrogatepass"))] for i in ids[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(x) for x in spelt]
        ids = np.repeat(ids, times)
        ids[ids < 0] = np.concatenate(spelt)
    return ids


def words_of(text: str) -> list[str]:
    """The words of a text, each without the space mark that it starts with."""
    if text[0] == " " or "  " in text or SPACE in text:
        return [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def key_of(row_key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}\0{row_key!r}".encode(), digest_size=8).digest(), "little")


def sampled(pieces: Pieces, row_keys: list, texts: list[str | None], k: int, seed: int) -> list[tuple[list[np.ndarray], list[float], list[float], list[float]]]:
    """For each text: ids, log-probability, perturbed log-probability and log inclusion score of each sample, best first."""
    number: dict[str, int] = defaultdict(count().__next__)
    tokens = [np.array(list(map(number.__getitem__, words_of(t))) if t else [], np.int64) for t in texts]
    lat = Lattices(pieces, [SPACE + w for w in number])
    out = []
    for s in searches(lat, [key_of(r, seed) for r in row_keys], tokens, k):
        # The threshold: the largest perturbed log-probability not taken.
        bound = -s.queue[0][0] if s.queue else -math.inf
        score = []
        for _, log_p, _ in s.found:
            x = log_p - bound
            score.append(0.0 if x == math.inf else x if x < -30 else math.log(-math.expm1(-math.exp(x))) if x < 30 else 0.0)
        out.append(([ids_of(lat, pieces, p) for p, _, _ in s.found], [f[1] for f in s.found], [f[2] for f in s.found], score))
    return out


_HELD: dict[int, Pieces] = {}


def encode_sampled(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, model_path: str = MODEL, temperature: float = 1.0) -> DataFrame:
    """(key, rank, n_pieces, log_prob, perturbed, log_inclusion, ids, decoded_ok): k distinct sampled segmentations of each text.

    Ranks run from 1 in order of the perturbed log-probability. log_inclusion is the log of the
    probability that a segmentation is among those above the largest perturbed one not taken.
    decoded_ok: the ids decode to the text (U+2581 counts as a space, as it does to the model).
    A text with fewer than k segmentations gives them all. Null and empty texts have one, of no
    pieces. Rows with equal keys and texts get equal samples. Texts are taken whole; other columns
    are not read. A key column with the name of a result is called key in it.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(_read(spark, model_path))  # the vocabulary: of fixed size
    out = "rank int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids array<int>, decoded_ok boolean"
    plain = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    schema = T.StructType([plain.schema["key"], *T._parse_datatype_string(out)])

    def emit(keys: pa.Array, texts: list[str | None], pieces: Pieces) -> pa.RecordBatch:
        got = sampled(pieces, keys.to_pylist(), texts, k, seed)
        take, rank, ids, log_p, g, inc, ok = [], [], [], [], [], [], []
        for i, (a, b, c, d) in enumerate(got):
            text = (texts[i] or "").replace(SPACE, " ")
            for r, one in enumerate(a):
                ok.append((not text and not len(one)) or pieces.decode(one.tolist()) == text)
                rank.append(r + 1)
            take += [i] * len(a)
            ids += a
            log_p += b
            g += c
            inc += d
        sizes = np.array([len(x) for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
        arrays = [keys.take(pa.array(take, pa.int64())), pa.array(rank, pa.int32()), pa.array(sizes), *(pa.array(x, pa.float64()) for x in (log_p, g, inc)), lists, pa.array(ok, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (hash(model.value), temperature)
        pieces = _HELD.get(held) or _HELD.setdefault(held, Pieces(model.value, temperature))
        for batch in batches:
            texts, at, size = batch.column("text").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= CHUNK or i + 1 == len(texts):
                    yield emit(batch.column("key").slice(at, i + 1 - at), texts[at : i + 1], pieces)
                    at, size = i + 1, 0

    return plain.mapInArrow(run, schema).withColumnRenamed("key", "key" if key_col in schema.names[1:] else key_col)


def decode(encoded: DataFrame, ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """`encoded` with `decoded`, the text of its ids; null ids give null."""
    spark = encoded.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(_read(spark, model_path))

    @F.pandas_udf("string")
    def run(ids):
        held = (hash(model.value), 1.0)
        pieces = _HELD.get(held) or _HELD.setdefault(held, Pieces(model.value))
        return ids.map(lambda x: None if x is None else pieces.decode(list(x)))

    return encoded.withColumn("decoded", run(F.col(ids_col)))


def _read(spark, path: str) -> bytes:
    """A small file by Spark's reader, so that any store will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])

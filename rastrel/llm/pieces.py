"""SentencePiece encoding and decoding (operator 9): a max-plus scan over the lattice of pieces.

A text is cut into pieces along a best path. A state is the piece that ends at, or reaches across, a
place; going from one piece to the next has a weight, and weights add up along a path: max-plus algebra.

* Unigram models: the weight is the score of the next piece.
* BPE models (such as the public one): the weight is 0 if the merges leave the two pieces as they are
  when they stand side by side, else minus infinity. A sequence of pieces is what the merges make of a
  text exactly if that holds for all its neighbours, so the best path is the encoding of the library.

A giant text is split into chunks at fixed places. A chunk yields the matrix of best weights from every
state at its left edge to every state at its right edge. Matrices of a text are combined associatively
(prefix products), which tells the state at every edge; then each chunk is traced back by itself.
Pieces never reach across the start of a word, so there all states are one; words between the first and
last such start of a chunk are looked up in a bounded table of words met before.

Nulls: a null text has no pieces and decodes to the empty text. Characters without a piece become bytes,
or the unknown id where the model has no byte pieces. Repeated rows are encoded again; a null doc_id is
allowed. The model writes a space as U+2581, so that character itself decodes to a space and such a text is
no round trip. Other columns are ignored. Models with a normalizer of their own
(other than "identity") are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B

SPACE = "▁"
GIANT, CHUNK, KEPT, TOGETHER = 1 << 16, 1 << 14, 300_000, 64
NONE = float("-inf")


PART, UNSEEN, PIECE = 0, 1, 2


def starts(pieces: Iterable[str], bpe: bool) -> dict[str, int]:
    """For all prefixes of pieces: PART, or PIECE for a piece; in a BPE model UNSEEN, as only those count that the merges make of their characters."""
    return {p[:n]: PART for p in pieces for n in range(1, len(p))} | dict.fromkeys(pieces, UNSEEN if bpe else PIECE)


class _Hash:
    """Whole numbers from 0 on, put and found by whole arrays; open addressing."""

    def __init__(self, bits: int):
        self.keys, self.values, self.shift, self.n = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that it doesn't hold."""
        at, left = self._slots(keys), np.arange(len(keys))
        self.n += len(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        out, left, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slots(keys)
        while len(left):
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


class Lattice:
    """The lattices of many words of a BPE model at once, as arrays: a trie of the pieces, and the weights between pieces as they are asked for."""

    def __init__(self, m: Model):
        self.m, self.size = m, len(m.text)
        node = {"": 0}
        for p in m.id:
            for n in range(1, len(p) + 1):
                node.setdefault(p[:n], len(node))
        step = [(node[p[:-1]] << 21 | ord(p[-1]), k) for p, k in node.items() if p]
        self.trie = _Hash(max(8, int(np.ceil(np.log2(2 * len(step) + 2)))))
        self.trie.put(*(np.array(x, np.int64) for x in zip(*step, strict=True)))
        self.piece = np.full(len(node), -1, np.int32)
        # the order in which merges come, the last merge of each piece, and whether all before it came earlier
        self.order = {p: k for k, p in enumerate(sorted(m.id, key=lambda p: (-m.rank[p], m.id[p])))}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.steady: dict[str, bool] = {}
        for p in sorted(m.id, key=len):
            if len(p) == 1:
                self.parts[p], self.steady[p] = None, True
                self.piece[node[p]] = m.id[p]
                continue
            last = m.merged(list(p), 2)
            if len(last) == 2:
                self.piece[node[p]] = m.id[p]
                self.parts[p] = (last[0], last[1])
                self.steady[p] = all(self.steady.get(x, False) and (len(x) == 1 or self.order[x] < self.order[p]) for x in last)
        self.long = np.array([len(x) for x in m.text])
        self.open = _Hash(16)
        self.alone = re.compile(f"([^{re.escape(''.join(sorted({c for p in m.id for c in p})))}]+)")

    def _open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        out = self.open.get(keys)
        new = np.unique(keys[out < 0])
        if len(new):
            if 2 * (self.open.n + len(new)) > len(self.open.keys):
                old = self.open
                self.open = _Hash(int(np.ceil(np.log2(4 * (old.n + len(new))))))
                if old.n < 4 * KEPT:
                    held = old.keys >= 0
                    self.open.put(old.keys[held], old.values[held])
            t = self.m.text
            self.open.put(new, np.array([self._apart(t[k // self.size], t[k % self.size]) for k in new.tolist()], np.int32))
            out = self.open.get(keys)
        return out > 0

    def _apart(self, a: str, b: str) -> bool:
        """``Model.open`` by the last merges of the pieces, backwards along the border.

        Two neighbours at the border join unless what either of them went into comes earlier (of equal merges the left one does).
        """
        if not (self.steady[a] and self.steady[b]):
            return self.m.open(a, b)
        order, parts, limit = self.order, self.parts, len(self.order)
        while True:
            c = order.get(a + b)
            if c is not None and c < limit:
                return False
            x, y = parts[a], parts[b]
            if x is not None and (y is None or order[a] > order[b]):
                limit, a = order[a], x[1]
            elif y is not None:
                limit, b = order[b] + 1, y[0]
            else:
                return True

    def paths(self, words: list[str]) -> list[list[int] | None]:
        """The ids along each word's one open path (see ``only_path``); None for words with characters that are no piece."""
        size = np.array([len(w) for w in words])
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        text = np.zeros((len(words), size.max()), np.int64)
        inside = np.arange(text.shape[1]) < size[:, None]
        text[inside] = cp
        ends = np.full((len(words), text.shape[1] + 1), -1, np.int32)
        whole = np.ones(len(words), bool)
        for i in range(text.shape[1]):
            who = np.flatnonzero((size > i) & (ends[:, i] >= 0 if i else whole))
            node, end = np.zeros(len(who), np.int64), i
            while len(who):
                node = self.trie.get(node << 21 | text[who, end])
                end += 1
                on = node >= 0
                p = np.where(on, self.piece[node], -1)
                if end == i + 1:
                    whole[who[p < 0]] = False
                to, b = who[p >= 0], p[p >= 0]
                if i and len(to):
                    ok = self._open(ends[to, i], b)
                    to, b = to[ok], b[ok]
                ends[to, end] = b
                on &= size[who] > end
                who, node = who[on], node[on].astype(np.int64)
        at, rows, ids = size.copy(), [], []
        who = np.flatnonzero(whole & (ends[np.arange(len(words)), size] >= 0))
        good = np.zeros(len(words), bool)
        good[who] = True
        while len(who):  # back from the ends
            b = ends[who, at[who]]
            rows.append(who)
            ids.append(b)
            at[who] -= self.long[b]
            who = who[at[who] > 0]
        row, id_ = (np.concatenate(x[::-1]) for x in (rows, ids)) if rows else (np.empty(0, np.int64),) * 2
        o = np.argsort(row, kind="stable")
        flat, cut = id_[o].tolist(), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]).tolist()
        return [flat[a:z] if ok else None for a, z, ok in zip(cut, cut[1:], good.tolist(), strict=False)]


class Model:
    """Pieces of a SentencePiece model file and the weights between them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.name not in ("identity", "") or proto.normalizer_spec.precompiled_charsmap:
            raise ValueError("this model needs a normalizer")
        kind = type(proto.pieces[0])
        self.bpe = proto.trainer_spec.model_type == 2
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        self.longest = max(map(len, self.id))
        self.low = min(self.score) - 10
        self.rank = {p: self.score[i] for p, i in self.id.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.after: dict[str, dict[str, bool]] = {}
        self.known = starts(self.id, self.bpe)
        self.words: dict[str, list[int]] = {}
        self.lattice: Lattice | None = None
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type in (kind.CONTROL, kind.UNKNOWN) else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    def merged(self, symbols: list[str], until: int = 1) -> list[str]:
        """What the merges make of symbols: the best scored pair first, from the left; until: stop at so many symbols, if they can be joined."""
        s, rank = list(symbols), self.rank.get
        gain = [rank(a + b, NONE) for a, b in zip(s, s[1:], strict=False)]
        while gain and (best := max(gain)) > NONE:
            if len(s) == until:
                return s
            k = gain.index(best)
            s[k : k + 2] = [s[k] + s[k + 1]]
            del gain[k]
            if k:
                gain[k - 1] = rank(s[k - 1] + s[k], NONE)
            if k < len(gain):
                gain[k] = rank(s[k] + s[k + 1], NONE)
        return s

    def arcs(self, text: str, at: int) -> list[str]:
        """The pieces that start at a place; a character without one stands for itself."""
        out, known, n = [text[at]], self.known.get, len(text)
        end = at + 1
        p = text[at]
        while (kind := known(p)) is not None:
            if kind == UNSEEN:
                kind = self.known[p] = PIECE if self.merged(list(p)) == [p] else PART
            if kind == PIECE and end > at + 1:
                out.append(p)
            end += 1
            if end > n:
                break
            p = text[at:end]
        return out

    def step(self, a: str | None, b: str) -> float:
        """The weight of piece b after piece a (None: at a word's start, where nothing is joined)."""
        if not self.bpe:
            i = self.id.get(b)
            return self.low if i is None else self.score[i]
        if a is None:
            return 0.0
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 2 * KEPT:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.open(a, b)
        return 0.0 if ok else NONE

    def open(self, a: str, b: str) -> bool:
        """Whether the merges leave two pieces as they are side by side."""
        return a + b not in self.rank and self.merged(list(a + b)) == [a, b]

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[x] for x in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def word(self, w: str) -> list[int]:
        """The ids of a word: the path through its part of the lattice, which has a single state on either side."""
        got = self.words.get(w)
        if got is None:
            if len(self.words) > KEPT:
                self.words.clear()
            got = self.words[w] = self.ids(only_path(self, w) if self.bpe else best_path(self, w, 0, len(w), None, None))
        return got

    def learn(self, words: Iterable[str]) -> None:
        """Puts words into the table that aren't there, many at a time."""
        new = [w for w in set(words).difference(self.words) if w]
        if not self.bpe or len(new) < TOGETHER:
            return
        if self.lattice is None:
            self.lattice = Lattice(self)
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
        self.words.update(self._paths(new))
        # characters that no piece holds stand for themselves, and what is between them is as words are
        odd = {w: self.lattice.alone.split(w) for w in new if w not in self.words}
        part = self._paths(list({x for xs in odd.values() for x in xs[::2] if x}))
        for w, xs in odd.items():
            own = [self.ids(list(x)) if k % 2 else part.get(x) if x else [] for k, x in enumerate(xs)]
            if all(x is not None for x in own):
                self.words[w] = [i for x in own for i in x]

    def _paths(self, words: list[str]) -> dict[str, list[int]]:
        """Words and the ids of those that the arrays can tell."""
        words.sort(key=len)
        out = {}
        for k in range(0, len(words), 1 << 14):
            some = words[k : k + (1 << 14)]
            out.update((w, x) for w, x in zip(some, self.lattice.paths(some), strict=True) if x is not None)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space put before it."""
        n = self.raw_at[ids + 1] - self.raw_at[ids]
        flat = self.raw[np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        return flat[1:] if self.prefix and flat[:1] == b" " else flat


@lru_cache(2)
def model_at(path: str) -> Model:
    return Model(path)


# A state at a place: the piece that ends there or reaches across, with how many characters lie beyond;
# (None, 0) at the start of a word.
State = tuple[str | None, int]


def forward(m: Model, text: str, a: int, z: int, states: list[tuple[State, float]]) -> dict[int, dict[str | None, tuple[float, tuple | None]]]:
    """Best weights of all pieces that end in a.., from states at a; by end, then piece: (weight, the one before)."""
    at: dict[int, dict] = {}
    for (piece, over), w in states:
        at.setdefault(a + over, {})[piece] = (w, None)
    for i in range(a, z):
        here = at.get(i)
        if not here:
            continue
        for b in m.arcs(text, i):
            best, source = NONE, None
            for p, (w, _) in here.items():
                v = w + m.step(p, b)
                if v > best:
                    best, source = v, p
            if best > NONE:
                if m.bpe or best > at.get(i + len(b), {}).get(b, (NONE,))[0]:
                    at.setdefault(i + len(b), {})[b] = (best, (i, source))
    return at


def best_path(m: Model, text: str, a: int, z: int, left: State | None, right: State | None) -> list[str]:
    """The pieces that start in a..z on the best path between the given states; None: the start of a word, or the text's end."""
    at = forward(m, text, a, z, [(left or (None, 0), 0.0)])
    end, piece = (z, None) if right is None else (z + right[1], right[0])
    if right is None or piece is None:
        if not at.get(z):
            return []
        piece = max(at[z], key=lambda p: at[z][p][0])
        end = z
    out = []
    while True:
        _, source = at[end][piece]
        if source is None:
            return out[::-1]
        out.append(piece)
        end, piece = source


def only_path(m: Model, text: str) -> list[str]:
    """``best_path`` of a whole word in a BPE model, whose weights are 0 or minus infinity.

    The encoding of every prefix is one path, so from a single state at most one piece that ends at a place is open:
    a place needs no more than that piece's row of weights.
    """
    n = len(text)
    ends: list[str | None] = [None] * (n + 1)
    for i in range(n):
        a = ends[i]
        if a is None:
            if not i:
                for b in m.arcs(text, 0):
                    ends[len(b)] = b
            continue
        row = m.after.get(a)
        if row is None:
            if len(m.after) > KEPT:
                m.after.clear()
            row = m.after[a] = {}
        for b in m.arcs(text, i):
            ok = row.get(b)
            if ok is None:
                ok = row[b] = m.open(a, b)
            if ok:
                ends[i + len(b)] = b
    out, i = [], n
    while i:
        out.append(ends[i])
        i -= len(ends[i])
    return out[::-1]


def words(text: str) -> list[str]:
    """Cut before every space that follows another character."""
    out = text.replace(SPACE, "\0" + SPACE).split("\0") if "\0" not in text else None
    if out is None:
        out, last = [], 0
        for i in range(1, len(text)):
            if text[i] == SPACE and text[i - 1] != SPACE:
                out.append(text[last:i])
                last = i
        return [*out, text[last:]]
    if out and not out[0]:
        out.pop(0)
    if SPACE + SPACE in text:  # spaces in a row belong to the word behind them
        joined, run = [], ""
        for w in out:
            if w == SPACE:
                run += w
            else:
                joined.append(run + w)
                run = ""
        if run:
            joined.append(run)
        return joined
    return out


def prepared(m: Model, text: str) -> str:
    return (SPACE if m.prefix and text else "") + text.replace(" ", SPACE)


def encode_all(m: Model, texts: list[str]) -> list[np.ndarray]:
    """The ids of texts that are not giant: each is one chunk with a single state on either side."""
    cut = [words(prepared(m, t)) for t in texts]
    m.learn(w for ws in cut for w in ws)
    out, table = [], m.words
    for ws in cut:
        ids: list[int] = []
        for w in ws:
            ids += table.get(w) or m.word(w)
        out.append(np.array(ids, np.int32))
    return out


def encode(m: Model, text: str) -> np.ndarray:
    return encode_all(m, [text])[0]


class Chunk:
    """The characters a..z of ``text``, which reaches a longest piece further on both sides (where the document does)."""

    def __init__(self, m: Model, text: str, a: int, z: int, first: bool, last: bool):
        self.m, self.text, self.a, self.z = m, text, a, z
        self.left = [(None, 0)] if first or self._starts(a) else self.crossing(a)
        self.right = [(None, 0)] if last or self._starts(z) else self.crossing(z)
        starts = [i for i in range(a, z + 1) if self._starts(i) or (first and i == a) or (last and i == z)]
        self.head, self.tail = (starts[0], starts[-1]) if starts else (None, None)

    def _starts(self, i: int) -> bool:
        return 0 < i < len(self.text) and self.text[i] == SPACE and self.text[i - 1] != SPACE

    def crossing(self, i: int) -> list[State]:
        """All pieces that end at a place or reach across."""
        m = self.m
        return [(p, k + len(p) - i) for k in range(max(0, i - m.longest), i) for p in m.arcs(self.text, k) if k + len(p) >= i]

    def _through(self, state: State, a: int, z: int) -> dict[State, float]:
        """The best weights of the states at z."""
        if a + state[1] > z:  # the piece reaches across the whole part
            return {(state[0], a + state[1] - z): 0.0}
        at = forward(self.m, self.text, a, z, [(state, 0.0)])
        return {(p, end - z): w for end, by in at.items() if end >= z for p, (w, _) in by.items()}

    def _exit(self, states: dict[State, float], word_start: bool) -> dict[State, float]:
        if not word_start:
            return states
        best = max((w for (_, over), w in states.items() if over == 0), default=NONE)
        return {(None, 0): best}

    def matrix(self) -> np.ndarray:
        """Best weights from every left to every right state."""
        out = np.full((len(self.left), len(self.right)), NONE)
        column = {s: j for j, s in enumerate(self.right)}
        if self.head is None:
            for i, s in enumerate(self.left):
                for t, w in self._exit(self._through(s, self.a, self.z), self.right == [(None, 0)]).items():
                    if t in column:
                        out[i, column[t]] = w
            return out
        enter = np.array([0.0 if self.head == self.a else self._exit(self._through(s, self.a, self.head), True).get((None, 0), NONE) for s in self.left])
        leave = {(None, 0): 0.0} if self.tail == self.z else self._exit(self._through((None, 0), self.tail, self.z), self.right == [(None, 0)])
        middle = 0.0 if self.m.bpe else float(sum(self._weight(w) for w in words(self.text[self.head : self.tail])))
        for t, w in leave.items():
            if t in column:
                out[:, column[t]] = enter + middle + w
        return out

    def _weight(self, w: str) -> float:
        at = forward(self.m, w, 0, len(w), [((None, 0), 0.0)])
        return max((x for x, _ in at.get(len(w), {}).values()), default=0.0)

    def trace(self, i: int, j: int) -> list[int]:
        """The ids of the pieces that start in this chunk, between two states."""
        m, left, right = self.m, self.left[i], self.right[j]
        r = None if right == (None, 0) else right
        if self.a + left[1] > self.z:
            return []
        if self.head is None:
            return m.ids(best_path(m, self.text, self.a, self.z, left, r))
        out = m.ids(best_path(m, self.text, self.a, self.head, left, None)) if self.head > self.a else []
        inner = words(self.text[self.head : self.tail]) if self.tail > self.head else []
        m.learn(inner)
        for w in inner:
            out += m.word(w)
        if self.tail < self.z:
            out += m.ids(best_path(m, self.text, self.tail, self.z, None, r))
        return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(ms: list[np.ndarray]) -> list[tuple[int, int]]:
    """From the chunk matrices of a text, the left and right state of each chunk on the best path.

    Prefix products come from pairwise combination, as a parallel scan makes them; then the states are read off backwards.
    """

    def prefixes(x: list[np.ndarray]) -> list[np.ndarray]:
        if len(x) == 1:
            return x
        pairs = prefixes([times(x[k], x[k + 1]) for k in range(0, len(x) - 1, 2)])
        out = [x[0]]
        for k in range(1, len(x)):
            out.append(pairs[k // 2] if k % 2 else times(pairs[k // 2 - 1], x[k]))
        return out

    p = prefixes(ms)
    j = int(p[-1][0].argmax())
    out = []
    for k in range(len(ms) - 1, -1, -1):
        i = int((p[k - 1][0] + ms[k][:, j]).argmax()) if k else 0
        out.append((i, j))
        j = i
    return out[::-1]


def split(m: Model, text: str, size: int = CHUNK) -> list[tuple[str, int, int, bool, bool]]:
    """The chunks of a prepared text: text with its surroundings, its own part, and whether it is the first or last."""
    cuts = [*range(0, max(1, len(text)), size), len(text)]
    cuts = sorted(set(cuts))
    out = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        lo, hi = max(0, a - m.longest - 1), min(len(text), z + m.longest + 1)
        out.append((text[lo:hi], a - lo, z - lo, a == 0, z == len(text)))
    return out


def encode_giant(m: Model, text: str, size: int = CHUNK) -> np.ndarray:
    """The ids of a text by chunks, in one place; the same steps as the distributed run."""
    parts = [Chunk(m, *x) for x in split(m, prepared(m, text), size)]
    states = scan([c.matrix() for c in parts]) if parts else []
    return np.array([i for c, s in zip(parts, states, strict=True) for i in c.trace(*s)], np.int32)


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array<int>) and round_trip (the ids decode to the text) of every row."""
    B.ready(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out_kind = "doc_id long, ids array<int>, round_trip boolean"
    is_giant = F.coalesce(F.octet_length("text") > giant, F.lit(False))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_at(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                raw = [t or b"" for t in part.column("text").to_pylist()]
                ids = encode_all(m, [t.decode("utf-8", "replace") for t in raw])
                yield _rows(part.column("doc_id"), ids, [m.decode(i) == t for i, t in zip(ids, raw, strict=True)])

    short = plain.where(~is_giant).mapInArrow(small, out_kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = model_at(path), 0
        for b in batches:
            for d, t, part in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                uid = (part << 32) | n
                n += 1
                parts = split(m, prepared(m, t.decode("utf-8", "replace")), chunk)
                for k in range(0, len(parts), 64):
                    some = parts[k : k + 64]
                    yield pa.record_batch({"uid": pa.array([uid] * len(some)), "doc_id": pa.array([d] * len(some), pa.int64()), "k": pa.array(range(k, k + len(some)), pa.int32()), **{c: pa.array([x[i] for x in some]) for i, c in enumerate(("text", "a", "z", "first", "last"))}})

    kind = "uid long, doc_id long, k int, text string, a long, z long, first boolean, last boolean"
    long_ = plain.where(is_giant).withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(cut, kind)
    long_ = B.table(spark, long_.repartition("uid", "k"), "chunks")
    cols = ("text", "a", "z", "first", "last")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_at(path)
        for b in batches:
            ms = [Chunk(m, *x).matrix() for x in zip(*(b.column(c).to_pylist() for c in cols), strict=True)]
            yield pa.record_batch({"uid": b.column("uid"), "k": b.column("k"), "rows": pa.array([len(x) for x in ms], pa.int32()), "m": pa.array([x.tobytes() for x in ms], pa.binary())})

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        ms = [np.frombuffer(x).reshape(r, -1) for x, r in zip(t.column("m").to_pylist(), t.column("rows").to_pylist(), strict=True)]
        s = scan(ms)
        return pa.table({"uid": t.column("uid"), "k": t.column("k"), "i": pa.array([x for x, _ in s], pa.int32()), "j": pa.array([y for _, y in s], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_at(path)
        for b in batches:
            texts = [x[z0:z1] for x, z0, z1 in zip(*(b.column(c).to_pylist() for c in ("text", "a", "z")), strict=True)]
            ids = [Chunk(m, *x).trace(i, j) for *x, i, j in zip(*(b.column(c).to_pylist() for c in (*cols, "i", "j")), strict=True)]
            yield pa.record_batch({"uid": b.column("uid"), "doc_id": b.column("doc_id"), "k": b.column("k"), "ids": pa.array(ids, pa.list_(pa.int32())), "part": pa.array(texts)})

    def join(t: pa.Table) -> pa.Table:
        m = model_at(path)
        t = t.sort_by("k")
        ids = t.column("ids").combine_chunks().flatten().to_numpy()
        want = "".join(t.column("part").to_pylist()).replace(SPACE, " ").encode()[1 if m.prefix else 0 :]
        return pa.Table.from_batches([_rows(t.column("doc_id").combine_chunks().slice(0, 1), [ids], [m.decode(ids) == want])])

    states = long_.mapInArrow(weigh, "uid long, k int, rows int, m binary").groupBy("uid").applyInArrow(combine, "uid long, k int, i int, j int")
    traced = long_.join(states, ["uid", "k"]).mapInArrow(trace, "uid long, doc_id long, k int, ids array<int>, part string")
    return short.union(traced.groupBy("uid").applyInArrow(join, out_kind))


def _rows(doc_id: pa.Array, ids: list[np.ndarray], ok: list[bool]) -> pa.RecordBatch:
    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(flat))
    return pa.record_batch({"doc_id": doc_id, "ids": lists, "round_trip": pa.array(ok, pa.bool_())})


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("ids")
            off = x.offsets.to_numpy()
            flat = x.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_pieces": pa.array(np.diff(off).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": b.column("round_trip")})

    return encoded.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")

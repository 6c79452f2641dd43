"""Byte-level BPE encoding and decoding (operator 3).

Pre-tokenisation uses no regular expression. Each code point becomes a symbol class (letter, number,
space, other white space, other, apostrophe that may open a contraction, end of text); a symbol stands
for a transition function on a small set of states, functions form a finite monoid, and an associative
scan over the monoid yields the state before every character. A token starts where the pair
(state, symbol) says so. Most symbols are constant functions, so the scan doubles its reach only for
the positions still open, which in prose end after two or three rounds.

The slices go through a cache of merged pieces (piece -> ids as little-endian bytes); only misses are
merged, by a heap over adjacent pairs, so a run of a million letters stays O(n log n). Token offsets
(bytes, per id) are derived from the vocabulary's lengths, and decoding joins the vocabulary's bytes.

Defined cases: null texts count as empty: no ids; repeated rows give repeated results; an empty table gives
no rows; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

L, N, O, SP, WS, A1, A2, END = range(8)  # symbols; A1 opens 's 't 'm 'd, A2 opens 're 've 'll
NSYM = 8
#: States: what the previous characters were. C1, C2: so many letters of a contraction are due; CE: it has just ended.
S_START, S_L, S_N, S_O, S_SP, S_WS, S_C1, S_C2, S_CE = range(9)
NSTATE = 9


def _symbol_functions() -> list[tuple[int, ...]]:
    def const(s):
        return (s,) * NSTATE

    letter = [S_L] * NSTATE
    letter[S_C1], letter[S_C2] = S_CE, S_C1
    opens = lambda s: tuple(S_O if q in (S_O, S_SP) else s for q in range(NSTATE))
    return [tuple(letter), const(S_N), const(S_O), const(S_SP), const(S_WS), opens(S_C1), opens(S_C2), const(S_START)]


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, element of each symbol, value of each element at START, and which are constant."""
    gens = _symbol_functions()
    elems = list(dict.fromkeys(gens))
    index = {f: i for i, f in enumerate(elems)}
    k = 0
    while k < len(elems):
        for g in gens:
            for h in (tuple(g[s] for s in elems[k]),):
                if h not in index:
                    index[h] = len(elems)
                    elems.append(h)
        k += 1
    table = np.zeros((len(elems), len(elems)), np.uint8)
    for i, f in enumerate(elems):  # first f, then g
        for j, g in enumerate(elems):
            h = tuple(g[s] for s in f)
            if h not in index:
                raise AssertionError("not closed")
            table[i, j] = index[h]
    return table, np.array([index[g] for g in gens], np.uint8), np.array([f[S_START] for f in elems], np.uint8), np.array([len(set(f)) == 1 for f in elems])


COMPOSE, ELEMENT, AT_START, CONSTANT = _monoid()

#: STARTS[state, symbol]: a token starts at a character of this symbol after this state.
STARTS = np.ones((NSTATE, NSYM), bool)
STARTS[[S_L, S_SP, S_C1, S_C2], L] = False
STARTS[[S_N, S_SP], N] = False
for _s in (O, A1, A2):
    STARTS[[S_O, S_SP], _s] = False
for _s in (SP, WS):
    STARTS[[S_SP, S_WS], _s] = False

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Symbol class of every code point (built once per process)."""
    if not _classes:
        t = np.full(0x110000, O, np.uint8)
        cat = unicodedata.category
        for c in range(0x110000):
            k = cat(chr(c))[0]
            if k == "L":
                t[c] = L
            elif k == "N":
                t[c] = N
        for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            t[c] = WS
        t[0x20] = SP
        _classes.append(t)
    return _classes[0]


def states_before(symbols: np.ndarray) -> np.ndarray:
    """State before each character: an exclusive associative scan of the symbols' transition functions."""
    f = ELEMENT[symbols]
    open_ = np.flatnonzero(~CONSTANT[f])
    reach = 1
    while len(open_):  # Kogge-Stone doubling, confined to positions whose prefix is not constant yet
        open_ = open_[open_ >= reach]
        if not len(open_):
            break
        f_new = COMPOSE[f[open_ - reach], f[open_]]
        f[open_] = f_new
        open_ = open_[~CONSTANT[f_new]]
        reach *= 2
    out = np.empty(len(symbols), np.uint8)
    if len(out):
        out[0] = S_START
        out[1:] = AT_START[f[:-1]]
    return out


def boundaries(cps: np.ndarray) -> np.ndarray:
    """Token starts in an array of code points, where 0x110000 separates texts (a separator starts a token of its own)."""
    n = len(cps)
    sep = cps >= 0x110000
    sym = classes()[np.where(sep, 0, cps)]
    sym[sep] = END
    q = np.flatnonzero(cps == 0x27)
    if len(q):
        pad = np.concatenate([cps, np.array([0x110000, 0x110000], cps.dtype)])
        a, b = pad[q + 1], pad[q + 2]
        sym[q[np.isin(a, [115, 116, 109, 100])]] = A1  # s t m d
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        sym[q[two]] = A2
    start = STARTS[states_before(sym), sym]
    blank = (sym == SP) | (sym == WS)
    nxt = np.empty(n, bool)  # the next character exists in the text and is no white space
    if n:
        nxt[-1] = False
        nxt[:-1] = ~blank[1:] & (sym[1:] != END)
    return np.flatnonzero(start | (blank & nxt) | sep)


_PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


class Encoder:
    """Cached pair merging by the ranks of a .tiktoken file."""

    #: Longest piece (bytes) and most pieces that the cache keeps; others are merged each time.
    CACHE_PIECE, CACHE_SIZE = 64, 250_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.vocab[v] = k
        self.lengths = np.array([len(v) for v in self.vocab], np.int64)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        return self._merge_short(piece, n) if n <= 48 else self._merge_heap(piece, n)

    def _merge_heap(self, piece: bytes, n: int) -> list[int]:
        ranks = self.ranks
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], nxt[i] = e, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def _merge_short(self, piece: bytes, n: int) -> list[int]:
        get, none = self.ranks.get, 1 << 40
        cut = list(range(n + 1))
        rank = [get(piece[i : i + 2], none) for i in range(n - 1)]
        m = min(rank)
        while m < none:
            i = rank.index(m)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(piece[cut[i] : cut[i + 2]], none)
            elif not rank:
                break
            if i:
                rank[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], none)
            m = min(rank)
        ranks = self.ranks
        return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]

    def piece(self, s: str) -> bytes:
        b = s.encode("utf-8")
        got = self.merge(b)
        ids = _PACK[len(got)](*got) if len(got) < len(_PACK) else np.array(got, "<u4").tobytes()
        if len(b) <= self.CACHE_PIECE:
            if len(self.cache) >= self.CACHE_SIZE:
                self.cache.clear()
            self.cache[s] = ids
        return ids

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        joined = "\0".join(texts) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cps[ends] = 0x110000
        cut = boundaries(cps)
        limits = np.searchsorted(cut, ends)  # the separator's own cut, by text
        marks = np.append(cut, len(cps)).tolist()
        pieces = [joined[a:b] for a, b in zip(marks, marks[1:])]
        get, out, lo = self.cache.get, [], 0
        for hi in limits.tolist():
            own = pieces[lo:hi]
            ids = list(map(get, own))
            if None in ids:
                ids = [x if x is not None else (get(s) or self.piece(s)) for x, s in zip(ids, own)]
            out.append(b"".join(ids))
            lo = hi + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each id in the decoded text, and the total."""
        return common.cumulative(self.lengths[np.frombuffer(ids, "<u4")])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<bigint>, starts array<bigint>]) of each row.

    `ids` adds the ids and their byte offsets, for use beyond the digest.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, starts array<bigint>" if ids else "")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            key = b.column(0)
            for c in common.chunks(b.column(1)):
                got = enc.encode_texts([c.text(i) for i in range(len(c))])
                cols = [key.slice(c.lo, len(c)).cast(pa.int64()), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in got]), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in got])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in got], pa.list_(pa.int64())), pa.array([enc.offsets(x)[:-1] for x in got], pa.list_(pa.int64()))]
                    names += ["ids", "starts"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False)

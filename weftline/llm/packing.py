"""Best-fit packing (operator 10): tokenise, cut at the sequence length, pack by sums of squares.

Sum-of-squares rule (Csirik, Johnson, Kenyon, Orlin, Shor and Weber): with N(g) open bins of gap g, an
item goes where the sum of N(g)**2 becomes smallest. Only lengths matter, so the ids stay in the pass
that makes them and the packing sees rows of a few integers. Those are hashed by (doc_id, piece) into
groups of about `GROUP_PIECES` pieces, each packed in one task in order of falling length; what a group
leaves open is a bounded number of bins, so the waste per piece falls with the group's size and
not with the corpus's. Pieces of full length take a sequence each.

Tokenising keeps a cache of words: text whose characters all lie in a range where lower-casing and
composition are one to one is split by the tokenizer's own pattern and each distinct word is given to
the tokenizer once; any other text, and one that holds the literal of an added token, goes to it whole.

Defined cases: null texts count as empty: one piece, the end id alone; repeated rows are packed one by one;
pieces of equal length go in order of doc_id and piece; an empty table gives no rows; only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 4096, 1
GROUP_PIECES = 60_000
#: The tokenizer's own pattern, spelled out for lower-cased text of SAFE characters.
_LETTER, _NUMBER = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
SPLIT = re.compile(f"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: ASCII, Latin-1 and Latin Extended-A letters but for those with unusual case pairs, and plain punctuation.
SAFE = re.compile(r"[\t-\r\x20-\x7E¡-įĲ-ňŊ-ž‐-‧‰-⁞€]*")


class Tokens:
    CACHE = 200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        # the tokenizer looks for its added tokens in the text as it stands, so a text that holds one goes to it whole
        self.added = re.compile("|".join(re.escape(x.content) for x in self.t.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        self.cache: dict[str, bytes] = {}
        vocab = self.t.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[v for k, v in vocab.items() if k.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, miss: list[str]) -> None:
        """Ids of words by one call: apart by spaces they stay as they are, and an end-of-word id closes each."""
        if not miss:
            return
        ids = np.array(self.t.encode_batch_fast([" ".join(miss)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
        if len(ends) != len(miss):
            raise AssertionError("a word end per word")
        raw, cache, lo = ids.tobytes(), self.cache, 0
        for w, hi in zip(miss, ends):
            cache[w] = raw[4 * lo : 4 * hi]
            lo = hi

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes."""
        words = [None if self.added.search(x) or not SAFE.fullmatch(x) else SPLIT.findall(x.lower()) for x in texts]
        cache = self.cache
        miss = {w for own in words if own for w in own if w not in cache}
        if len(cache) + len(miss) > self.CACHE:
            cache.clear()
            miss = {w for own in words if own for w in own}
        self._learn(list(miss))
        return [self.whole(x) if own is None else b"".join(map(cache.__getitem__, own)) for x, own in zip(texts, words)]

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        t = tokens(path)
        for b in batches:
            for c in common.chunks(b.column(1)):
                key = b.column(0).slice(c.lo, len(c)).cast(pa.int64())
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(t.all_ids([c.text(i) for i in range(len(c))])):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        row.append(i), piece.append(p), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([key.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, packed in the given order by the sum-of-squares rule."""
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed and doesn't count
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offs, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        best, cost = capacity, 0
        rest = n[: capacity + 1 - s]  # N(g - s) of the gaps g from s on
        now = n[s:]
        # moving a bin from g to g - s: (N(g-s)+1)**2 - N(g-s)**2 + (N(g)-1)**2 - N(g)**2
        delta = 2 * (rest - now) + 2
        if s:
            delta[0] = 1 - 2 * now[0]  # closing a bin frees its square
        new = 2 * n[capacity - s] + 1 if s < capacity else 0
        delta[now == 0] = 1 << 60
        g = int(delta.argmin())
        best, cost = g + s, int(delta[g])
        if cost <= new and now[g]:
            b = open_[best].pop()
            n[best] -= 1
            gap = best
        else:
            b, used, gap = used, used + 1, capacity
        bins[k], offs[k] = b, capacity - gap
        if gap - s > 0:
            n[gap - s] += 1
            open_[gap - s].append(b)
    return bins, offs


def pack(rows: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with (doc_id, piece, length); `groups` tasks pack on their own."""
    fields = [f for f in rows.schema.names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"

    def run(key, t):
        length = t.column("length").to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy(), -length))
        bins, offs = sum_of_squares(length[order], capacity)
        t = t.take(pa.array(order)).select(fields)
        base = key[0].as_py() << 40
        return t.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offs))

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    return rows.groupBy(group.alias("_group")).applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    # pieces outnumber texts by the few that exceed the capacity, so the texts' count sets the groups
    rows = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(rows, max(1, round(docs.count() / GROUP_PIECES)))

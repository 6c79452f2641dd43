"""Document fingerprints (operator 8): a homomorphic multiset hash of paragraphs.

A fingerprint is a vector modulo 2**32, the sum of one wide vector per paragraph (a line with a word, from
its first word to its last). Order does not matter, and inserting or deleting a paragraph adds or subtracts
its vector (`insert`, `delete`). A paragraph's vector has two parts: `EXACT` lanes, its 512-bit BLAKE2b
digest, which make unequal multisets differ, and `SKETCH` lanes that count its word 2-grams with signs (an
AMS count sketch), whose inner products estimate how much two texts share. No count of a text can reach
half the modulus, so likeness, the cosine of the sketch lanes cut to 0..1, is that of the true counts;
equal fingerprints have likeness 1. Fingerprints are printed as base64 of little-endian lanes.

The comparison partner, the next text in descending doc_id, is found by splitting the id range at
sampled ids and sending the first row of each range also to the range before, so no task sees more than
its range and texts move once.

Defined cases: null texts count as empty, an empty text has the zero vector; likeness with a zero vector
is 1 for two zero vectors, else 0; rows with equal doc_id follow each other in order of their text, rows
without doc_id come last; a single row is its own next; an empty table gives no rows; only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64

EXACT, SKETCH = 16, 256
MAX_RANGES = 20_000
WIDTH = EXACT + SKETCH


def vectors(texts: list[str]) -> np.ndarray:
    """One uint32 vector of WIDTH lanes per text."""
    out = np.zeros((len(texts), WIDTH), np.uint32)
    for c in common.chunks(pa.array(texts, pa.large_string())):
        out[c.lo : c.hi] = _chunk(c)
    return out


def _chunk(c: common.Chunk) -> np.ndarray:
    starts, ends, lim = common.words(c)
    m = len(c)
    out = np.zeros((m, WIDTH), np.uint32)
    if not len(starts):
        return out
    h = common.span_hashes(c.data, starts, ends)
    text = np.repeat(np.arange(m), np.diff(lim))
    nl = common.cumulative(c.data == 10)
    para = nl[starts] + text  # distinct neighbours for distinct lines and texts
    first = np.concatenate([[True], (para[1:] != para[:-1]) | (text[1:] != text[:-1])])
    # a word with the word before it in its paragraph, or alone at the paragraph's start
    with np.errstate(over="ignore"):
        prev = np.concatenate([[U64(0)], h[:-1]])
        g = common.mix(h * U64(0x9FB21C651E98DF25) + np.where(first, U64(0x51ED2701), prev))
        lane = (g >> U64(56)).astype(np.int64) % SKETCH
        sign = np.where(g & U64(1), 1, -1)
        sk = np.bincount(text * SKETCH + lane, weights=sign, minlength=m * SKETCH).astype(np.int64).reshape(m, SKETCH)
        out[:, EXACT:] = sk.astype(np.uint32)
        at = np.flatnonzero(first)
        raw, digest = c.data.tobytes(), hashlib.blake2b
        last = np.append(at[1:], len(h)) - 1
        lanes = np.frombuffer(b"".join([digest(raw[a:b]).digest() for a, b in zip(starts[at].tolist(), ends[last].tolist())]), "<u4").reshape(-1, EXACT)
        cum = np.concatenate([np.zeros((1, EXACT), np.uint32), np.cumsum(lanes, 0, dtype=np.uint32)])
        edge = np.searchsorted(text[at], np.arange(m + 1))
        out[:, :EXACT] = cum[edge[1:]] - cum[edge[:-1]]
    return out


def printed(v: np.ndarray) -> str:
    return base64.b64encode(v.astype("<u4").tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def _shifted(fingerprint: str, paragraphs: list[str], sign: int) -> str:
    with np.errstate(over="ignore"):
        d = vectors(paragraphs).sum(0, dtype=np.uint32)
        return printed(parsed(fingerprint) + d if sign > 0 else parsed(fingerprint) - d)


def insert(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint of a text with paragraphs added, wherever they stand."""
    return _shifted(fingerprint, paragraphs, 1)


def delete(fingerprint: str, paragraphs: list[str]) -> str:
    """The fingerprint of a text with paragraphs taken away."""
    return _shifted(fingerprint, paragraphs, -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the sketch lanes of two arrays of vectors (rows), within 0..1."""
    x, y = a[:, EXACT:].astype(np.int32).astype(float), b[:, EXACT:].astype(np.int32).astype(float)
    same = (a == b).all(1)
    n = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return np.where(same, 1.0, np.clip((x * y).sum(1) / np.maximum(n, 1e-9), 0, 1))


def edited(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (doc_id, text, next text)."""
    v = vectors([r[1] for r in rows] + [rows[-1][2]])
    e = [edited(r[1], r[2]) for r in rows]
    ev = vectors(e)
    own, nxt = v[:-1], v[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in e]), pa.array(map(printed, own)), pa.array(map(printed, ev)), pa.array(likeness(own, ev)), pa.array(likeness(own, nxt))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def compare_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness to it and to the next text."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    # real ids that split the range, largest first; the largest of all leads the first range. At most MAX_RANGES longs.
    ranges = max(1, min(ranges, MAX_RANGES))
    qs = [i / ranges for i in range(1, ranges)]
    row = t.agg(F.max(key), *([F.percentile_approx(key, qs, 10 * MAX_RANGES)] if qs else [])).first()
    if row[0] is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    heads = docs.sparkSession.sparkContext.broadcast(np.array(sorted({row[0], *(row[1] if qs else [])}), np.int64))
    n = len(heads.value)

    # range p holds the ids <= its head and > the next one; a head's rows go also to the range before, as ghosts
    @F.pandas_udf("bigint")
    def place(k: pd.Series) -> pd.Series:
        """2 * range + whether the id is the range's head."""
        h, x = heads.value, k.to_numpy()
        up = np.searchsorted(h, x, "left")
        return pd.Series(2 * (len(h) - 1 - up) + (h[np.minimum(up, len(h) - 1)] == x))

    at = t.select("doc_id", "text", key.alias("_k")).withColumn("_at", place("_k"))
    p = F.expr("_at div 2")
    own = F.struct(p.alias("p"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.when(p == 0, F.lit(n - 1).cast("bigint")).otherwise(p - 1).alias("p"), F.lit(True).alias("ghost"))
    rows = at.select("doc_id", "text", "_k", F.explode(F.when(F.col("_at") % 2 == 1, F.array(own, ghost)).otherwise(F.array(own))).alias("_p")).select("doc_id", "text", "_k", "_p.p", "_p.ghost")
    rows = rows.repartitionById(n, F.col("p").cast("int")).sortWithinPartitions("p", "ghost", F.desc("_k"), "text")

    def run(batches):
        open_: tuple | None = None  # range, doc_id, text of the row that waits for its next
        done = -1  # range that has had its ghost
        ready, size = [], 0
        for b in batches:
            ids, ps, ghosts = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for i in range(b.num_rows):
                if ghosts[i] and done == ps[i]:
                    continue
                text = b.column(1)[i].as_py()
                if open_ is not None and open_[0] == ps[i]:
                    ready.append((open_[1], open_[2], text))
                    size += len(open_[2])
                    if size > common.CHUNK_BYTES:
                        yield _compare(ready)
                        ready, size = [], 0
                if ghosts[i]:
                    done, open_ = ps[i], None
                    if ready:
                        yield _compare(ready)
                    ready, size = [], 0
                else:
                    open_ = (ps[i], ids[i], text)
        if ready:
            yield _compare(ready)

    return rows.select("doc_id", "text", "p", "ghost").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return compare_next(docs, 2 * docs.rdd.getNumPartitions())

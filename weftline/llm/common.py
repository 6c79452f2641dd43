"""Shared pieces of the training-data operators: table access, bounded Arrow chunks and
vectorised word arithmetic over UTF-8 bytes.

Texts are never decoded to find words: white space is ASCII, so word limits, word hashes and
shingles come from numpy passes over the Arrow value buffer. A chunk holds about a megabyte (or a
single longer text), which bounds the memory of a Python worker whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir

CHUNK_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240607)
BYTE64 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_pow: dict[str, np.ndarray] = {}


#: Arrow batches carry whole texts, so they are limited by bytes rather than by rows alone.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes in this session, unless it has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persist(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage by a written table in the shared folder, which survives the loss of executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables written by persist() that nothing reads any more (what was derived from them is written itself)."""
    for t in tables:
        if path := getattr(t, "_written", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs


class Chunk:
    """Rows [lo, hi) of a batch; `data` their UTF-8 bytes, `offs` the text limits in it."""

    __slots__ = ("lo", "hi", "data", "offs")

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> str:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if len(col) == 0:
        return
    data, offs = _buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_pow.get("p", ()))
    if have < n:
        n = max(n, 2 * have, CHUNK_BYTES + 1024)
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("q", _PINV)):
                _pow[key] = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)
    return _pow["p"], _pow["q"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], by one prefix sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE64[data] * p[: len(data)], dtype=np.uint64, out=c[1:])
        h = (c[ends] - c[starts]) * q[starts]
        return mix(h + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words `[^\\x20\\x09-\\x0D]+`, and per text the word range limits."""
    n = len(c.data)
    isw = ~SPACE[c.data]
    before = np.zeros(n + 1, bool)
    before[1:] = isw
    before[c.offs] = False
    after = np.zeros(n + 1, bool)
    after[:n] = isw
    after[c.offs] = False
    starts = np.flatnonzero(isw & ~before[:n])
    ends = np.flatnonzero(isw & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, c.offs)


def per_text(cum: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sums per text of what was summed up (with a leading 0) in `cum`."""
    return cum[limits[1:]] - cum[limits[:-1]]


def cumulative(x: np.ndarray, dtype=np.int64) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype)
    np.cumsum(x, out=out[1:], dtype=dtype)
    return out


def ngram_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of the n-grams that start at each position (positions too near the end included up to len - n)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, U64(salt * 2 + 1), np.uint64)
        for k in range(n):
            out = out * U64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k]
        return mix(out)


def sample_ids(labels: DataFrame, per_class: int, label: str) -> DataFrame:
    """At most `per_class` labelled doc_ids of each class, those of smallest hash: (doc_id, label).

    The bound holds at every size, and both the selection and the driver's part of it are bounded by it. A doc_id
    that both classes hold counts as of class 0; repeated rows count once.
    """
    t = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    t = t.withColumn("_h", F.xxhash64(F.lit(7), "doc_id"))
    parts = [t.where(F.col("label") == k).distinct().orderBy("_h", "doc_id").limit(per_class) for k in (0, 1)]
    best: dict[int, int] = {}
    for r in parts[0].unionByName(parts[1]).select("doc_id", "label").collect():
        best[r[0]] = min(r[1], best.get(r[0], 1))
    return labels.sparkSession.createDataFrame(pa.Table.from_pydict({"doc_id": pa.array(best.keys(), pa.int64()), "label": pa.array(best.values(), pa.int32())}))


def labelled_sample(documents: DataFrame, labels: DataFrame, per_class: int, label: str) -> DataFrame:
    """(doc_id, text, label) of the bounded sample. The id list is at most 2 * per_class rows, so it may be broadcast.

    Of rows that share a doc_id the smallest text counts.
    """
    ids = sample_ids(labels, per_class, label)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def within_bytes(sample: DataFrame, most: int, seed: int) -> DataFrame:
    """The rows (doc_id, text, ...) of a sample of bounded row count, in order of id hash, whose whole texts make up at most `most` bytes."""
    w = W.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    fit = sample.select("doc_id", F.octet_length("text").cast("bigint").alias("_n")).withColumn("_n", F.sum("_n").over(w)).where(F.col("_n") <= most)
    return sample.join(F.broadcast(fit.select("doc_id")), "doc_id")

"""Quality rules (operator 4): exact base counts, then a hashed n-gram logistic regression.

Base counts come from whole texts with numpy passes over the bytes. The verdict is a logistic
regression over hashed word 1- and 2-grams and character 3- and 5-grams (each group's frequencies sum
to 1, so length is no feature), trained on a bounded sample of labelled rows
(`SAMPLE_PER_CLASS` per class, `SAMPLE_BYTES` of whole texts in all), Platt-calibrated on a fifth of it held back, and scored in Arrow
batches. A text is kept when it passes the base rules and its probability of quality 1 is at least
`KEEP_AT`, a fixed threshold: labels are noisy and dropping good text costs more than keeping bad.

Defined cases: a null or empty text has all counts 0 and base_failed true; ties and repeated rows get
equal results; a doc_id labelled both ways counts as 0 and of its texts the smallest is read; with no labels of
either class the model keeps whatever passes the base rules; an empty table gives no rows; columns other than
doc_id and text are never read, so extra ones cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64

#: Most labelled rows of each class that training reads, and most bytes of their texts: the model is fitted on the driver, so its size is fixed.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 64 << 20
BITS = 16
KEEP_AT = 0.35
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
GROUPS = ("word1", "word2", "char3", "char5")
WINDOW = 8


def base_counts(c: common.Chunk, w=None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per text of a chunk."""
    starts, ends, lim = w or common.words(c)
    data, offs, m = c.data, c.offs, len(c)
    lead = (data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(lim),
        "word_chars": common.per_text(common.cumulative(lead & ~common.SPACE[data]), offs),
        "n_symbols": common.per_text(common.cumulative(SYMBOL[data]), offs),
    }
    # lines: equal spans of one text, by (text, span hash)
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offs] = True
    ls = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    le = np.append(ls[1:], len(data))
    if len(ls):
        le = le - ((le > ls) & (data[np.maximum(le, 1) - 1] == 10))
        keep = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        ls, le = ls[keep], le[keep]
    text = np.searchsorted(offs, ls, "right") - 1
    key = common.span_hashes(data, ls, le) ^ common.mix(text.astype(np.uint64) + U64(11))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=m) - np.bincount(text[first], minlength=m)
    # 8-word windows found again in their text
    h = common.span_hashes(data, starts, ends)
    covered = np.zeros(len(h), bool)
    if len(h) >= WINDOW:
        wt = np.searchsorted(lim, np.arange(len(h)), "right") - 1
        g = common.ngram_hashes(h, WINDOW)
        ok = np.flatnonzero(wt[: len(g)] == wt[WINDOW - 1 :])
        k = g[ok] ^ common.mix(wt[ok].astype(np.uint64) + U64(13))
        order = np.argsort(k, kind="stable")
        ks = k[order]
        same = np.zeros(len(ks), bool)
        if len(ks):
            eq = ks[1:] == ks[:-1]
            same[1:] |= eq
            same[:-1] |= eq
        at = ok[order[same]]
        d = np.zeros(len(h) + 1, np.int32)
        np.add.at(d, at, 1)
        np.add.at(d, at + WINDOW, -1)
        covered = np.cumsum(d[:-1]) > 0
    out["n_repeat_words"] = common.per_text(common.cumulative(covered), lim)
    out["_h"] = h
    return out


def base_failed(b: dict[str, np.ndarray]) -> np.ndarray:
    return (b["n_words"] < 20) | (100 * b["n_repeat_words"] > 30 * b["n_words"])


def features(c: common.Chunk, lim: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per group: bucket of every n-gram, and per text the limits in that array. n-grams that cross texts are left out."""
    shift = U64(64 - BITS)
    out = [((common.mix(h + U64(101)) >> shift).astype(np.uint16), lim)]
    cps = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = common.cumulative((c.data & 0xC0) != 0x80)
    coffs = lead[c.offs]
    for arr, limits, n, salt in ((h, lim, 2, 5), (cps, coffs, 3, 6), (cps, coffs, 5, 7)):
        if arr is cps:  # multiply-shift over code points, cheap and in 32 bits
            with np.errstate(over="ignore"):
                g = np.zeros(max(0, len(cps) - n + 1), np.uint32)
                for k in range(n):
                    g *= np.uint32(0x01000193 * 2 + 0x5BD1E995)
                    g += cps[k : len(cps) - n + 1 + k] * np.uint32(0x9E3779B1) if len(g) else g
                g ^= g >> np.uint32(15)
                g *= np.uint32(0x2C1B3C6D)
                idx = (g >> np.uint32(32 - BITS)).astype(np.uint16)
        else:
            idx = (common.ngram_hashes(arr, n, salt) >> shift).astype(np.uint16)
        keep = np.ones(len(idx), bool)
        for k in range(1, n):
            e = limits[1:] - k
            e = e[(e >= 0) & (e < len(idx))]
            keep[e] = False
        out.append((idx[keep], common.cumulative(keep)[np.minimum(limits, len(idx))]))
    return out


class Model:
    """weights: (groups, 2**BITS) float32; probability = sigmoid(a * logit + b)."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def logits(self, feats) -> np.ndarray:
        z = self.bias
        for w, (idx, lim) in zip(self.weights, feats):
            n = np.diff(lim)
            z = z + common.per_text(common.cumulative(w[idx], np.float64), lim) / np.maximum(n, 1)
        return z

    def probabilities(self, feats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.logits(feats) + self.b, -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton with a weak prior on (1, 0)
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + (a - 1) * 0.1, (p - y).sum() + b * 0.01])
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[tuple[str, int]], epochs: int = 12, rate: float = 10.0, l2: float = 1e-7, prior_weight: float | None = None) -> Model:
    """Adagrad over the sample. The classes of the sample are weighted back to `prior_weight` (share of class 1)."""
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros((len(GROUPS), 1 << BITS), np.float32), 10.0, 1.0, 0.0)
    feats, ys = [], []
    for text, y in rows:
        for c in common.chunks(pa.array([text or ""], pa.large_string())):
            s, e, lim = common.words(c)
            one = []
            for g, (idx, _) in enumerate(features(c, lim, common.span_hashes(c.data, s, e))):
                u, n = np.unique(idx, return_counts=True)
                one.append((u.astype(np.int32) + np.int32(g << BITS), (n / max(1, n.sum())).astype(np.float32)))
            feats.append((np.concatenate([a for a, _ in one]), np.concatenate([b for _, b in one])))
            ys.append(y)
    y = np.array(ys, float)
    share = y.mean() if prior_weight is None else prior_weight
    cw = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    held = order[: len(order) // 5]
    train = order[len(order) // 5 :]
    w = np.zeros(len(GROUPS) << BITS, np.float64)
    acc = np.full_like(w, 1e-4)
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    for ep in range(epochs):
        for i in rng.permutation(train):
            idx, val = feats[i]
            z = bias + w[idx] @ val
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * cw[i]
            gv = g * val + l2 * w[idx]
            acc[idx] += gv * gv
            w[idx] -= rate / 100 * gv / np.sqrt(acc[idx])
            bias -= 0.01 * g
    z = np.array([bias + w[feats[i][0]] @ feats[i][1] for i in held])
    # calibration keeps the class shares of the labelled population
    k = np.repeat(np.arange(len(held)), np.maximum(1, np.round(cw[held] * 4)).astype(int))
    a, b = _platt(z[k], y[held][k])
    return Model(w.reshape(len(GROUPS), -1).astype(np.float32), bias, a, b)


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    n = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    sample = common.persist(common.labelled_sample(documents, labels, per_class, "quality").where("text is not null"), "quality-sample")
    rows = [(r["text"], r["label"]) for r in common.within_bytes(sample, SAMPLE_BYTES, 11).orderBy("doc_id").collect()]
    common.drop(sample)
    n0, n1 = n.get(0, 0), n.get(1, 0)
    return fit(rows, prior_weight=n1 / (n0 + n1) if n0 + n1 else None)


def score(df: DataFrame, model: Model, keep_at: float = KEEP_AT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: len(GROUPS) * 2**BITS floats
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        m = shared.value
        for b in batches:
            for c in common.chunks(b.column(1)):
                w = common.words(c)
                got = base_counts(c, w)
                bad = base_failed(got)
                p = m.probabilities(features(c, w[2], got["_h"]))
                cols = [b.column(0).slice(c.lo, len(c)).cast(pa.int64()), *(pa.array(got[k], pa.int64()) for k in names), pa.array(bad), pa.array(~bad & (p >= keep_at)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "base_failed", "kept", "probability"])

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in names) + ", base_failed boolean, kept boolean, probability double")


def keep_documents(df: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of `df` (all columns) that are kept; decided batch by batch, so nothing is shuffled or joined."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            keep = []
            for c in common.chunks(b.column(at)):
                w = common.words(c)
                got = base_counts(c, w)
                keep.append(~base_failed(got) & (m.probabilities(features(c, w[2], got["_h"])) >= keep_at))
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))

"""Toxicity (operator 1): maximum-scoring segments over token log-odds.

Token scores are log-odds of toxic against other labelled text under an informative Dirichlet prior
(the prior is the pooled distribution), lowered by `CAUTION` standard errors and by a drift, so that the
expected score of ordinary text is negative. A linear-time scan in the manner of Ruzzo and Tompa finds
all maximal scoring segments of a whole text; lambda solves sum p exp(lambda s) = 1 over the ordinary
tokens and K is fitted on the ordinary training texts, so a segment's score becomes an extreme-value
p-value in which the text's length is paid for; significant passages are those of at most `SIGNIFICANT`.
The segments of a text are combined by the sum statistic of Karlin and Altschul, and a logistic curve
that allows for wrong labels turns that evidence (-ln p) into the score. K and the curve are fitted on a fifth of the sample that the
token scores have not seen; the final scores then count that fifth too.

Training reads only labelled rows with crc32(doc_id as text) mod 3 other than 1, at most
`SAMPLE_PER_CLASS` of each class; text alone is an input. Tokens are hashed to 2**BITS scores, so every
token of the sample counts and the model's size is fixed.

Defined cases: null and empty texts have no tokens, hence no evidence, and get the curve's value at 0;
equal texts get equal scores, repeated rows a row each; a doc_id labelled both ways counts as clean and
of its texts the smallest is read; with no usable labels every score is 0; an empty table gives no rows;
only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64

SAMPLE_PER_CLASS = 8000
BITS = 20
#: Largest p-value of a segment that is reported.
SIGNIFICANT = 0.01
#: Prior weight in texts, standard errors of caution, drift per token, limit of a score.
PRIOR, CAUTION, DRIFT, CLIP = 10.0, 0.5, 1.5, 8.0
#: Limit of the rate of wrong labels in the curve.
MISLABELLED = 0.3
PREDICT_AT = 0.7
PUNCT = np.zeros(256, bool)
PUNCT[list(b".,;:!?\"'()[]{}*_-#$%&|<>~`/\\+=^@")] = True


def tokens(c: common.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased tokens (runs without white space and ASCII punctuation), their spans and the limits per text."""
    d = common.LOWER[c.data]
    d = np.where(PUNCT[d], np.uint8(0x20), d)
    t = common.Chunk(c.lo, c.hi, d, c.offs)
    s, e, lim = common.words(t)
    return common.span_hashes(d, s, e), s, e, lim


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


class Model:
    def __init__(self, scores: np.ndarray | None = None, lam: float = 1.0, k: float = 0.1, a: float = 0.0, b: float = -30.0):
        self.scores = np.full(1 << BITS, -1.0, np.float32) if scores is None else scores.astype(np.float32)
        self.lam, self.k, self.a, self.b = lam, k, a, b

    def token_scores(self, h: np.ndarray) -> np.ndarray:
        return self.scores[bucket(h)].astype(float)

    def p_value(self, s: float, n: int) -> float:
        """Chance of a segment of score s or more in n ordinary tokens."""
        return -math.expm1(-min(self.k * n * math.exp(-self.lam * s), 700.0))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * np.log1p(evidence) + self.b, -30, 30)))


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence.

    Runs of one sign are summed first (a segment never splits a run), then the stack of candidate
    segments is merged leftwards; every run enters and leaves the stack once.
    """
    pos = np.flatnonzero(s > 0)
    if not len(pos):
        return []
    brk = np.flatnonzero(np.diff(pos) > 1)
    rs = pos[np.concatenate([[0], brk + 1])]
    re = pos[np.concatenate([brk, [len(pos) - 1]])] + 1
    cum = np.concatenate([[0.0], np.cumsum(s)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, cumulative before, cumulative after
    for a, b, lo, hi in zip(rs.tolist(), re.tolist(), cum[rs].tolist(), cum[re].tolist()):
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= lo:
                j -= 1
            # segments between j and the top start no lower than this one: they can't be extended by it or by later ones
            if j < 0 or stack[j][3] >= hi:
                break
            a, lo = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((a, b, lo, hi))
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def evidence(scores: list[float], n: int, lam: float, k: float) -> float:
    """-ln p of the best sum over the r highest segments (Karlin and Altschul), with a factor 2**r for the choice of r."""
    if not scores or n <= 0:
        return 0.0
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = lam * s - math.log(max(k * n, 1e-9))
        if r > 1 and x <= 0:
            break
        total += x
        # P(T_r >= t) is about exp(-t) t**(r-1) / (r! (r-1)!)
        p = total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
        best = max(best, p)
    return best


def score_chunk(c: common.Chunk, m: Model) -> tuple[np.ndarray, list, tuple]:
    h, s, e, lim = tokens(c)
    ts = m.token_scores(h)
    hit = common.per_text(common.cumulative(ts > 0), lim)
    ev = np.zeros(len(c))
    segs: list[list[tuple[int, int, float]]] = [[] for _ in range(len(c))]
    for i in np.flatnonzero(hit).tolist():
        a, b = lim[i], lim[i + 1]
        segs[i] = maximal_segments(ts[a:b])
        ev[i] = evidence([x[2] for x in segs[i]], int(b - a), m.lam, m.k)
    return ev, segs, (s, e, lim)


def _counts(sample: DataFrame) -> DataFrame:
    """(token, clean, toxic, uses) by hash bucket: texts of each class that hold it, and its uses in clean text; combined before the shuffle.

    Texts count, not uses: a word that one long text repeats says little about its class.
    """

    def run(batches):
        for b in batches:
            lab = np.asarray(b.column(1))
            for c in common.chunks(b.column(0)):
                h, _, _, lim = tokens(c)
                h = bucket(h)
                t = np.repeat(np.arange(len(c)), np.diff(lim))
                order = np.lexsort((t, h))
                hs, ts = h[order], t[order]
                y = lab[c.lo : c.hi][ts]
                new = np.ones(len(hs), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
                u, inv = np.unique(hs, return_inverse=True)
                count = lambda w: np.bincount(inv, weights=w, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(count(new & (y == 0))), pa.array(count(new & (y == 1))), pa.array(count(y == 0))], ["token", "clean", "toxic", "uses"])

    return sample.select("text", "label").mapInArrow(run, "token bigint, clean bigint, toxic bigint, uses bigint").groupBy("token").agg(*(F.sum(x).alias(x) for x in ("clean", "toxic", "uses")))


def log_odds(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds (toxic against clean) under the pooled Dirichlet prior, and its standard error."""
    a = PRIOR * (clean + toxic) / max(1, n_clean + n_toxic)
    y1, y0 = toxic + a, clean + a
    d = np.log(y1 / (n_toxic + PRIOR - y1)) - np.log(y0 / (n_clean + PRIOR - y0))
    return d, np.sqrt(1 / y1 + 1 / y0)


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    if not (s > 0).any() or (p * s).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while (p * np.exp(np.minimum(hi * s, 700))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (lo, mid)
    return lo


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = labels.where(~held)
    share = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    sample = common.labelled_sample(documents, labels, per_class, "toxic").where("text is not null")
    # copies of a text with the same label count once
    sample = common.persist(sample.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id")), "toxic-sample")
    back = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0
    own, other = _tally(sample.where(~back)), _tally(sample.where(back))
    if not all(own[0]):
        common.drop(sample)
        return Model()
    m = _fitted(*own)
    y, top, length, _ = _segments(sample.where(back), m)
    ok = (y == 0) & (length > 0) & (top > 0)
    if ok.sum() >= 20:  # Gumbel: the median of lambda S - ln(K n) is -ln ln 2
        m.k = float(np.clip(np.exp(np.median(m.lam * top[ok] - np.log(length[ok])) + math.log(math.log(2))), 1e-4, 10))
    y, _, _, ev = _segments(sample.where(back), m)
    common.drop(sample)
    full = _fitted(tuple(x + z for x, z in zip(own[0], other[0])), own[1] + other[1])
    full.k, (full.a, full.b) = m.k, _curve(ev, y, share)
    return full


def _tally(sample: DataFrame) -> tuple[tuple[int, int], np.ndarray]:
    """Texts of either class, and per bucket: clean texts, toxic texts, uses in clean text. At most 2**BITS rows reach the driver."""
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    out = np.zeros((3, 1 << BITS))
    t = _counts(sample).toArrow()
    out[:, t.column("token").to_numpy()] = [t.column(x).to_numpy() for x in ("clean", "toxic", "uses")]
    return (n.get(0, 0), n.get(1, 0)), out


def _fitted(n: tuple[int, int], counts: np.ndarray) -> Model:
    """Scores of all buckets, DRIFT below zero where fewer than three texts have a bucket, and lambda."""
    clean, toxic, uses = counts
    some = clean + toxic >= 3
    d, se = log_odds(clean[some], toxic[some], *n)
    scores = np.full(1 << BITS, -DRIFT)
    scores[some] += np.clip(np.sign(d) * np.maximum(np.abs(d) - CAUTION * se, 0), -CLIP, CLIP)
    return Model(scores, _lambda(uses / max(1.0, uses.sum()), scores))


def _segments(sample: DataFrame, m: Model) -> tuple[np.ndarray, ...]:
    """Per sampled row (bounded): label, top segment score, tokens, evidence."""
    shared = sample.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        m = shared.value
        for b in batches:
            lab = np.asarray(b.column(1))
            for c in common.chunks(b.column(0)):
                ev, segs, (_, _, lim) = score_chunk(c, m)
                top = np.array([max((s[2] for s in g), default=0.0) for g in segs])
                yield pa.RecordBatch.from_arrays([pa.array(lab[c.lo : c.hi], pa.float64()), pa.array(top, pa.float64()), pa.array(np.diff(lim), pa.float64()), pa.array(ev)], ["y", "top", "n", "ev"])

    got = sample.select("text", "label").mapInArrow(run, "y double, top double, n double, ev double").toArrow()
    return tuple(got.column(i).to_numpy() for i in range(4))


def _curve(ev: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic curve of the label on ln(1 + evidence), classes weighted to `share` of toxic ones.

    Labels are taken to be wrong at a rate of their own in each class, p = e0 + (1 - e0 - e1) sigmoid(a x + b), so that toxic
    labels on texts without any evidence don't flatten the curve. Gradient ascent with a weak prior.
    """
    mean = float(y.mean()) if len(y) else 0.0
    if not 0 < mean < 1:
        return 1.0, -2.0
    x, w = np.log1p(ev), np.where(y == 1, share / mean, (1 - share) / (1 - mean))
    prior = np.array([1.0, -2.0, -2.0, -2.0])
    c, v, sq = prior.copy(), np.zeros(4), np.zeros(4)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for k in range(1, 1501):
        t, e0, e1 = sig(c[0] * x + c[1]), MISLABELLED * sig(c[2]), MISLABELLED * sig(c[3])
        p = np.clip(e0 + (1 - e0 - e1) * t, 1e-9, 1 - 1e-9)
        d = w * (y - p) / (p * (1 - p))
        dt = d * (1 - e0 - e1) * t * (1 - t)
        g = np.array([(dt * x).sum(), dt.sum(), (d * (1 - t)).sum() * e0 * (1 - e0 / MISLABELLED), -(d * t).sum() * e1 * (1 - e1 / MISLABELLED)]) - 0.1 * (c - prior)
        v, sq = 0.9 * v + 0.1 * g, 0.99 * sq + 0.01 * g * g
        c = c + 0.02 * (v / (1 - 0.9**k)) / (np.sqrt(sq / (1 - 0.99**k)) + 1e-9)
    return max(float(c[0]), 0.0), float(c[1])


def score(df: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted[, segments array<struct<start,stop,score,p_value>>] in bytes of the text).

    Segments are the significant ones: maximal, and of a p-value within the text of at most SIGNIFICANT.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats
    schema = "doc_id bigint, score double" + (", segments array<struct<start:bigint,stop:bigint,score:double,p_value:double>>" if spans else "")

    def run(batches):
        m = shared.value
        for b in batches:
            for c in common.chunks(b.column(1)):
                ev, segs, (s, e, lim) = score_chunk(c, m)
                cols = [b.column(0).slice(c.lo, len(c)).cast(pa.int64()), pa.array(m.probability(ev))]
                if spans:
                    found = []
                    for i, g in enumerate(segs):
                        o, n = int(c.offs[i]), int(lim[i + 1] - lim[i])
                        rated = [(x, y, v, m.p_value(v, n)) for x, y, v in g]
                        found.append([{"start": int(s[lim[i] + x]) - o, "stop": int(e[lim[i] + y - 1]) - o, "score": v, "p_value": p} for x, y, v, p in rated if p <= SIGNIFICANT])
                    cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "segments"][: len(cols)])

    out = df.select("doc_id", "text").mapInArrow(run, schema)
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), *(["segments"] if spans else []))


def keep_documents(df: DataFrame, model: Model) -> DataFrame:
    """The rows of `df` (all columns) that aren't predicted toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            keep = [m.probability(score_chunk(c, m)[0]) < PREDICT_AT for c in common.chunks(b.column(at))]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")), spans=False)

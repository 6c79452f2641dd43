"""PII (operator 9): exact base patterns, and a semi-Markov CRF that adds spans.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers in whole texts with
linear scans. The CRF scores whole candidate segments: a segment is a run of digit groups (at most
`MAX_GROUPS`) or an address around an `@` or a spelled-out at, its features look at the entire span
(digits, groups and their lengths, separators, checksum, octets, brackets) and its surroundings, and
everything outside of candidates scores 0. Neighbouring segments also score by the pair of their types: a
chain links the segments of candidates that lie within `REACH` characters of each other, and begins anew
beyond. The dynamic program over segment ends and types therefore runs over chains and is exact for the
whole text. Viterbi chooses boundaries and types jointly; a span is added where its posterior is at least
`ADD_AT` and it overlaps no base span.

Training (`train`) maximises the conditional likelihood, by forward-backward over the same lattices, on
windows of a bounded sample of texts which the base patterns label: windows around their spans, and windows into
which seeded rewrites (spelled-out addresses, phone numbers without a plus, dotted cards and such) and
look-alikes (dates, versions, failing checksums) are put. Windows are cut on the executors; at most
`SAMPLE_WINDOWS` short ones reach the driver.

Defined cases: null and empty texts have no spans; positions count code points, ends are exclusive; equal
texts get equal spans, repeated rows a row each; of rows that share a doc_id the smallest text is in the
sample; an empty table gives no rows and a model that adds nothing; only doc_id and text (redact: and
n_chars) are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
ADD_AT, MAX_GROUPS, REACH = 0.95, 8, 40
#: Bounds of the training sample: texts, windows around or beside spans, and characters of a window.
SAMPLE_TEXTS, SAMPLE_WINDOWS, WINDOW_CHARS = 1000, 8000, 400

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(d: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(d)):
        v = ord(ch) - 48
        if i & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order of start and kind."""
    out = []
    at, last = t.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and t[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        m = _DOMAIN.match(t, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            last = m.end()
        at = t.find("@", max(at + 1, last))
    if _DIGIT.search(t):
        if "." in t:
            for m in _IP.finditer(t):
                if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.groups()):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                d = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# -- candidates and features -------------------------------------------------------------------

_RUN = re.compile(r"[0-9]+(?:(?:\[\.\]|[ ().\-/]{1,2})[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@|\s?[\[(]\s?at\s?[\])]\s?| at ", re.I)
_NAME_LEFT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\Z")
_HOST_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(\.|\s?[\[(]\s?dot\s?[\])]\s?| dot )[A-Za-z0-9-]{1,63}){1,6}", re.I)
_CUES = {"tel": 0, "phone": 0, "call": 0, "fax": 0, "mobile": 0, "telefon": 0, "teléfono": 0, "téléphone": 0, "card": 1, "visa": 1, "credit": 1, "karte": 1, "carte": 1, "tarjeta": 1, "mastercard": 1, "ip": 2, "host": 2, "server": 2, "address": 3, "email": 3, "mail": 3, "contact": 3}
_WORD = re.compile(r"([^\W\d_]+)\W*\Z")
DIM = 1 << 12
_index: dict[str, int] = {}


def _slot(name: str) -> int:
    k = _index.get(name)
    if k is None:
        k = _index[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % DIM
        if len(_index) > 100_000:
            _index.clear()
    return k


def _around(t: str, a: int, b: int) -> list[str]:
    def kind(ch: str) -> str:
        return "edge" if not ch else "digit" if ch.isdigit() else "letter" if ch.isalpha() else "space" if ch.isspace() else "punct" if ch in ".,;:!?)('\"" else "sign"

    m = _WORD.search(t, max(0, a - 24), a)
    cue = _CUES.get(m.group(1).lower()) if m else None
    return ["L" + kind(t[a - 1 : a]), "R" + kind(t[b : b + 1]), f"cue{cue}"]


def _has_at(t: str) -> bool:
    """Whether _AT can match, which ignores case."""
    return "@" in t or "at" in t.lower()


def candidates(t: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, feature slots) of the candidate segments of a text."""
    out = []
    for m in _AT.finditer(t) if _has_at(t) else ():
        left = _NAME_LEFT.search(t, max(0, m.start() - 64), m.start())
        right = _HOST_RIGHT.match(t, m.end())
        if not left or not right:
            continue
        a, b = left.start(), right.end()
        plain, dot = m.group() == "@", right.group(1).strip().lower()
        tld = re.split(r"\W+", right.group())[-1].lower()
        f = ["mail", "mail@" if plain else "mail at", "bracket" if m.group().strip()[:1] in "[(" else "open", f"dot {dot if dot in ('.', 'dot') else 'bracket'}", f"pair {plain} {dot}", "tld" if tld in ("com", "org", "net", "edu", "de", "fr", "es", "io", "info", "gov") else "no tld", *_around(t, a, b)]
        out.append((a, b, tuple(_slot("m:" + x) for x in f)))
    for m in _RUN.finditer(t):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(t, m.start(), m.end())]
        n = len(groups)
        for i in range(n):
            digits, lens = 0, []
            for j in range(i, min(n, i + MAX_GROUPS)):
                s, e = groups[j]
                digits += e - s
                lens.append(e - s)
                if digits > 20:
                    break
                if digits < 7 and not (j - i == 3):
                    continue
                a = groups[i][0]
                if t[a - 1 : a] == "(" and ")" in t[a:e]:
                    a -= 1
                if t[a - 1 : a] == "+":
                    a -= 1
                out.append((a, e, _number(t, a, e, digits, lens, i > 0, j < n - 1)))
    return out


def _number(t: str, a: int, b: int, digits: int, lens: list[int], more_left: bool, more_right: bool) -> tuple[int, ...]:
    s = t[a:b]
    seps = "".join(sorted(set(_GROUP.sub("", s))))
    shape = "-".join(map(str, lens))
    f = ["num", f"d{digits}", f"g{len(lens)}", f"sep{seps}", f"shape{shape}|{seps}", "plus" if s[0] == "+" else "no plus", f"ext{more_left}{more_right}"]
    if 14 <= digits <= 19:
        ok = luhn(_NOT_DIGIT.sub("", s))
        even = len(set(lens[:-1])) <= 1
        f += [f"luhn{ok}", f"luhn{ok}|even{even}|{'.' in seps}", f"luhn{ok}|g{min(len(lens), 5)}"]
    if len(lens) == 4:
        octets = [int(x) for x in _GROUP.findall(s)] if max(lens) <= 3 else [999]
        f += [f"oct{max(octets) <= 255}|{seps}"]
    f += _around(t, a, b)
    if s[0] != "+":
        f.append("bare " + f[-1])
    return tuple(_slot("n:" + x) for x in f)


# -- the model -----------------------------------------------------------------------------------


def _chains(cands, reach: int = REACH):
    """Groups of candidates, each within reach of those before it; each group ordered by end."""
    group, end = [], 0
    for c in sorted(cands, key=lambda c: (c[0], c[1])):
        if group and c[0] >= end + reach:
            yield sorted(group, key=lambda x: (x[1], x[0]))
            group = []
        end = max(end, c[1]) if group else c[1]
        group.append(c)
    if group:
        yield sorted(group, key=lambda x: (x[1], x[0]))


def _before(cl) -> list[int]:
    """For each candidate, how many others end at or before its start."""
    ends = [c[1] for c in cl]
    return np.searchsorted(ends, [c[0] for c in cl], "right").tolist()


def _posteriors(cl, s: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each (segment, type) of a chain, and expected uses of each pair of types.

    s: (n, types) scores; pair: (1 + types, types) scores of a type after another, row 0 after none. Forward weights
    f[k][t] cover the first k candidates with t the type of the last segment taken (0: none), backward weights the others.
    """
    n, kinds = s.shape
    pre = _before(cl)
    f = np.full((n + 1, 1 + kinds), -np.inf)
    f[0, 0] = 0.0
    into = np.empty((n, 1 + kinds, kinds))
    for k in range(n):
        into[k] = f[pre[k]][:, None] + pair + s[k]
        f[k + 1] = f[k]
        f[k + 1, 1:] = np.logaddexp(f[k, 1:], np.logaddexp.reduce(into[k], 0))
    g = np.full((n + 1, 1 + kinds), -np.inf)
    g[n] = 0.0
    for k in range(n - 1, -1, -1):
        g[k] = np.logaddexp(g[k], g[k + 1])
        j = pre[k]
        g[j] = np.logaddexp(g[j], np.logaddexp.reduce(pair + (s[k] + g[k + 1, 1:]), 1))
    uses = np.exp(into + g[1:, None, 1:] - np.logaddexp.reduce(f[n]))
    return uses.sum(1), uses.sum(0)


def _viterbi(cl, s: np.ndarray, pair: np.ndarray) -> list[tuple[int, int]]:
    """Best (candidate, type) choices of a chain."""
    n, kinds = s.shape
    pre = _before(cl)
    best = np.full((n + 1, 1 + kinds), -np.inf)
    best[0, 0] = 0.0
    back: list[list[int | None]] = [[None] * (1 + kinds)]  # type before where candidate k - 1 is taken, None where skipped
    for k in range(n):
        v = best[pre[k]][:, None] + pair + s[k]
        frm = v.argmax(0)
        v = v[frm, np.arange(kinds)]
        best[k + 1] = best[k]
        took = v > best[k, 1:]
        best[k + 1, 1:][took] = v[took]
        back.append([None, *(int(x) if y else None for x, y in zip(frm, took))])
    out, k, t = [], n, int(best[n].argmax())
    while k:
        if back[k][t] is None:
            k -= 1
        else:
            out.append((k - 1, t - 1))
            k, t = pre[k - 1], back[k][t]
    return out


def _scores(cl, w: np.ndarray) -> np.ndarray:
    return np.array([w[list(c[2])].sum(0) for c in cl])


class Model:
    def __init__(self, w: np.ndarray, pair: np.ndarray | None = None):
        self.w = w  # (DIM, types)
        self.pair = np.zeros((1 + w.shape[1], w.shape[1])) if pair is None else pair

    def spans(self, t: str, base: list[tuple[int, int, int]], add_at: float = ADD_AT) -> list[tuple[int, int, int]]:
        """Base spans and those that the CRF adds."""
        if not _DIGIT.search(t) and not _has_at(t):
            return base
        out, taken, most = list(base), [(a, b) for a, _, b in base], max(0.0, float(self.pair.max()))
        for cl in _chains(candidates(t)):
            near = [(a, b) for a, b in taken if a < cl[-1][1] and b > min(c[0] for c in cl)]
            if all(any(a < c[1] and c[0] < b for a, b in near) for c in cl):
                continue
            s = _scores(cl, self.w)
            if s.max() + most <= 0:
                continue
            p, _ = _posteriors(cl, s, self.pair)
            if p.max() < add_at:
                continue
            for k, kind in _viterbi(cl, s, self.pair):
                a, b, _ = cl[k]
                if p[k, kind] >= add_at and not any(x < b and a < y for x, y in near):
                    out.append((a, kind, b))
        return sorted(out)


def _rewrites(rng: random.Random) -> tuple[str, int | None]:
    """A string and its kind (None: a look-alike)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n: int = 16) -> str:
        s = rng.choice("3456") + d(n - 2)
        return s + next(x for x in "0123456789" if luhn(s + x))

    name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) + rng.choice(["", d(2), "." + d(1)])
    host = rng.choice(["mail", "example", "post", "firm"]) + rng.choice(["", d(1)])
    tld = rng.choice(["com", "org", "net", "de", "fr", "es"])
    oct_ = lambda: str(rng.randrange(256))
    four = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    pick = rng.randrange(24)
    if pick < 2:
        return name + rng.choice([" [at] ", "[at]", " (at) ", "(at)"]) + host + rng.choice([" [dot] ", " (dot) ", "."]) + tld, 0
    if pick < 3:
        return f"{name} at {host} dot {tld}", 0
    if pick < 6:
        return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.randrange(1, 99)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"1 ({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}"]), 3
    if pick < 9:
        s = card(rng.choice([16, 16, 15]))
        return rng.choice([s, four(s, "."), four(s, " "), four(s, "-")]), 2
    if pick < 11:
        return rng.choice([".", "[.]"]).join(oct_() for _ in range(4)), 1
    bad = card()
    bad = bad[:-1] + str((int(bad[-1]) + rng.randrange(1, 10)) % 10)
    return rng.choice([bad, four(bad, " "), four(bad, "-"), d(7), d(8), d(9), d(10), d(11), d(12), d(13), f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)}.{d(6)}", f"{d(4)} {d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"{rng.randrange(256, 999)}.{oct_()}.{oct_()}.{oct_()}", f"{d(3)} {d(3)} {d(3)}", f"{d(5)}-{d(4)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", "look at the dot", "at home", f"{d(20)}"]), None


def windows(t: str, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of a text with their labelled spans: around every span that the base finds, and four with rewrites put in."""
    rng, out = random.Random(seed), []
    base = base_spans(t)
    starts, ends = [x for x, _, _ in base], np.maximum.accumulate([y for _, _, y in base]).tolist() if base else []
    for a, _, b in base:
        lo, hi = max(0, a - 40), min(len(t), b + 40)
        i, j = int(np.searchsorted(ends, lo)), int(np.searchsorted(starts, hi))
        out.append((t[lo:hi], [(x - lo, kk, y - lo) for x, kk, y in base[i:j] if x >= lo and y <= hi]))
    at = t.find(" ", rng.randrange(len(t) or 1)) if t else -1
    if at < 0:
        return out
    lo = max(0, at - 40)
    for _ in range(4):
        # now and then two stand side by side, as in a line of contacts
        w, spans = t[lo : at + 1], []
        for _ in range(2 if rng.random() < 0.25 else 1):
            s, k = _rewrites(rng)
            w += rng.choice(["call ", "phone ", "card ", "mail ", "ip "]) if rng.random() < 0.1 else ""
            spans.append((len(w), k, len(w) + len(s)))
            w += s + rng.choice(["", ".", ","]) + " "
        w = w[:-1] + t[at : at + 40]
        put = [x for x in spans if x[1] is not None]
        out.append((w, sorted(put + [x for x in base_spans(w) if all(x[2] <= a or x[0] >= b for a, _, b in spans)])))
    return out


def training_set(texts: list[str], seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    return [x for k, t in enumerate(texts) for x in windows(t, seed * 1_000_003 + k)]


def fit(data, epochs: int = 10, rate: float = 0.3, l2: float = 3e-4) -> Model:
    """Adagrad on the conditional log-likelihood, chain by chain."""
    items, kinds = [], len(KINDS)
    for t, spans in data:
        gold = {(a, b): k for a, k, b in spans}
        for cl in _chains(candidates(t)):
            y, pairs, last, end = np.zeros((len(cl), kinds)), np.zeros((1 + kinds, kinds)), 0, -1
            for i, c in enumerate(cl):
                if (c[0], c[1]) in gold and c[0] >= end:
                    k = gold[c[0], c[1]]
                    y[i, k] = 1
                    pairs[last, k] += 1
                    last, end = 1 + k, c[1]
            items.append((cl, y, pairs, np.concatenate([c[2] for c in cl]).astype(np.int64), np.repeat(np.arange(len(cl)), [len(c[2]) for c in cl])))
    w, acc = np.zeros((DIM, kinds)), np.full((DIM, kinds), 1e-2)
    pair, pacc = np.zeros((1 + kinds, kinds)), np.full((1 + kinds, kinds), 1.0)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(items)):
            cl, y, pairs, slots, rows = items[i]
            s = np.zeros(y.shape)
            np.add.at(s, rows, w[slots])
            p, uses = _posteriors(cl, s, pair)
            d = (p - y)[rows]
            if np.abs(d).max() < 1e-3:
                continue
            g = d + l2 * w[slots]
            acc[slots] += g * g
            w[slots] -= rate * g / np.sqrt(acc[slots])
            g = uses - pairs + l2 * pair
            pacc += g * g
            pair -= rate * g / np.sqrt(pacc)
    return Model(w, pair)


def train(documents: DataFrame, n: int = SAMPLE_TEXTS, most: int = SAMPLE_WINDOWS) -> Model:
    """Fits on windows of at most n texts, those of smallest id hash (a bound that holds at every size)."""
    ids = documents.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(n)
    sample = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                got = [(w, json.dumps(x)) for w, x in windows(t or "", b.column(0)[i].as_py()) if len(w) <= WINDOW_CHARS]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*got)], ["w", "spans"])

    rows = sample.mapInArrow(run, "w string, spans string")
    got = rows.orderBy(F.xxhash64("w", "spans"), "w", "spans").limit(most).collect()
    return fit([(r[0], [tuple(x) for x in json.loads(r[1])]) for r in got])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts are of base spans."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM * types weights

    def run(batches):
        m = shared.value
        for b in batches:
            for c in common.chunks(b.column(1)):
                counts, shas, spans = [], [], []
                for i in range(len(c)):
                    t = c.text(i)
                    base = base_spans(t)
                    n = [0, 0, 0, 0]
                    for x in base:
                        n[x[1]] += 1
                    counts.append(n), shas.append(hashlib.sha256(joined(base).encode()).hexdigest()), spans.append(joined(m.spans(t, base)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, len(c)).cast(pa.int64()), *(pa.array([n[k] for n in counts], pa.int64()) for k in range(4)), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redact_text(t: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [t[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, t[at:]])


def redact(df: DataFrame, model: Model) -> DataFrame:
    """The rows of `df` with every span of `text` replaced by its kind in brackets (n_chars follows, if there)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            new = []
            for c in common.chunks(b.column(at)):
                for i in range(len(c)):
                    t = c.text(i)
                    new.append(redact_text(t, m.spans(t, base_spans(t))))
            col = pa.array([None if not ok else x for x, ok in zip(new, b.column(at).is_valid().to_pylist())], pa.string())
            yield b.set_column(at, b.schema.field(at).name, col)

    out = df.mapInArrow(run, df.schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*df.columns) if "n_chars" in df.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return find(docs, train(docs))

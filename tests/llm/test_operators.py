"""The training-data operators against brute force, exact round trips and held-out accuracy, with odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from weftline.llm import bpe, common, fingerprint, licenses, neardup, packing, pii, quality, toxicity, unigram, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b", "A b c", "a b c", "x " * 3000, "é中😀 'll's", "w" * 20000, "same text here and there", "same text here and there", "mail a.b@c.de or +1 (132) 555-1352", "Released under the MIT License."]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, extra columns with names the operators use inside."""
    rows = [(i, t, "x", 7, 1.0) for i, t in enumerate(ODD)] + [(3, "a", "x", 7, 1.0), (None, "text without an id", "x", 7, 1.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, n_words int, p double")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(n=200):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()]


def noise(alphabet, n, most, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(most))) for _ in range(n)]


# -- byte-level BPE


def test_bpe_equals_tiktoken_and_round_trips():
    import tiktoken

    e = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    all_ = texts(60) + noise("ab's t'rellvemd  \n\t é1٣²_!'’　中\U0001f600", 3000, 30) + ["", "a" * 5000, "'" * 99, " " * 99, "<|endoftext|>"]
    for t, ids in zip(all_, e.encode_texts(all_)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t)
        assert e.decode(ids) == t.encode()
        at = e.offsets(ids)
        assert at[-1] == len(t.encode()) and all(e.vocab[i] == t.encode()[a:b] for i, a, b in zip(np.frombuffer(ids, "<u4").tolist(), at, at[1:]))
    assert base64.b64decode("AA==") in e.ranks


def test_bpe_heap_merge_equals_short_merge():
    e = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    for t in [*noise("abcdethe ", 300, 47), *noise("aab", 100, 47), "a" * 47, "the" * 15]:
        if len(b := t.encode()) > 1:
            assert e._merge_heap(b, len(b)) == e._merge_short(b, len(b)), t


def test_bpe_odd(odd, empty):
    out = {(r["doc_id"], r["n_tokens"]): r for r in bpe.encode(odd, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert out[0, 0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert len(bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), ids=False).collect()) == len(ODD) + 2
    assert bpe.encode(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0


# -- quality


def brute_base(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cov = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov)]


def test_quality_base_counts():
    all_ = texts() + [x or "" for x in ODD] + noise("ab \n#", 500, 60)
    for c in common.chunks(pa.array(all_)):
        b = quality.base_counts(c)
        for i in range(len(c)):
            assert [int(b[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_base(all_[c.lo + i])


def test_quality_held_out():
    rows = duckdb.sql("SELECT text, quality FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    m = quality.fit(rows[:250], prior_weight=0.85)
    hit = n = 0
    for t, y in rows[250:]:
        c = next(common.chunks(pa.array([t])))
        w = common.words(c)
        b = quality.base_counts(c, w)
        kept = bool(~quality.base_failed(b)[0] and m.probabilities(quality.features(c, w[2], b["_h"]))[0] >= quality.KEEP_AT)
        hit, n = hit + (kept == (y == 1)), n + 1
    assert hit / n >= 0.9


def test_quality_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(k, "x" * n) for k, n in enumerate([10, 20, 30, 40, 500])], "doc_id bigint, text string")
    got = [len(r["text"]) for r in common.within_bytes(rows, 100, 11).collect()]
    assert sum(got) <= 100 and set(got) <= {10, 20, 30, 40, 500} and len(common.within_bytes(rows, 10_000, 11).collect()) == 5


def test_quality_odd(spark, odd, empty, labels):
    m = quality.train(odd, labels.where("false"))
    out = quality.score(odd, m).collect()
    assert len(out) == len(ODD) + 2 and all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 20)
    assert quality.score(empty, m).count() == 0 and quality.keep_documents(odd, m).columns == odd.columns


# -- toxicity


def test_maximal_segments_by_definition():
    def brute(s):
        """Repeatedly the best segment (shortest, leftmost of equals) of what is left."""

        def rec(a, b):
            best = None
            for i in range(a, b):
                for j in range(i + 1, b + 1):
                    v = round(sum(s[i:j]), 9)
                    if v > 0 and (best is None or (-v, j - i, i) < best[:3]):
                        best = (-v, j - i, i)
            if not best:
                return []
            v, n, i = best
            return [*rec(a, i), (i, i + n), *rec(i + n, b)]

        return rec(0, len(s))

    r = random.Random(5)
    for _ in range(300):
        s = [r.uniform(-3, 2) for _ in range(r.randrange(1, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(s))] == brute(s)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs.join(labels, "doc_id"), m, spans=False).where("held_out").join(labels, "doc_id").collect()
    clean = [r for r in got if r["toxic"] == 0]
    toxic = [r for r in got if r["toxic"] == 1]
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.02
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.8
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_toxicity_reports_significant_passages_only(spark):
    r = random.Random(6)
    word = lambda: "w%d" % r.randrange(300)
    bad = ["vile%d" % i for i in range(30)]
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(r.randrange(30, 200))]
        if i % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = r.choices(bad, k=12)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    for x in toxicity.score(docs, m).collect():
        text = rows[x["doc_id"]][1]
        assert x["predicted"] == labels[x["doc_id"]][1]
        for s in x["segments"]:
            assert s["p_value"] <= toxicity.SIGNIFICANT and text[s["start"] : s["stop"]].count("vile") >= 3
        assert bool(x["segments"]) == bool(x["predicted"])


def test_toxicity_counts_every_token_and_segment():
    n = 300_000  # more tokens than any list of them would keep
    h = toxicity.tokens(next(common.chunks(pa.array([" ".join("t%d" % i for i in range(n))], pa.large_string()), 1 << 30)))[0]
    scores = np.full(1 << toxicity.BITS, -1.0)
    scores[toxicity.bucket(h)] = 2.0
    assert (toxicity.Model(scores).token_scores(h) > 0).all()
    many, few = [9.0] * 500, [9.0] * 200
    assert toxicity.evidence(many, 1000, 1.0, 0.1) > toxicity.evidence(few, 1000, 1.0, 0.1)


def test_toxicity_takes_one_row_of_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1)], "doc_id bigint, toxic int")
    got = {(r["doc_id"], r["text"], r["label"]) for r in common.labelled_sample(docs, labels, 10, "toxic").collect()}
    assert got == {(1, "a", 0), (2, "c", 1)}


def test_toxicity_odd(odd, empty, labels, docs):
    none = toxicity.train(odd, labels.where("false"))
    assert {r["predicted"] for r in toxicity.score(odd, none).collect()} == {0}
    m = toxicity.train(docs, labels)
    assert toxicity.score(odd, m).count() == len(ODD) + 2 and toxicity.score(empty, m).count() == 0
    assert toxicity.keep_documents(odd, m).columns == odd.columns


# -- near-duplicates


def brute_links(rows):
    sets = {}
    for k, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    par = {k: k for k in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_neardup_equals_brute_force(spark):
    r = random.Random(8)
    base = [r.choices("abcdefghijklmnop", k=60) for _ in range(6)]
    rows = []
    for b in base:  # chains of edits, so that buckets hold texts that aren't linked to each other
        t = list(b)
        for _ in range(25):
            t = list(t)
            t[r.randrange(len(t))] = "w%d" % r.randrange(10**6)
            rows.append(" ".join(t))
            rows.append(" ".join(t).upper())
    rows = list(enumerate(rows + [x for x in ODD]))
    r.shuffle(rows)
    out = {x["doc_id"]: x for x in neardup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    exp = brute_links(rows)
    assert {k: (x["n_shingles"], x["component_id"]) for k, x in out.items()} == exp
    assert all(x["kept"] == (k == x["component_id"]) for k, x in out.items())


def test_neardup_odd(odd, empty):
    out = neardup.dedup(odd).collect()
    assert len(out) == len(ODD) + 2 and all(r["kept"] for r in out if r["doc_id"] is None)
    assert neardup.dedup(empty).count() == 0
    assert set(neardup.keep_documents(odd).columns) == set(odd.columns)


# -- the others


def test_unigram_equals_lattice_tokenizer():
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ref = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(32000)], unk_id=0, byte_fallback=True))
    k = unigram.counter(P.path("piece_bpe_32k.model"))
    for t in texts(60) + noise("the and ing  \n\n\té中😀xyZ.…ﬁ", 800, 40) + ["", "   ", "a" * 3000]:
        assert k.count(t) == (len(ref.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0)


def test_unigram_odd(odd, empty):
    path = P.path("piece_bpe_32k.model")
    assert {r["n_tokens"] for r in unigram.count_tokens(odd, path).where("doc_id in (0, 1)").collect()} == {0}
    assert unigram.count_tokens(empty, path).count() == 0


def test_warc_round_trip(spark):
    big = "p" * 150
    rows = [(5, "u5", big), (3, "u3", big), (9, "u\r\n9", big), (1, None, "short"), (2, "u2", "short"), (4, "u4", None), (6, "u6", ""), (7, "u7", "é" * 60), (8, "u8", "é" * 60), (8, "u8", "é" * 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    manifest = warc.write(warc.with_roles(pages), common.shared_dir(spark, "w"), file_bytes=600)
    for split in (100, 333, 1 << 20):
        out = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(manifest, split).collect())
        exp = []
        for k, _, h in rows:
            b = (h or "").encode()
            first = min(x[0] for x in rows if (x[2] or "").encode() == b)
            rev = len(b) >= 100 and k != first
            exp.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", first if rev else None))
        assert out == sorted(exp, key=lambda x: x[:4])
    assert warc.read(warc.write(warc.with_roles(pages.where("false")), common.shared_dir(spark, "w"))).count() == 0


def test_warc_long_payloads_and_odd_bytes(spark):
    """Members longer than several splits, incompressible ones, payloads that hold gzip members and WARC headers."""
    r = random.Random(9)
    inner = warc.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    rows = [(k, "u", t) for k, t in enumerate([noise("abcdefghij<>", 1, 2)[0] + "".join(r.choices("abcdefgh <>&", k=300_000)), "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20, inner.decode("latin-1"), "z" * 500_000, ""])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write(warc.with_roles(pages), common.shared_dir(spark, "w"), file_bytes=1 << 30)
    for split in (1000, 1 << 20):
        got = {x["page_id"]: (x["payload_bytes"], x["payload_digest"]) for x in warc.read(manifest, split).collect()}
        assert got == {k: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for k, _, t in rows}


class Bytes:
    def __init__(self, b):
        self.b = b

    def size(self):
        return len(self.b)

    def read_at(self, n, at):
        return self.b[at : at + n]


def test_warc_reader_validates_headers_and_raises_on_broken_members():
    import gzip

    one = warc.record(1, "u1", b"p" * 300, hashlib.sha256(b"p" * 300).hexdigest(), None)
    two = warc.record(2, "u2", b"q" * 300, hashlib.sha256(b"q" * 300).hexdigest(), None)
    junk = [b"\x1f\x8b\x08 no gzip", gzip.compress(b"WARC/1.1\r\nno colon here\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"), gzip.compress(b"something else"), gzip.compress(b"WARC/9\r\n\r\n")]
    whole = junk[0] + one + b"".join(junk[1:]) + two
    ids = lambda b, *at: [h["warc-record-id"] for _, h, _ in warc.members(Bytes(b), *at)]
    assert ids(whole, 0, len(whole)) == ["<urn:page:1>", "<urn:page:2>"]
    cuts = sorted(random.Random(1).sample(range(1, len(whole)), 12))
    assert [x for a, b in zip([0, *cuts], [*cuts, len(whole)]) for x in ids(whole, a, b)] == ["<urn:page:1>", "<urn:page:2>"]
    with pytest.raises(ValueError):
        ids(whole[:-20], 0, len(whole))
    with pytest.raises(ValueError, match="broken"):
        ids(one[:-30] + b"\0" * 30 + two, 0, 2000)


def test_warc_read_is_held_against_the_manifest(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id bigint, url string, html string")
    manifest = warc.write(warc.with_roles(pages), common.shared_dir(spark, "w"))
    with pytest.raises(ValueError, match="manifest"):
        warc.read(manifest.selectExpr("path", "bytes", "records + 1 as records"))


def test_licenses(spark, odd, empty):
    mit = licenses.TEMPLATES["MIT"][2]
    edited = mit.replace("free of charge,", "free of all charge,").replace("publish, ", "")
    rows = [(1, f"intro words é {edited} outro"), (2, "Licensed under CC BY-NC 4.0."), (3, "the license of a driver under review"), (4, f"{licenses.TEMPLATES['ISC'][0]} and then\nReleased under the MIT License.")]
    out = sorted((r["doc_id"], r["license"], rows[r["doc_id"] - 1][1][r["start"] : r["stop"]]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [x[:2] for x in out] == [(1, "MIT"), (2, "CC-BY-NC-4.0"), (4, "ISC"), (4, "MIT")]
    assert out[0][2].startswith("Permission") and out[0][2].endswith("Software") and out[1][2] == "Licensed under CC BY-NC 4.0"
    assert [r["license"] for r in licenses.scan(odd).collect()] == ["MIT"] and licenses.scan(empty).count() == 0


def test_fingerprints(spark, docs, odd, empty):
    v = fingerprint.vectors(["a b\nc d", "c d\na b", "a b", "c d", ""])
    assert (v[0] == v[1]).all() and ((v[2] + v[3]).astype(np.uint32) == v[0]).all() and not v[4].any() and (v[0] != v[2]).any()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    out = {r["doc_id"]: r for r in fingerprint.compare_next(docs, 5).collect()}
    assert len(out) == len(rows)
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert out[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and out[k]["n_chars"] == len(t)
        fe, ft, fn = fingerprint.vectors([e, t, n])
        assert out[k]["edited_fingerprint"] == fingerprint.printed(fe) and out[k]["fingerprint"] == fingerprint.printed(ft)
    assert np.mean([r["near_edited"] for r in out.values()]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in out.values()])
    assert fingerprint.compare_next(odd, 3).count() == len(ODD) + 2 and fingerprint.compare_next(empty, 3).count() == 0
    assert fingerprint.compare_next(odd.where("doc_id = 5"), 3).first()["near_next"] == 1.0


def brute_fingerprint(t):
    """Exact lanes and sketch of a text, paragraph by paragraph and word by word."""
    lanes, grams = [0] * fingerprint.EXACT, Counter()
    for line in t.split("\n"):
        w = WORD.findall(line)
        if w:
            d = hashlib.blake2b(line.strip(" \t\n\r\v\f").encode()).digest()
            lanes = [(x + int.from_bytes(d[4 * k : 4 * k + 4], "little")) % 2**32 for k, x in enumerate(lanes)]
            grams.update(zip([None, *w], w))
    return lanes, grams


def test_fingerprints_equal_brute_force():
    all_ = texts(80) + [x or "" for x in ODD] + noise("ab \n", 200, 60)
    v = fingerprint.vectors(all_)
    grams = []
    for t, x in zip(all_, v):
        lanes, g = brute_fingerprint(t)
        grams.append(g)
        assert x[: fingerprint.EXACT].tolist() == lanes and (np.abs(x[fingerprint.EXACT :].astype(np.int32)).sum() <= sum(g.values()))
    # likeness estimates the cosine of the 2-gram counts
    near = []
    for i in range(80):
        t = all_[i]
        e = fingerprint.edited(t, all_[(i + 1) % 80])
        g = brute_fingerprint(e)[1]
        true = sum(n * g[k] for k, n in grams[i].items()) / max(1e-9, (sum(n * n for n in grams[i].values()) * sum(n * n for n in g.values())) ** 0.5)
        near.append(abs(float(fingerprint.likeness(v[i : i + 1], fingerprint.vectors([e]))[0]) - true))
    assert np.mean(near) < 0.05 and max(near) < 0.3


def test_fingerprints_count_without_wrapping():
    v = fingerprint.vectors(["x " * 30_000, "x " * 40_000, "x " * 32_000])
    assert fingerprint.likeness(v[:1], v[1:2])[0] == pytest.approx(1) and fingerprint.likeness(v[:1], v[2:])[0] == pytest.approx(1)


def test_fingerprints_take_insertions_and_deletions():
    p = lambda t: fingerprint.printed(fingerprint.vectors([t])[0])
    assert fingerprint.insert(p("a b\nc"), ["d e", "c"]) == p("c\nd e\na b\nc")
    assert fingerprint.delete(p("a b\nc\nc"), ["c"]) == p("c\na b") and fingerprint.delete(p("x"), ["x"]) == p("")


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if lo <= len(d) <= hi and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_base_and_model(docs, odd, empty):
    for t in texts() + noise("a@b.c-1+ 23()9.@.x5%é", 5000, 60):
        assert pii.base_spans(t) == brute_pii(t)
    m = pii.fit(pii.training_set(texts()))
    tp = fp = fn = 0
    for t, spans in pii.training_set(texts(), seed=77):
        got = set(m.spans(t, []))
        tp, fp, fn = tp + len(got & set(spans)), fp + len(got - set(spans)), fn + len(set(spans) - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.9
    out = {r["doc_id"]: r for r in pii.find(odd, m).collect()}
    assert (out[12]["n_email"], out[12]["n_phone"]) == (1, 1) and out[0]["spans"] == "" and pii.find(empty, m).count() == 0
    red = pii.redact(odd, m)
    assert red.columns == odd.columns and red.where("doc_id = 12").first()["text"] == "mail [EMAIL] or [PHONE]" and red.where("doc_id = 0").first()["text"] is None


def test_semi_markov_inference_is_exact():
    """Posteriors, expected pairs and the best path of a chain equal those over all subsets of disjoint segments."""
    r = np.random.default_rng(2)
    for _ in range(40):
        cl = sorted([(int(a), int(a + r.integers(1, 5)), ()) for a in r.integers(0, 8, 5)], key=lambda x: (x[1], x[0]))
        s, pair = r.normal(size=(5, 4)), r.normal(size=(5, 4))
        z, best, marg, uses = 0.0, (-1.0, None), np.zeros((5, 4)), np.zeros((5, 4))
        for pick in np.ndindex(*(5,) * 5):
            used = [(k, t - 1) for k, t in enumerate(pick) if t]
            if any(cl[a][0] < cl[b][1] and cl[b][0] < cl[a][1] for i, (a, _) in enumerate(used) for b, _ in used[:i]):
                continue
            steps = list(zip([0, *(t + 1 for _, t in used)], [t for _, t in used]))
            v = sum(s[k, t] for k, t in used) + sum(pair[x] for x in steps)
            z += np.exp(v)
            if v > best[0] or best[1] is None:
                best = (v, sorted(used))
            for k, t in used:
                marg[k, t] += np.exp(v)
            for x in steps:
                uses[x] += np.exp(v)
        p, u = pii._posteriors(cl, s, pair)
        assert np.allclose(p, marg / z) and np.allclose(u, uses / z)
        assert sorted(pii._viterbi(cl, s, pair)) == best[1]


HAND = [
    ("Reach me at jane.roe [at] example [dot] org any day.", ["jane.roe [at] example [dot] org"]),
    ("fax (415) 555-2671 or ask", ["(415) 555-2671"]),
    ("his number: 212-555-0187.", ["212-555-0187"]),
    ("paid with 4111.1111.1111.1111 yesterday", ["4111.1111.1111.1111"]),
    ("host 10[.]0[.]3[.]77 was down", ["10[.]0[.]3[.]77"]),
    ("mail bob(at)firm.de, phone 030-555-1234", ["bob(at)firm.de", "030-555-1234"]),
    ("released on 2021-03-14 as version 3.11.4", []),
    ("order 4111 1111 1111 1112 of 1999", []),
    ("we met at noon and dot the i", []),
    ("page 12, lines 100-120, 3.5 percent of 20000", []),
]


def test_pii_on_cases_written_by_hand(spark, docs):
    m = pii.train(docs)
    for t, exp in HAND:
        assert [t[a:b] for a, _, b in m.spans(t, pii.base_spans(t))] == exp, t


def test_pii_training_reads_every_span_of_a_text():
    t = " and ".join("user%d@host%d.org" % (i, i) for i in range(50))
    assert sum("@" in w for w, _ in pii.windows(t, 1)) >= 50
    assert all(w[a:b].startswith("user") for w, s in pii.windows(t, 1)[:50] for a, k, b in s if k == 0 and not w[a:b][0].isdigit())


def test_packing(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = packing.tokens(P.path("word_bpe_49k.json"))
    special = ["hello <|endoftext|> world", "<|startoftext|>", "<|EndOfText|> a", "a<|endoftext|>b É", "<|endoftext|", "< |endoftext|>"]
    for x in texts(80) + special + noise("ab's 'LL't\t\n  éÉŸßÀ’—1²_!€İı中ΣſÅ", 2000, 25):
        assert np.frombuffer(own.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    out = packing.packed(docs).collect()
    by, seqs = defaultdict(dict), defaultdict(list)
    for r in out:
        by[r["doc_id"]][r["piece"]] = r
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        assert len(by[r["doc_id"]]) == -(-len(ids) // 4096)
        for p, x in by[r["doc_id"]].items():
            cut = ids[4096 * p : 4096 * (p + 1)]
            assert (x["start"], x["length"], x["ids_crc32"]) == (4096 * p, len(cut), zlib.crc32(cut.tobytes()))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and sum(x[1] for x in s) <= 4096
    assert len(seqs) <= -(-sum(r["length"] for r in out) // 4096) * 1.05 + 1
    assert packing.packed(odd).where("doc_id = 0").first()["length"] == 1 and packing.packed(empty).count() == 0


def test_sum_of_squares_rule():
    """Each placement has the smallest sum of squared open-bin counts of all that were possible."""
    r = random.Random(3)
    cap = 12
    items = [r.randrange(1, cap + 1) for _ in range(60)]
    bins, offs = packing.sum_of_squares(np.array(items), cap)
    level: dict = {}

    def cost(lv):
        return sum(v * v for v in Counter(cap - x for x in lv.values() if x < cap).values())

    for s, b, o in zip(items, bins.tolist(), offs.tolist()):
        options = [cost(level | {k: v + s}) for k, v in level.items() if v + s <= cap] + [cost(level | {-1: s})]
        assert level.get(b, 0) == o
        level[b] = o + s
        assert cost(level) == min(options)


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    q, t, m = quality.train(docs, labels), toxicity.train(docs, labels), None
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    keep = {r["doc_id"] for r in quality.score(docs, q).where("kept").collect()} & {r["doc_id"] for r in toxicity.score(docs, t).where("predicted = 0").collect()}
    rows = [x for x in rows if x[0] in keep]
    comp = brute_links(rows)
    rows = [x for x in rows if comp[x[0]][1] == x[0]]
    m = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    red = {k: pii.redact_text(x, m.spans(x, pii.base_spans(x))) for k, x in rows}
    own = packing.tokens(P.path("word_bpe_49k.json"))
    exp = {(k, p): zlib.crc32((own.ids(x) + b"\1\0\0\0")[16384 * p : 16384 * (p + 1)]) for k, x in red.items() for p in range(-(-(len(own.ids(x)) // 4 + 1) // 4096))}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in C.run(spark, DATA).collect()} == exp


def test_pipeline_stages_take_odd_tables(spark, odd, empty, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, a clashing extra column; and an empty table, through every stage."""
    import corpus_pipeline as C

    rows = [(i, t, "en", None if i % 3 else "s", len(t) if t else None, "x") for i, t in enumerate(ODD)] + [(3, "a", None, None, None, None), (None, " ".join(f"word{k}" for k in range(40)), None, None, None, None), (90, None, "en", "s", 1, "y")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, None, None), (8, None, 1)], "doc_id bigint, quality int, toxic int")
    d = str(tmp_path)
    for t in (table, table.where("false")):
        t.write.mode("overwrite").parquet(f"{d}/documents.parquet")
        labels.write.mode("overwrite").parquet(f"{d}/labels.parquet")
        for name, stage in C.STAGES:
            out = stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
            assert name == "packing" or out.columns == t.columns
            assert out.count() <= max(t.count() * 6, 0)
        got = C.run(spark, d)
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and (got.count() > 0) == (t.count() > 0)

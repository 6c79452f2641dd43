"""Token counts (operator 6): count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece in a segment; the dynamic program keeps, per
end position, the best score and the number of pieces on that path, and no back pointers. Ties follow
the tokenizer: starts are visited left to right and only a strictly better score replaces, so of equal
paths the one with the longest last piece stays. A character that no one-character piece covers may be
unknown, at the lowest score less 10, and counts as its UTF-8 bytes (byte fallback).

No piece has a space mark after another character, and none holds a line feed, so no path crosses those
places: the text falls into segments whose counts add up and are cached by their text.

Defined cases: null and empty texts count 0 tokens; repeated rows give a row each with equal counts; an empty
table gives no rows; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class Counter:
    CACHE = 250_000

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.unk = min(s for _, s in self.pieces) - 10.0
        self.auto = ahocorasick.Automaton()
        for p, s in self.pieces:
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.single = {p for p, _ in self.pieces if len(p) == 1}
        self.cache: dict[str, int] = {}
        bad = [p for p, _ in self.pieces if "\n" in p or (MARK in p.lstrip(MARK))]
        if bad:
            raise ValueError(f"pieces cross segment limits: {bad[:3]}")

    def segment(self, s: str) -> int:
        n = len(s)
        if self.single.issuperset(s):  # no unknown characters: every place can be reached
            top, count = [0.0] + [-1e300] * n, [0] * (n + 1)
            for end, (length, score) in self.auto.iter(s):
                a = end + 1 - length
                v = top[a] + score
                if v > top[end + 1]:
                    top[end + 1], count[end + 1] = v, count[a] + 1
            return count[n]
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done, unk, single = 0, self.unk, self.single

        def unknown(k: int) -> None:  # of all candidates that end at k, the one that starts last
            ch = s[k - 1]
            if ch not in single and best[k - 1] is not None:
                v = best[k - 1] + unk
                if best[k] is None or v > best[k]:
                    best[k], count[k] = v, count[k - 1] + len(ch.encode("utf-8"))

        for end, (length, score) in self.auto.iter(s):
            end += 1
            while done < end - 1:
                done += 1
                unknown(done)
            a = end - length
            if best[a] is not None:
                v = best[a] + score
                if best[end] is None or v > best[end]:
                    best[end], count[end] = v, count[a] + 1
        while done < n:
            done += 1
            unknown(done)
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a whole text (with the tokenizer's leading space mark)."""
        if not text:
            return 0
        cache, total = self.cache, 0
        for s in _SEGMENT.findall(MARK + text.replace(" ", MARK)):
            n = cache.get(s)
            if n is None:
                n = self.segment(s)
                if len(s) <= 64:
                    if len(cache) >= self.CACHE:
                        cache.clear()
                    cache[s] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_chars) of each row."""

    def run(batches):
        k = counter(path)
        for b in batches:
            for c in common.chunks(b.column(1)):
                texts = [c.text(i) for i in range(len(c))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, len(c)).cast(pa.int64()), pa.array([k.count(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    return df.select("doc_id", F.col("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

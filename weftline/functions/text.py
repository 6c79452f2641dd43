"""Lexical functions as column expressions; all but Jaro-Winkler stay inside the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"filter(split(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '$1 $2'), '^_[^_ ]+', ''), '[_ ]+'), x -> x <> '')"


_INNER = "(_|[a-z][A-Z])"


def _words_sql(text: str) -> str:
    return f"array_remove(split({text}, '[^A-Za-z0-9_]+'), '')"


def _split_sql(text: str) -> str:
    tokens = f"if(w rlike '{_INNER}', transform(array({_PARTS}), p -> if(size(p) > 1, concat(p, array(w)), p))[0], array(w))"
    return f"flatten(transform({_words_sql(text)}, w -> {tokens}))"


def tokenize_sql(text: str) -> str:
    """SQL of the identifier tokens of a text: its words, split at _ and lower-to-upper, each followed by the whole if split.

    Only words with such a place need the expressions that split, and most texts have none.
    """
    return f"if({text} rlike '{_INNER}', {_split_sql(text)}, {_words_sql(text)})"


def tokenize(text: str) -> Column:
    return F.expr(tokenize_sql(text))


def terms_sql(text: str) -> str:
    """Tokens in lower case, as the index keeps them."""
    plain = f"array_remove(split(lower(regexp_replace({text}, '[^A-Za-z0-9_]+', ' ')), ' '), '')"
    return f"if({text} rlike '{_INNER}', transform({_split_sql(text)}, t -> lower(t)), {plain})"


def path_stems_sql(path: str) -> str:
    """A path whose components are without their last extensions."""
    return rf"array_join(transform(split({path}, '/'), c -> regexp_replace(c, '\\.[^.]*$', '')), '/')"


def path_terms_sql(path: str) -> str:
    """Terms of each path component without its last extension."""
    return terms_sql(path_stems_sql(path))


def identifiers(text: str) -> Column:
    return F.expr(f"filter({tokenize_sql(text)}, t -> length(t) >= 2 and not t rlike '^[0-9]+$')")


def string_literals(text: str) -> Column:
    """Contents of double-quoted literals of 1 to 199 bytes; a backslash takes the next character with it."""
    found = rf"""regexp_extract_all({text}, '"((?:[^"\\\\]|\\\\[\\s\\S])*)"', 1)"""
    return F.expr(f"filter({found}, s -> octet_length(s) between 1 and 199)")


def doc_comments(text: str) -> Column:
    """Lines of /// comments and of /** */ blocks, without their marks, empty ones left out."""
    lines = rf"transform(filter(split({text}, '\n'), l -> l rlike '^\\s*///'), l -> trim(regexp_replace(l, '^\\s*/+', '')))"
    blocks = rf"flatten(transform(regexp_extract_all({text}, '/\\*\\*([\\s\\S]*?)\\*/', 1), b -> transform(split(b, '\n'), l -> trim(regexp_replace(l, '^\\s*\\*+', '')))))"
    return F.expr(f"filter(concat({lines}, {blocks}), l -> l <> '')")


def preview(text: str, n: int = 240) -> Column:
    return F.expr(rf"left(trim(regexp_replace({text}, '\\s+', ' ')), {n})")


def token_estimate(text: str) -> Column:
    return F.expr(f"octet_length({text}) div 4")


def normalize_type(t: str) -> Column:
    return F.expr(f"lower(replace(replace(replace(trim({t}), ' ', ''), '&mut', '&'), '&', ''))")


def types_compatible(a: str, b: str) -> Column:
    pair = lambda x, y: f"(contains({a}, '{x}') and contains({b}, '{y}')) or (contains({a}, '{y}') and contains({b}, '{x}'))"
    return F.expr(f"contains({a}, {b}) or contains({b}, {a}) or {pair('string', 'str')} or {pair('vec', 'slice')}")


def normalize_type_column(c: Column) -> Column:
    return F.lower(F.replace(F.replace(F.replace(F.trim(c), F.lit(" "), F.lit("")), F.lit("&mut"), F.lit("&")), F.lit("&"), F.lit("")))


def types_compatible_columns(a: Column, b: Column) -> Column:
    pair = lambda x, y: (a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))
    return a.contains(b) | b.contains(a) | pair("string", "str") | pair("vec", "slice")


def type_name(t: str) -> Column:
    """Leading type name of a text, or null where it is empty or starts in lower case."""
    base = rf"regexp_extract(split(regexp_replace(regexp_replace(trim({t}), '^&+', ''), '^(mut )+', ''), '<')[0], '^\\s*(\\S+)', 1)"
    return F.expr(f"case when {base} rlike '^[^a-z]' then {base} end")


def embedding_text(symbol: str, kind: str, file: str, doc: str, signature: str, parent: str) -> Column:
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c)))
    return F.concat_ws("\n", *(line(*x) for x in (("Symbol", symbol), ("Kind", kind), ("File", file), ("Documentation", doc), ("Signature", signature), ("Parent", parent))))


def parse_signature(text: str) -> dict | None:
    """Name, parameter types, return type and flags of a signature given as a query argument."""
    m = re.match(r"(?s).*?fn ([^(]*)\((.*)\)(.*)", text.strip()) if "fn " in text else None
    if not m:
        return None
    params = [p.rpartition(":")[2].strip() for p in m.group(2).rsplit(")", 1)[0].split(",") if p.strip()]
    head = text[: text.index("fn ")]
    ret = text.split("->", 1)[1].strip().rstrip("{ ").strip() if "->" in text else None
    return {"name": m.group(1).split("<")[0].strip(), "params": params, "return_type": ret, "is_async": "async" in head, "is_unsafe": "unsafe" in head}


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, left = [False] * m, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    k = len(left)
    if not k:
        return 0.0
    right = [b[j] for j in range(m) if used[j]]
    half = sum(x != y for x, y in zip(left, right)) / 2
    return (k / n + k / m + (k - half) / k) / 3


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}

    def one(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in seen:
            s = _jaro(x, y)
            p = next((i for i, (u, v) in enumerate(zip(x[:4], y[:4])) if u != v), min(len(x), len(y), 4))
            seen[x, y] = s + 0.1 * p * (1 - s) if s > 0.7 else s
        return seen[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity with the prefix bonus where it exceeds 0.7. Spark has no built-in."""
    return F.pandas_udf(_jaro_winkler, "double")(a, b)

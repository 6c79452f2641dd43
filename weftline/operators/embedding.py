"""Vectors of symbols: a pluggable embedder, upserts, and search by text.

The default embedder hashes words and character 3-grams into signed buckets, so that it needs no model and gives
the same vector everywhere. Any function from a pandas Series of texts to lists of floats can take its place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import fusion

DIM = 256


def hashed(texts: pd.Series) -> pd.Series:
    """Unit vectors of DIM floats; a text without words has the zero vector."""

    def one(t: str | None) -> list[float]:
        v = np.zeros(DIM, np.float32)
        for w in re.findall(r"\w+", re.sub(r"([a-z])([A-Z])", r"\1 \2", t or "").replace("_", " ").lower()):
            for part, weight in [(w, 1.0), *((f"#{w[k : k + 3]}", 0.3) for k in range(len(w) - 2))]:
                h = zlib.crc32(part.encode())
                v[h % DIM] += weight if h & 0x10000 else -weight
        n = float(np.sqrt((v * v).sum()))
        return (v / n if n else v).tolist()

    return pd.Series([one(t) for t in texts])


def embed(text: Column, embedder: Callable[[pd.Series], pd.Series] = hashed) -> Column:
    return F.pandas_udf(embedder, "array<float>")(text)


def build_index(symbols: DataFrame, embedder: Callable[[pd.Series], pd.Series] = hashed) -> DataFrame:
    """(id, embedding) of symbols (scoped_name, kind, file, doc_comment, signature, parent), one for each scoped name."""
    s = symbols.withColumn("_sig", F.when(F.col("signature").isNotNull(), F.concat(F.lit("("), F.array_join("signature.params", ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "signature.return_type"), F.lit("")))))
    t = s.select(F.col("scoped_name").alias("id"), T.embedding_text("scoped_name", "kind", "file", "doc_comment", "_sig", "parent").alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    return t.select("id", embed(F.col("text"), embedder).alias("embedding"))


def upsert(vectors: DataFrame, changed: DataFrame) -> DataFrame:
    """Vectors with rows of `changed` in place of those of the same id."""
    return remove(vectors, changed).unionByName(changed.select("id", "embedding"))


def remove(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    return vectors.select("id", "embedding").join(gone.select("id"), "id", "left_anti")


def search(vectors: DataFrame, queries: DataFrame, k: int, embedder: Callable[[pd.Series], pd.Series] = hashed) -> DataFrame:
    """(query_id, id, score) of the k nearest to each query (query_id, text); nothing where there are no vectors."""
    return fusion.nearest(vectors, queries.select("query_id", embed(F.col("text"), embedder).alias("qv")), k)

"""Dense retrieval, rank fusion and retrieval metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a block.
BLOCK = 1024


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two float arrays in double precision; 0 where either norm is 0."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p as double) * cast(q as double)), cast(0 as double), (s, v) -> s + v)"
    n = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return F.expr(f"case when {n} = 0 then 0.0 else {dot(a, b)} / {n} end")


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(keys, vectors): rows without a vector left out, the others in blocks of about BLOCK."""
    x = rows.where(f"{vector} is not null").select(key, vector)
    n = max(1, -(-x.count() // BLOCK))
    x = x.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(key, vector)).alias("_r"))
    return x.select(F.col(f"_r.{key}").alias(f"{key}s"), F.col(f"_r.{vector}").alias(f"{vector}s"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): for every query (query_id, qv) the k vectors (id, embedding) nearest to it.

    Exact: every block of queries is multiplied with every block of vectors, and of each product only the k
    best of a query go on. Scores are equal if they agree to 12 digits; ties follow id; a zero norm scores 0.
    """
    query_id, id_ = queries.schema["query_id"].dataType, vectors.schema["id"].dataType

    def run(batches):
        def unit(x):
            m = np.array(x, np.float64)
            n = np.sqrt((m * m).sum(1, keepdims=True))
            return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

        for b in batches:
            for r in range(b.num_rows):
                ids, vs, qids, qs = (b.column(c)[r].as_py() for c in range(4))
                ids, score = np.array(ids), np.round(unit(qs) @ unit(vs).T, 12)
                for q, row in zip(qids, score):
                    # all that tie with the k-th stay until ids decide
                    some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    top = some[np.lexsort((ids[some], -row[some]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(top), to_arrow_type(query_id)), pa.array(ids[top], to_arrow_type(id_)), pa.array(row[top])], ["query_id", "id", "score"])

    pairs = _blocks(vectors, "id", "embedding").crossJoin(_blocks(queries, "query_id", "qv"))
    best = pairs.mapInArrow(run, f"query_id {query_id.simpleString()}, id {id_.simpleString()}, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def binary(v: str) -> Column:
    """Signs of a float array as packed longs (dimension = 64 x longs; binary quantisation)."""
    return F.expr(f"transform(sequence(0, (size({v}) - 1) div 64), b -> aggregate(sequence(0, 63), 0L, (s, k) -> if(coalesce(get({v}, b * 64 + k), 0) > 0, s | shiftleft(1L, k), s)))")


def hamming(a: str, b: str) -> Column:
    """Differing bits of two arrays of packed longs (binary quantisation)."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")


@dataclass(frozen=True)
class Config:
    """What a hybrid search takes: how many of either side, how many stay, and how they are combined."""

    semantic_top_k: int = 50
    bm25_top_k: int = 50
    final_top_k: int = 10
    method: str = "rrf"
    semantic_weight: float = 0.4
    bm25_weight: float = 0.6
    k: float = 60.0


def hybrid(semantic: DataFrame, bm25: DataFrame, config: Config = Config()) -> DataFrame:
    """Reciprocal-rank fusion, or weighted where the configuration says so."""
    if config.method == "rrf":
        return rrf(semantic, bm25, config.k, config.semantic_weight, config.bm25_weight, config.final_top_k)
    if config.method == "weighted":
        return weighted(semantic, bm25, config.semantic_weight, config.bm25_weight, config.final_top_k)
    raise ValueError(f"unknown method {config.method}")


def _one_query(df: DataFrame) -> DataFrame:
    return df if "query_id" in df.columns else df.withColumn("query_id", F.lit(0))


def _best(df: DataFrame, top: int, keep_query: bool) -> DataFrame:
    """The best `top` of every query."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).drop("_k")
    return out if keep_query else out.drop("query_id")


def _ranked(df: DataFrame, name: str) -> DataFrame:
    # lists are of a query each, so a window holds no more than one search gives
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return _one_query(df).select("query_id", "id", F.col("score").alias(f"{name}_score"), (F.row_number().over(w) - 1).alias(f"{name}_rank"))


def _found(sem: str, bm: str) -> Column:
    return F.when(F.col(sem).isNotNull() & F.col(bm).isNotNull(), "both").when(F.col(sem).isNotNull(), "semantic_only").otherwise("bm25_only")


def rrf(semantic: DataFrame, bm25: DataFrame, k: float = 60.0, w_sem: float = 0.4, w_bm: float = 0.6, top: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two lists ([query_id,] id, score), for every query on its own."""
    j = _ranked(semantic, "sem").join(_ranked(bm25, "bm"), ["query_id", "id"], "full_outer")
    part = lambda r, w: F.coalesce(w / (F.lit(k) + F.col(r) + 1), F.lit(0.0))
    j = j.select("query_id", "id", (part("sem_rank", w_sem) + part("bm_rank", w_bm)).alias("score"), _found("sem_rank", "bm_rank").alias("found_by"))
    return _best(j, top, "query_id" in semantic.columns)


def weighted(semantic: DataFrame, bm25: DataFrame, w_sem: float = 0.4, w_bm: float = 0.6, top: int = 10) -> DataFrame:
    """Weighted fusion; a query's BM25 scores are divided by their maximum, 0 where that isn't positive."""
    most = F.max("score").over(W.partitionBy("query_id"))
    b = _one_query(bm25).withColumn("most", most).select("query_id", "id", F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0).alias("bm"))
    j = _one_query(semantic).select("query_id", "id", F.col("score").alias("sem")).join(b, ["query_id", "id"], "full_outer")
    j = j.select("query_id", "id", (w_sem * F.coalesce("sem", F.lit(0.0)) + w_bm * F.coalesce("bm", F.lit(0.0))).alias("score"), _found("sem", "bm").alias("found_by"))
    return _best(j, top, "query_id" in semantic.columns)


def metrics(ranked: DataFrame, relevant: DataFrame, k: int, nothing: float | None = 0.0) -> DataFrame:
    """(precision, recall, mrr, ndcg) of a ranked list (id, rank from 1) against relevant ids.

    Precision divides by k, not by what was returned; the ideal list is as long as the shorter of both. `nothing` stands for what is
    undefined: all of an empty list, recall and ndcg where no id is relevant, mrr where no relevant id is in the list.
    """
    nothing = F.lit(nothing).cast("double")
    r = ranked.join(relevant.select("id").distinct().withColumn("rel", F.lit(1)), "id", "left").fillna(0, ["rel"])
    got = r.agg(F.count("*").alias("n"), F.sum("rel").alias("hits"), F.sum(F.when(F.col("rank") <= k, F.col("rel"))).alias("at_k"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    x = got.crossJoin(F.broadcast(relevant.agg(F.countDistinct("id").alias("nrel"))))
    ideal = F.expr("aggregate(transform(sequence(1, cast(greatest(least(nrel, n), 1) as int)), i -> 1 / log2(i + 1)), cast(0 as double), (s, v) -> s + v)")
    return x.select(F.coalesce(F.col("at_k") / k, nothing).alias("precision"), F.coalesce(F.expr("try_divide(hits, nrel)"), nothing).alias("recall"), F.coalesce(1 / F.col("first"), nothing).alias("mrr"), F.when(F.least("nrel", "n") > 0, F.col("dcg") / ideal).otherwise(nothing).alias("ndcg"))

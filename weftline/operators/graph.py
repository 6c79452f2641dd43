"""Fixpoints over edge tables: reachability and PageRank; lookups on symbols and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, shared_dir


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) reachable from roots (id) along edges (src, dst), roots included.

    One round per level; only the frontier joins the edges. Levels are written below one folder, so that what has been
    seen is one table whose plan doesn't grow.
    """
    spark, path = roots.sparkSession, shared_dir(roots.sparkSession, "reach")
    schema = f"id {roots.schema['id'].dataType.simpleString()}, level int"
    roots.select("id").distinct().write.parquet(f"{path}/level=0")
    k = 0
    while True:
        seen = spark.read.schema(schema).parquet(path)
        frontier = seen.where(F.col("level") == k)
        if not frontier.limit(1).count():
            return seen.select("id")
        step = frontier.join(edges, frontier.id == edges.src).select(F.col("dst").alias("id")).distinct()
        k += 1
        step.join(seen.select("id"), "id", "left_anti").write.parquet(f"{path}/level={k}")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """(id, score). Nodes without out-edges drop their share; parallel edges count. tol 0 runs all iterations."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    # parallel edges become one with its share, so each round aggregates over distinct edges
    share = materialize(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")), "pr-edges")
    score = nodes.select("id", F.lit(1.0 / n).alias("score"))
    for i in range(max_iter):
        gained = share.join(score.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("g"))
        nxt = score.withColumnRenamed("score", "old").join(gained, "id", "left").select("id", "old", (F.lit((1 - damping) / n) + damping * F.coalesce("g", F.lit(0.0))).alias("score"))
        if tol or i % 5 == 4:
            nxt = materialize(nxt, "pr")
        if tol and nxt.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < tol:
            return nxt.select("id", "score")
        score = nxt.select("id", "score")
    return score


def last_write_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row per key, that of highest seq; a combined aggregate, so hot keys cost no sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*key, "_r.*")


def find_by_name(symbols_raw: DataFrame, name: str) -> DataFrame:
    """Bag semantics: one row per definition of the name, each with the surviving row of its scoped name."""
    kept = last_write_wins(symbols_raw, ["scoped_name"], "seq")
    return symbols_raw.where(F.col("name") == name).select("scoped_name").join(kept, "scoped_name")


def get_symbol(symbols_raw: DataFrame, scoped_name: str) -> DataFrame:
    """The surviving row of a scoped name."""
    return last_write_wins(symbols_raw.where(F.col("scoped_name") == scoped_name), ["scoped_name"], "seq")


def symbol_report(symbols_raw: DataFrame, text: str, scoped: bool = False, limit: int = 20) -> DataFrame:
    """What a symbol lookup prints: by name or by scoped name, at most `limit` rows in order of file and place."""
    found = get_symbol(symbols_raw, text) if scoped else find_by_name(symbols_raw, text)
    return found.orderBy("file", "start_byte", "scoped_name").limit(limit)


def symbols_of_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file") == file)


def find_tests(symbols: DataFrame) -> DataFrame:
    """Symbols named test_... or with an attribute that says test."""
    return symbols.where(F.col("name").startswith("test_") | F.coalesce(F.exists("attributes", lambda a: a.contains("test")), F.lit(False)))


def callers(edges: DataFrame, callee: str) -> DataFrame:
    return edges.where(F.col("callee_name") == callee)


def callees(edges: DataFrame, caller: str) -> DataFrame:
    return edges.where(F.col("caller") == caller)


def callees_of_name(symbols_raw: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The calls of every definition of a name; a definition that is there twice gives its calls twice."""
    defs = symbols_raw.where(F.col("name") == name).select(F.col("scoped_name").alias("caller"))
    return defs.join(edges, "caller")


def call_graph(symbols_raw: DataFrame, edges: DataFrame, name: str, direction: str = "callers") -> DataFrame:
    """(caller, callee_name, file, start_line) of the calls of a name or from it."""
    if direction not in ("callers", "callees"):
        raise ValueError(f"unknown direction {direction}")
    found = callers(edges, name) if direction == "callers" else callees_of_name(symbols_raw, edges, name)
    return found.select("caller", "callee_name", "file", "start_line")


def resolve_callees(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, scoped_name): for each name its first public definition, else its first."""
    own = symbols.join(names.select("name").distinct(), "name", "left_semi")
    return own.groupBy("name").agg(F.min_by("scoped_name", F.struct((F.col("visibility") != "public").cast("int"), "seq")).alias("scoped_name"))


def first_per_group(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key and how many more there are."""
    w = W.partitionBy(key)
    return rows.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - n, F.lit(0))).where(F.col("position") <= n)

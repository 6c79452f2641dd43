"""Module topology: containment, import edges, and what PageRank is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import graph


def containment(files: DataFrame, module_file: str = "mod.rs") -> DataFrame:
    """(parent, child) edges: a file belongs to the nearest ancestor folder with a module file, modules nest alike, the rest to 'root'."""
    dirs = files.where(F.col("file").endswith("/" + module_file)).select(F.expr(f"left(file, length(file) - {len(module_file) + 1})").alias("dir")).distinct()
    nodes = files.select(F.col("file").alias("child"), F.col("file").alias("from")).unionByName(dirs.select(F.concat(F.lit("module:"), "dir").alias("child"), F.col("dir").alias("from")))
    # every proper ancestor of a path, with its depth
    up = nodes.select("child", F.posexplode(F.expr("transform(sequence(1, greatest(size(split(from, '/')) - 1, 1)), n -> array_join(slice(split(from, '/'), 1, n), '/'))")).alias("depth", "dir"), "from").where("dir <> from")
    best = up.join(dirs, "dir").groupBy("child").agg(F.max_by("dir", "depth").alias("dir"))
    return nodes.select("child").join(best, "child", "left").select(F.coalesce(F.concat(F.lit("module:"), "dir"), F.lit("root")).alias("parent"), "child")


def nodes(files: DataFrame, root: str, module_file: str = "mod.rs") -> DataFrame:
    """(id, node_type, name, node_seq): the crate, then every file in order of path, each followed by the modules it is the first in, innermost first.

    node_seq is a struct that sorts in this order, so that no row needs to be numbered.
    """
    seq = lambda f, k, d: F.struct(f.alias("f"), k.cast("int").alias("k"), d.cast("int").alias("d"))
    crate = files.sparkSession.range(1).select(F.lit("root").alias("id"), F.lit("crate").alias("node_type"), F.lit(root).alias("name"), seq(F.lit(""), F.lit(0), F.lit(0)).alias("node_seq"))
    f = files.select("file").distinct()
    own = f.select(F.col("file").alias("id"), F.lit("file").alias("node_type"), F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"(.)\.[^.]*$", "$1").alias("name"), seq(F.col("file"), F.lit(0), F.lit(0)).alias("node_seq"))
    dirs = f.where(F.col("file").endswith("/" + module_file)).select(F.expr(f"left(file, length(file) - {len(module_file) + 1})").alias("dir"))
    up = f.select("file", F.explode(F.expr("transform(sequence(1, greatest(size(split(file, '/')) - 1, 1)), n -> array_join(slice(split(file, '/'), 1, n), '/'))")).alias("dir")).where("dir <> file")
    first = up.join(dirs, "dir").groupBy("dir").agg(F.min("file").alias("first"))
    mods = first.select(F.concat(F.lit("module:"), "dir").alias("id"), F.lit("module").alias("node_type"), F.regexp_extract("dir", "([^/]*)$", 1).alias("name"), seq(F.col("first"), F.lit(1), -F.size(F.split("dir", "/"))).alias("node_seq"))
    return crate.unionByName(own).unionByName(mods)


def import_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): each import goes to the first node (node_seq) whose name its path holds; nodes (id, node_type, name, node_seq).

    Distinct paths are resolved once. Module names and file stems match anywhere, the crate's at the start. Names
    are looked up by the path's substrings of the lengths that names have, an equality join in place of a
    comparison of every path with every name.
    """
    named = nodes.where(F.length("name") > 0)
    lengths = sorted(r[0] for r in named.select(F.length("name").alias("n")).distinct().collect())  # no more than the longest name is long
    paths = imports.select("path").distinct()
    parts = paths.select("path", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where("length(path) >= n")
    parts = parts.select("path", "n", F.explode(F.expr("sequence(1, length(path) - n + 1)")).alias("at")).select("path", F.expr("substring(path, at, n)").alias("name"), (F.col("at") == 1).alias("start"))
    parts = parts.groupBy("path", "name").agg(F.max("start").alias("start"))
    found = parts.join(named, "name").where("node_type <> 'crate' or start").groupBy("path").agg(F.min_by("id", "node_seq").alias("dst"))
    return imports.join(found, "path").select(F.col("file").alias("src"), "dst")


@dataclass
class Topology:
    nodes: DataFrame
    edges: DataFrame
    scores: DataFrame


def build(files: DataFrame, imports: DataFrame, root: str) -> Topology:
    """Nodes, containment and import edges (src, dst, kind), and PageRank over both kinds."""
    n = materialize(nodes(files, root), "topology-nodes")
    contains = containment(files).select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit("contains").alias("kind"))
    e = materialize(contains.unionByName(import_edges(imports, n).withColumn("kind", F.lit("imports"))), "topology-edges")
    return Topology(n, e, graph.pagerank(n.select("id"), e.select("src", "dst")))


def add_file(t: Topology, file: str, root: str) -> DataFrame:
    """The nodes with one more file; nothing changes where it is there."""
    spark = t.nodes.sparkSession
    files = t.nodes.where("node_type = 'file'").select(F.col("id").alias("file")).unionByName(spark.createDataFrame([(file,)], "file string"))
    return nodes(files, root)


def remove_file(t: Topology, file: str) -> Topology:
    """Nodes and edges without a file."""
    gone = F.col("id") == file
    return Topology(t.nodes.where(~gone), t.edges.where((F.col("src") != file) & (F.col("dst") != file)), t.scores.where(~gone))


def modules(t: Topology) -> DataFrame:
    return t.nodes.where("node_type = 'module'").select("id", "name")


def top_nodes(scores: DataFrame, n: int = 20) -> DataFrame:
    """(id, score as text of four decimals), best first."""
    return scores.orderBy(F.desc("score"), "id").limit(n).select("id", F.format_string("%.4f", "score").alias("score"))


def dependencies(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst")


def top_files(scores: DataFrame, files: DataFrame, n: int = 20) -> DataFrame:
    return scores.join(files.select(F.col("file").alias("id")), "id", "left_semi").orderBy(F.desc("score"), "id").limit(n)

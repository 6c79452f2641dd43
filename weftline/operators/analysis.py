"""Dead code, coverage, churn, incremental diffs, naming and duplication checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .graph import reachable


def entry_points(symbols: DataFrame) -> DataFrame:
    test = F.exists("attributes", lambda a: a.contains("test"))
    return symbols.where(((F.col("name") == "main") & (F.col("kind") == "function")) | test | F.col("visibility").isin("public", "crate") | (F.col("kind") == "impl"))


def reached(roots: DataFrame, symbols: DataFrame, calls: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(id) that calls (caller, callee_name) and edges `more` (src, dst) reach from roots, which are included.

    A name is a node between its callers and its definitions, so a name of many of both costs their sum. Repeated calls need not be
    made distinct first, as what a level reaches is.
    """
    named = lambda c: F.struct(F.lit(True).alias("name"), F.col(c).alias("id"))
    plain = lambda c: F.struct(F.lit(False).alias("name"), F.col(c).alias("id"))
    edges = calls.select(plain("caller").alias("src"), named("callee_name").alias("dst")).unionByName(symbols.select(named("name").alias("src"), plain("scoped_name").alias("dst")))
    if more is not None:
        edges = edges.unionByName(more.select(plain("src").alias("src"), plain("dst").alias("dst")))
    return reachable(roots.select(plain("scoped_name").alias("id")), materialize(edges, "call-edges")).where("not id.name").select("id.id")


def dead_symbols(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols (scoped_name, name, kind, visibility, attributes, parent) that no entry point reaches, without modules, fields and variants."""
    live = reached(entry_points(symbols), symbols, calls, symbols.where("parent is not null").select(F.col("scoped_name").alias("src"), F.col("parent").alias("dst")))
    return symbols.join(live, symbols.scoped_name == live.id, "left_anti").where(~F.col("kind").isin("module", "field", "variant"))


def potentially_live(unreached: DataFrame) -> DataFrame:
    kept = F.exists("attributes", lambda a: a.rlike("derive|macro|no_mangle|export_name|link_name|used"))
    return unreached.where(kept | F.col("kind").isin("const", "static", "macro"))


def dead_report(dead: DataFrame, n: int = 50) -> tuple[int, list]:
    """Number of dead symbols and the first n in order of scoped name."""
    return dead.count(), dead.orderBy("scoped_name").limit(n).collect()


def correlate_coverage(symbols: DataFrame, lines: DataFrame, branches: DataFrame | None = None) -> DataFrame:
    """(symbol, lines_total, lines_covered, coverage[, branches_total, branches_covered, branch_coverage]) by range joins on file.

    Lines are reduced to one row per (file, line) first; a line both covered and uncovered counts as covered. A symbol stays if
    any total is above 0; shares of nothing are 0.
    """
    once = lines.groupBy("file", "line").agg(F.max(F.col("covered").cast("int")).cast("bigint").alias("lines_covered")).withColumn("lines_total", F.lit(1).cast("bigint"))
    measures = ["lines_total", "lines_covered"]
    if branches is not None:
        b = branches.groupBy("file", "line").agg(F.sum("total").alias("branches_total"), F.sum("covered").alias("branches_covered"))
        measures += ["branches_total", "branches_covered"]
        once = once.join(b, ["file", "line"], "full_outer").fillna(0, measures)
    s = symbols.where("start_line > 0 and end_line > 0")
    j = s.join(once, (s.file == once.file) & once.line.between(s.start_line, s.end_line)).groupBy("symbol").agg(*(F.sum(m).alias(m) for m in measures))
    j = j.where(" + ".join(m for m in measures if m.endswith("total")) + " > 0")
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    j = j.withColumn("coverage", share("lines_covered", "lines_total"))
    return j if branches is None else j.withColumn("branch_coverage", share("branches_covered", "branches_total"))


def _llvm_files(report: DataFrame) -> DataFrame:
    """(filename, segments, branches) of report rows (value string); of a file that is there twice the last counts.

    Segments and branches may be objects or arrays in the order of their fields.
    """
    x = report.select(F.from_json("value", "struct<data:array<struct<files:array<struct<filename:string,segments:array<string>,branches:array<string>>>>>>").alias("r"))
    x = x.select(F.posexplode("r.data").alias("i", "d")).select("i", F.posexplode("d.files").alias("j", "f"))
    return x.groupBy("f.filename").agg(F.max_by(F.struct("f.segments", "f.branches"), F.struct("i", "j")).alias("f")).select("filename", "f.segments", "f.branches")


def _fields(names: list[tuple[str, str]]) -> Column:
    """A struct of the fields of JSON text `s`, object or array."""
    return F.struct(*(F.coalesce(F.get_json_object("s", f"$.{n}"), F.get_json_object("s", f"$[{k}]")).cast(t).alias(n) for k, (n, t) in enumerate(names)))


def llvm_lines(report: DataFrame) -> DataFrame:
    """(file, line, covered) of LLVM coverage JSON rows (value string)."""
    own = _fields([("line", "bigint"), ("col", "bigint"), ("count", "bigint"), ("has_count", "boolean"), ("is_region_entry", "boolean")])
    f = _llvm_files(report).select("filename", F.explode("segments").alias("s")).select("filename", own.alias("s"))
    return f.where("s.line > 0 and s.has_count and s.is_region_entry").groupBy(F.col("filename").alias("file"), F.col("s.line").alias("line")).agg((F.max("s.count") > 0).alias("covered"))


def llvm_branches(report: DataFrame) -> DataFrame:
    """(file, line, covered, total): branches of each line, and those that were taken."""
    own = F.struct(F.coalesce(F.get_json_object("s", "$.line"), F.get_json_object("s", "$[0]")).cast("bigint").alias("line"), F.coalesce(F.get_json_object("s", "$.covered"), F.get_json_object("s", "$.count"), F.get_json_object("s", "$[4]")).alias("hit"))
    f = _llvm_files(report).select("filename", F.explode("branches").alias("s")).select("filename", own.alias("s")).where("s.line > 0")
    hit = F.when(F.lower("s.hit").isin("true", "false"), (F.lower("s.hit") == "true").cast("bigint")).otherwise(F.expr("try_cast(s.hit as bigint)"))
    return f.groupBy(F.col("filename").alias("file"), F.col("s.line").alias("line")).agg(F.sum(F.least(F.coalesce(hit, F.lit(0)), F.lit(1))).alias("covered"), F.count("*").alias("total"))


def tarpaulin_lines(report: DataFrame) -> DataFrame:
    x = report.select(F.explode(F.map_values(F.from_json("value", "struct<files:map<string,struct<path:string,covered:array<bigint>,uncovered:array<bigint>>>>")["files"])).alias("f"))
    part = lambda c, v: x.select(F.col("f.path").alias("file"), F.explode(f"f.{c}").alias("line"), F.lit(v).alias("covered"))
    return part("covered", True).unionByName(part("uncovered", False))


def churn(commits: DataFrame) -> DataFrame:
    """(path, commits, authors, lines_added, lines_removed, last_modified) of rows (path, author, date, added, removed); '-' counts nothing."""
    n = lambda c: F.coalesce(F.sum(F.expr(f"try_cast({c} as bigint)")), F.lit(0))
    return commits.groupBy("path").agg(F.count("*").alias("commits"), F.array_join(F.sort_array(F.collect_set("author")), ",").alias("authors"), n("added").alias("lines_added"), n("removed").alias("lines_removed"), F.max("date").alias("last_modified"))


def changed_files(commits: DataFrame, since: Column) -> DataFrame:
    """(path) of the files changed after a moment; rows (path, ts)."""
    return commits.where(F.col("ts") > since).select("path").distinct()


def hotspots(files: DataFrame, more_than: int = 3) -> DataFrame:
    return files.where(F.col("commits") > more_than)


def fingerprint_diff(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(file, status): skipped where time and size are equal, else changed or removed."""
    m = manifest.select("file", F.struct("mtime_ms", "size_bytes").alias("old"))
    c = current.select("file", F.struct("mtime_ms", "size_bytes").alias("new"))
    return m.join(c, "file", "full_outer").select("file", F.when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "skipped").otherwise("changed").alias("status"))


def index_report(diff: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return diff.agg(F.count_if(F.col("status") != "removed").alias("total"), n("changed").alias("parsed"), n("skipped").alias("skipped"), n("removed").alias("removed"))


def prune(docs: DataFrame, diff: DataFrame) -> DataFrame:
    return docs.join(diff.where("status <> 'skipped'").select("file"), "file", "left_anti")


def name_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def _severity(level: str, score: Column) -> Column:
    return F.struct(F.lit(level).alias("severity"), score.cast("double").alias("score"))


def naming_conflicts(symbols: DataFrame, name: str) -> DataFrame:
    """(symbol, severity, score) against symbols (symbol, name) of one file."""
    d, most = F.levenshtein("name", F.lit(name)), F.greatest(F.octet_length("name"), F.lit(len(name.encode())))
    other = F.col("name") != name
    x = symbols.select("symbol", F.array(F.when(~other, _severity("block", F.lit(1.0))), F.when(other & (d <= 2) & (most > 3), _severity("warning", 1 - d / most)), F.when(other & (F.lower("name") == name.lower()), _severity("warning", F.lit(0.95)))).alias("c"))
    return x.select("symbol", F.explode(F.filter("c", lambda v: v.isNotNull())).alias("v")).select("symbol", "v.severity", "v.score")


def check_name(symbols: DataFrame, imports: DataFrame, name: str, file: str) -> DataFrame:
    """naming_conflicts within a file of symbols (symbol, name, file), and imports (file, path, name) of the same name; nothing for a file without symbols."""
    own = symbols.where(F.col("file") == file)
    found = naming_conflicts(own, name)
    known = own.limit(1).select(F.lit(True).alias("_known"))
    taken = imports.where((F.col("file") == file) & (F.col("name") == name)).select(F.col("path").alias("symbol"), F.lit("warning").alias("severity"), F.lit(1.0).alias("score")).join(known, F.lit(True), "left_semi")
    return found.unionByName(taken).orderBy(F.when(F.col("severity") == "block", 0).otherwise(1), F.desc("score"), "symbol")


def duplication(functions: DataFrame, signature: dict, threshold: float = 0.3) -> DataFrame:
    """(symbol, score) of functions (symbol, name, params, return_type) like a proposed signature, as parse_signature() gives it.

    0.4 name + 0.2 number of parameters + 0.25 types of the parameters + 0.15 return type; above the threshold, best first.
    """
    name, params, ret = signature["name"], [x for x in signature["params"]], signature.get("return_type")
    n, m = F.size("params"), len(params)
    off = F.abs(n - m)
    count = F.when(off == 0, 1.0).when(off == 1, 0.7).otherwise(0.3 / off)
    t = functions.withColumns({"_p": F.array(*map(F.lit, params)) if params else F.array().cast("array<string>"), "_r": F.lit(ret).cast("string")})
    hits = F.size(F.filter(F.zip_with(F.slice("params", 1, m) if m else F.array().cast("array<string>"), "_p", lambda x, y: x.isNotNull() & y.isNotNull() & T.types_compatible_columns(T.normalize_type_column(x), T.normalize_type_column(y))), lambda v: v))
    types = F.when(F.least(n, F.lit(m)) == 0, 0.0).otherwise(hits / F.greatest(n, F.lit(m)))
    a, b = T.normalize_type_column(F.col("return_type")), T.normalize_type_column(F.col("_r"))
    back = F.when(F.col("return_type").isNull() & F.col("_r").isNull(), 1.0).when(F.col("return_type").isNull() | F.col("_r").isNull(), 0.5).when((a == b) | T.types_compatible_columns(a, b), 1.0).otherwise(0.3)
    score = 0.4 * name_similarity(F.col("name"), F.lit(name)) + 0.2 * count + 0.25 * types + 0.15 * back
    return t.select("symbol", score.alias("score")).where(F.col("score") > threshold).orderBy(F.desc("score"), "symbol")


def alternatives(symbols: DataFrame, name: str, cap: int = 10) -> DataFrame:
    """Exact matches first (unbounded), then names that share a start or end and score above 0.7, up to `cap` in all."""
    low = F.lower("name")
    exact = symbols.where(F.col("name") == name).select("symbol", F.lit("warning").alias("severity"), F.lit(1.0).alias("score"))
    near = symbols.where((F.col("name") != name) & (low.startswith(name.lower()) | low.endswith(name.lower()) | F.lit(name.lower()).startswith(low) | F.lit(name.lower()).endswith(low)))
    near = near.select("symbol", F.lit("info").alias("severity"), T.jaro_winkler(low, F.lit(name.lower())).alias("score")).where("score > 0.7")
    left = max(0, cap - exact.count())
    return exact.unionByName(near.orderBy(F.desc("score"), "symbol").limit(left)).orderBy(F.desc("score"), "symbol")

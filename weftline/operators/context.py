"""Token-budgeted context assembly over any number of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from . import graph


def blend(candidates: DataFrame, ranks: DataFrame) -> DataFrame:
    """Final score: 0.7 of the base score and 0.3 of the file's rank; the best row of each symbol stays."""
    x = candidates.join(ranks.select("file", "pagerank"), "file", "left").withColumn("score", 0.7 * F.col("base_score") + 0.3 * F.coalesce("pagerank", F.lit(0.0)))
    rest = [c for c in x.columns if c != "symbol"]
    return x.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("score", "reason")).alias("_r")).select("symbol", "_r.*")


def within_budget(ranked: DataFrame, max_tokens: int) -> DataFrame:
    """(symbol, tokens, score, primary): taken in order of score while they fit; one that doesn't is skipped and later ones may.

    The fold is sequential by nature. What is left only shrinks, so of the candidates of n tokens none after the first
    max_tokens / n can be taken; the others alone go into the fold, and every candidate is considered.
    """
    w = W.partitionBy("tokens").orderBy(F.desc("score"), "symbol")
    top = ranked.where(F.col("tokens") <= max_tokens).withColumn("_n", F.row_number().over(w)).where((F.col("tokens") <= 0) | (F.col("_n") * F.col("tokens") <= max_tokens))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "symbol", F.col("tokens").cast("bigint").alias("tokens"))))
    t = "struct<sum:bigint,kept:array<struct<o:double,symbol:string,tokens:bigint>>>"
    fold = F.expr(f"aggregate(r, cast(struct(0L, array()) as {t}), (a, v) -> if(a.sum < {max_tokens} and a.sum + v.tokens <= {max_tokens}, cast(struct(a.sum + v.tokens, concat(a.kept, array(v))) as {t}), a), a -> a.kept)")
    return top.agg(rows.alias("r")).select(F.explode(fold).alias("v")).select("v.symbol", "v.tokens", (-F.col("v.o")).alias("score"), (-F.col("v.o") >= 0.6).alias("primary"))


def symbol_at(symbols: DataFrame, file: str, line: int) -> DataFrame:
    """The first symbol in order of place, hence the outermost, whose lines hold a line (from 1)."""
    own = symbols.where((F.col("file") == file) & (F.col("start_line") + 1 <= line) & (F.col("end_line") + 1 >= line))
    return own.orderBy("start_byte", F.desc("end_byte")).limit(1)


def chunk(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(symbol, file, text): lines start to stop (from 0, stop excluded, cut at the file's ends) of spans (symbol, file, start, stop)."""
    lines = F.split(F.col("content").cast("string"), "\n")
    x = spans.join(files.select("file", lines.alias("lines")), "file").withColumn("start", F.greatest("start", F.lit(0)))
    x = x.where((F.col("start") < F.size("lines")) & (F.col("stop") > F.col("start")))
    return x.select("symbol", "file", F.array_join(F.slice("lines", F.col("start").cast("int") + 1, F.least((F.col("stop") - F.col("start")).cast("int"), F.size("lines"))), "\n").alias("text"))


def location_chunk(files: DataFrame, file: str, line: int, around: int = 20) -> DataFrame:
    """The text around a line (from 1)."""
    spans = files.sparkSession.createDataFrame([(None, file, line - 1 - around, line - 1 + around)], "symbol string, file string, start long, stop long")
    return chunk(files, spans)


def symbol_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return chunk(files, symbols.select(F.col("scoped_name").alias("symbol"), "file", F.col("start_line").cast("bigint").alias("start"), (F.col("end_line") + 1).cast("bigint").alias("stop")))


def type_symbol(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name, symbol): the first struct, enum or trait of each name, in order of file and place."""
    s = symbols.where(F.col("kind").isin("struct", "enum", "trait")).join(names.select("name").distinct(), "name", "left_semi")
    return s.groupBy("name").agg(F.min_by("scoped_name", F.struct("file", "start_byte")).alias("symbol"))


def import_symbol(symbols: DataFrame, names: DataFrame, ranks: DataFrame) -> DataFrame:
    """(name, symbol): of the definitions of each name that in the file of highest rank, then the first."""
    s = symbols.join(names.select("name").distinct(), "name", "left_semi").join(ranks.select("file", "pagerank"), "file", "left")
    return s.groupBy("name").agg(F.min_by("scoped_name", F.struct(-F.coalesce("pagerank", F.lit(0.0)), F.col("file"), F.col("start_byte"))).alias("symbol"))


def candidates(symbols: DataFrame, calls: DataFrame, imports: DataFrame, ranks: DataFrame, current: DataFrame) -> DataFrame:
    """(symbol, base_score, reason): what belongs to the context of the current symbol (a row of symbols).

    The symbol 1.0, the definitions it calls 0.8, its parent 0.7, its first five callers 0.6, types of its signature 0.5, what the file's
    first five imports name 0.4.
    """
    here = materialize(current.select("scoped_name", "name", "file", "parent", "signature"), "current")  # one row, that everything below starts from
    rated = lambda df, score, reason: df.select("symbol", F.lit(score).alias("base_score"), F.lit(reason).alias("reason"))
    called = calls.join(here.select(F.col("scoped_name").alias("caller")), "caller").select(F.col("callee_name").alias("name"))
    callees = graph.resolve_callees(called, symbols.withColumn("seq", F.struct("file", "start_byte"))).select(F.col("scoped_name").alias("symbol"))
    callers = calls.join(here.select(F.col("name").alias("callee_name")), "callee_name").groupBy(F.col("caller").alias("symbol")).agg(F.min(F.struct("file", "start_byte")).alias("o")).orderBy("o", "symbol").limit(5)
    parent = here.where("parent is not null").select(F.col("parent").alias("name"))
    sig = F.concat(F.array("signature.return_type"), F.coalesce("signature.params", F.array().cast("array<string>")))
    types = here.select(F.explode(sig).alias("t")).select(T.type_name("t").alias("name")).where("name is not null")
    named = imports.join(here.select("file"), "file").where("not is_glob").orderBy("start_line", "name").limit(5).select("name")
    out = rated(here.select(F.col("scoped_name").alias("symbol")), 1.0, "current")
    for df, score, reason in ((callees, 0.8, "callee"), (type_symbol(symbols, parent), 0.7, "parent"), (callers, 0.6, "caller"), (type_symbol(symbols, types), 0.5, "type"), (import_symbol(symbols, named, ranks), 0.4, "import")):
        out = out.unionByName(rated(df, score, reason))
    return out


def assemble(files: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, ranks: DataFrame, file: str, line: int, max_tokens: int = 4000, around: int = 20) -> DataFrame:
    """(symbol, file, reason, score, tokens, primary, text): the text around a location, then what belongs to it, within a token budget."""
    first = location_chunk(files, file, line, around).withColumns({"reason": F.lit("location"), "score": F.lit(1.0), "primary": F.lit(True)})
    first = first.withColumn("tokens", T.token_estimate("text"))
    used = sum(r["tokens"] for r in first.collect())
    place = symbols.select(F.col("scoped_name").alias("symbol"), "file").distinct()
    ranked = blend(candidates(symbols, calls, imports, ranks, symbol_at(symbols, file, line)).join(place, "symbol"), ranks)
    texts = symbol_chunks(files, symbols).groupBy("symbol").agg(F.min("text").alias("text"))
    ranked = ranked.join(texts, "symbol").withColumn("tokens", T.token_estimate("text"))
    kept = within_budget(ranked.select("symbol", "tokens", "score"), max(0, max_tokens - used))
    rest = ranked.drop("tokens", "score").join(kept, "symbol")
    cols = ["symbol", "file", "reason", "score", "tokens", "primary", "text"]
    return first.select(cols).unionByName(rest.select(cols))

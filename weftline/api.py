"""What the command line and the tool server do, as plain values."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import analysis, context, export, graph, index, topology
from .sources import git


class InvalidQuery(ValueError):
    """A query without terms."""


class Workspace:
    """A source tree and its index, by default in a hidden folder of the tree."""

    def __init__(self, spark: SparkSession, root: str, home: str | None = None):
        self.root = root.rstrip("/") or "/"
        self.index_ = index.SourceIndex(spark, home or f"{self.root}/.weftline", self.root)

    def index(self, force: bool = False, **options) -> dict:
        r = self.index_.index(force, **options)
        return {"type": "index", "files": r["total"], "symbols": r["symbols"], "parsed": r["parsed"], "skipped": r["skipped"], "removed": r["removed"], "root": self.root}

    def _found(self, query: str, k: int, filters: list[str]) -> list:
        try:
            return self.index_.search(query, k, filters).collect()
        except ValueError as e:
            raise InvalidQuery(str(e)) from e

    def query(self, query: str, top_k: int = 10, filters: list[str] = ()) -> dict:
        names = {"start_line": "line"}
        fields = ["doc_id", "symbol", "file", "start_byte", "end_byte", "start_line", "end_line", "start_col", "end_col", "score", "preview"]
        results = [{f: r[names.get(f, f)] for f in fields} for r in self._found(query, top_k, list(filters))]
        return {"type": "query", "root": self.root, "query": query, "top_k": top_k, "results": results}

    def search(self, query: str, limit: int = 10) -> dict:
        return {"type": "search", "results": [{f: r[f] for f in ("symbol", "kind", "file", "line", "score")} for r in self._found(query, limit, [])]}

    def _symbols(self):
        return self.index_.table("symbols").withColumn("seq", F.struct("file", "start_byte", "end_byte"))

    @staticmethod
    def _symbol(r) -> dict:
        return {"name": r["name"], "scoped_name": r["scoped_name"], "kind": r["kind"], "file": r["file"], "line": r["start_line"] + 1, "visibility": r["visibility"]}

    def symbol(self, name: str, scoped: bool = False, limit: int = 10) -> dict:
        found = graph.symbol_report(self._symbols(), name, scoped, limit)
        return {"type": "symbols", "query": name, "results": [self._symbol(r) for r in found.collect()]}

    def calls(self, symbol: str, direction: str = "callers") -> dict:
        found = graph.call_graph(self._symbols(), self.index_.table("calls"), symbol, direction).orderBy("file", "start_line", "caller", "callee_name")
        rows = [{"caller": r["caller"], "callee": r["callee_name"], "file": r["file"], "line": r["start_line"] + 1} for r in found.collect()]
        return {"type": "calls", "symbol": symbol, "direction": direction, "results": rows}

    def analyze(self, kind: str = "dead-code") -> dict:
        if kind == "dead-code":
            dead = analysis.dead_symbols(self._symbols().drop("signature"), self.index_.table("calls"))
            n, first = analysis.dead_report(dead)
            return {"type": "deadcode", "dead_count": n, "symbols": [self._symbol(r) for r in first]}
        if kind == "churn":
            rows = analysis.hotspots(analysis.churn(git.history(self.index_.spark, self.root))).orderBy(F.desc("commits"), "path").collect()
            return {"type": "churn", "files": [r.asDict() for r in rows]}
        raise ValueError(f"unknown analysis {kind}")

    def export(self, max_files: int = 20, max_symbols: int = 40) -> dict:
        t = self.index_.topology()
        files = self.index_.table("files").select("file")
        return {"type": "export", "export": export.summary(self.index_.stats(), t.scores, files, self._symbols(), max_files, max_symbols)}

    def topology(self, op: str = "pagerank", path: str | None = None, most: int = 20) -> dict:
        t = self.index_.topology()
        if op == "modules":
            rows = topology.modules(t).orderBy("id")
        elif op == "pagerank":
            rows = topology.top_nodes(t.scores, most)
        elif op == "dependencies":
            rows = t.edges.where(F.col("src") == path).select("dst", "kind").orderBy("kind", "dst")
        elif op == "imports":
            rows = graph.first_per_group(self.index_.table("imports"), "file", ["start_line", "name"], 5).select("file", "path", "position", "more").orderBy("file", "position")
        else:
            raise ValueError(f"unknown operation {op}")
        return {"type": "topology", "results": [r.asDict() for r in rows.limit(most).collect()]}

    def context(self, file: str, line: int, max_tokens: int = 4000) -> dict:
        from .sources import code

        i = self.index_
        ranks = i.topology().scores.select(F.col("id").alias("file"), F.col("score").alias("pagerank"))
        files = code.with_content(i.table("files"), self.root)
        x = context.assemble(files, self._symbols(), i.table("calls"), i.table("imports"), ranks, file, line, max_tokens)
        return {"type": "context", "chunks": [r.asDict() for r in x.orderBy(F.desc("score"), "symbol").collect()]}

    def intervene(self, name: str, file: str, signature: str | None = None) -> dict:
        from .functions import text

        s = self._symbols().withColumn("symbol", F.col("scoped_name"))
        out = {"type": "intervene", "conflicts": [r.asDict() for r in analysis.check_name(s, self.index_.table("imports"), name, file).collect()], "alternatives": [r.asDict() for r in analysis.alternatives(s.select("symbol", "name"), name).collect()]}
        parsed = text.parse_signature(signature) if signature else None
        if parsed:
            own = s.where("signature is not null").select("symbol", "name", "signature.params", "signature.return_type")
            out["duplicates"] = [r.asDict() for r in analysis.duplication(own, parsed).limit(20).collect()]
        return out


def index_all(spark: SparkSession, roots: list[str]) -> dict:
    return {"type": "indexall", "results": [Workspace(spark, r).index() for r in roots]}


def envelope(e: Exception) -> dict:
    """The error as JSON: index_missing, invalid_query or internal."""
    code = "invalid_query" if isinstance(e, InvalidQuery) else "index_missing" if isinstance(e, index.IndexMissing) else "internal"
    return {"ok": False, "error": {"code": code, "message": str(e)}}

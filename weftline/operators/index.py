"""A persisted index: validity by manifest, incremental refresh of a source tree, and what it holds.

An index folder has versions below it: a new one is written whole, then the manifest names it, so readers never
see half an index and a lost writer leaves the old one in place.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_base
from ..sources import code
from . import analysis, bm25, topology

VERSION = "1"
FIELDS = ["path", "ident", "code"]
_TABLES = ("files", "symbols", "calls", "imports", "docs")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(text.encode())
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _state(spark: SparkSession, path: str) -> list[list]:
    """(name, size, time) of the files of a table: what tells that it has changed."""
    fs, at = _fs(spark, path)
    found, it = [], fs.listFiles(at, True)
    while it.hasNext():
        x = it.next()
        found.append([x.getPath().toString(), x.getLen(), x.getModificationTime()])
    return sorted(found)


def current(spark: SparkSession, table: str, fields: list[str], build) -> bm25.Index:
    """The BM25 index of a table, loaded where the manifest's state is the table's own, else written by build(path)."""
    state = {"version": VERSION, "table": table, "fields": fields, "files": _state(spark, table)}
    home = f"{shared_base(spark)}/index-{hashlib.sha256(json.dumps([table, fields]).encode()).hexdigest()[:16]}"
    held = json.loads(_read_text(spark, f"{home}/manifest.json") or "{}")
    if {k: held.get(k) for k in state} == state:
        try:
            return bm25.load(spark, held["path"])
        except FileNotFoundError:
            pass
    index = build(f"{home}/{uuid.uuid4().hex}")
    _write_text(spark, f"{home}/manifest.json", json.dumps(state | {"path": index.path}))
    return index


class IndexMissing(Exception):
    """No usable index at a folder."""


class SourceIndex:
    """The index of a source tree at `home`: files, symbols, calls, imports, search documents and their BM25 tables."""

    def __init__(self, spark: SparkSession, home: str, root: str):
        self.spark, self.home, self.root = spark, home.rstrip("/"), root

    # -- manifest

    def manifest(self) -> dict | None:
        text = _read_text(self.spark, f"{self.home}/manifest.json")
        m = json.loads(text) if text else None
        # another version or root is as good as none
        return m if m and m.get("tool_version") == VERSION and m.get("root") == self.root else None

    def exists(self) -> bool:
        return self.manifest() is not None

    def table(self, name: str) -> DataFrame:
        m = self.manifest()
        if not m:
            raise IndexMissing(f"index_missing: {self.home}")
        return self.spark.read.parquet(f"{m['path']}/{name}")

    def bm25(self) -> bm25.Index:
        m = self.manifest()
        if not m:
            raise IndexMissing(f"index_missing: {self.home}")
        return bm25.load(self.spark, f"{m['path']}/bm25")

    def clear(self) -> None:
        """Forgets everything."""
        fs, at = _fs(self.spark, self.home)
        fs.delete(at, True)

    # -- building

    def index(self, force: bool = False, **options) -> dict:
        """Brings the index up to date: only changed files are parsed, rows of changed and removed files go, BM25 is built anew.

        Returns the report (total, parsed, skipped, removed, docs_indexed, symbols).
        """
        if force:
            self.clear()
        old = self.manifest()
        found = code.listing(self.spark, self.root, **options)
        now = found.select("file", "mtime_ms", "size_bytes")
        before = self.table("files") if old else now.where("false")
        diff = analysis.fingerprint_diff(before, now)
        path = f"{self.home}/{uuid.uuid4().hex}"
        diff.write.parquet(f"{path}/diff")
        diff = self.spark.read.parquet(f"{path}/diff")
        now.write.parquet(f"{path}/files")
        # contents are read once, of changed files alone; markers of workspaces are sought among all
        changed = code.with_workspace(found.join(diff.where("status = 'changed'").select("file"), "file", "left_semi"), found)
        code.with_content(changed, self.root).write.parquet(f"{path}/changed")
        changed = self.spark.read.parquet(f"{path}/changed")
        syms = code.symbols(changed)
        fresh = {"symbols": syms, "calls": code.calls(changed), "imports": code.imports(changed)}
        for name, t in fresh.items():
            kept = analysis.prune(self.table(name), diff) if old else None
            (t if kept is None else kept.unionByName(t)).write.parquet(f"{path}/{name}")
        # documents of the files parsed now are those whose file changed
        code.search_docs(self.spark.read.parquet(f"{path}/symbols")).write.parquet(f"{path}/docs")
        docs = self.spark.read.parquet(f"{path}/docs")
        bm25.build(bm25.field_terms(docs), FIELDS, f"{path}/bm25")
        _write_text(self.spark, f"{self.home}/manifest.json", json.dumps({"tool_version": VERSION, "root": self.root, "path": path}))
        for gone in (f"{path}/changed", *([old["path"]] if old else [])):
            fs, at = _fs(self.spark, gone)
            fs.delete(at, True)
        r = analysis.index_report(diff).first().asDict()
        new = docs.join(diff.where("status = 'changed'").select("file"), "file", "left_semi").count()
        return {**r, "docs_indexed": new, "symbols": docs.count()}

    def clear_file(self, file: str) -> None:
        """Takes one file's rows out of every table."""
        m = self.manifest()
        if not m:
            raise IndexMissing(f"index_missing: {self.home}")
        path = f"{self.home}/{uuid.uuid4().hex}"
        for name in _TABLES:
            self.table(name).where(F.col("file") != file).write.parquet(f"{path}/{name}")
        bm25.build(bm25.field_terms(self.spark.read.parquet(f"{path}/docs")), FIELDS, f"{path}/bm25")
        _write_text(self.spark, f"{self.home}/manifest.json", json.dumps(m | {"path": path}))

    def topology(self) -> topology.Topology:
        name = self.root.rstrip("/").rpartition("/")[2] or "root"
        return topology.build(self.table("files").where(code.language_of_file().isNotNull()).select("file"), self.table("imports"), name)

    def stats(self) -> dict:
        return {name: self.table(name).count() for name in _TABLES}

    def search(self, query: str, k: int = 10, extra: list[str] = (), build_missing: bool = True) -> DataFrame:
        """Results with file, symbol and line; a missing index is built first, or else is an error."""
        bm25.parse_query(query, list(extra))
        if not self.exists():
            if not build_missing:
                raise IndexMissing(f"index_missing: {self.home}")
            self.index()
        found = bm25.execute(self.bm25(), query, k, FIELDS, list(extra)).drop("file", "start_byte")
        return found.join(self.table("docs").drop("text"), "doc_id").orderBy(F.desc("score"), "file", "start_byte")


def index_all(spark: SparkSession, roots: dict[str, str]) -> dict[str, dict]:
    """Indexes several workspaces (root -> index folder), one after the other; reports by root."""
    return {root: SourceIndex(spark, home, root).index() for root, home in roots.items()}

"""Index life cycle, command line and tool server on a small tree; the TypeScript scanner, folding and history."""

import io
import json
import os
import subprocess

import pytest

from weftline import cli
from weftline.functions import rust, typescript
from weftline.operators import bm25, embedding, fusion, index
from weftline.server import Server
from weftline.sources import code, git

LIB = """/// Sums up.
pub fn add_all(a: i32, b: i32) -> i32 { inner_sum(a, b) }
fn inner_sum(a: i32, b: i32) -> i32 { a + b }
fn unused_thing() {}
pub struct Basket { n: i32 }
impl Basket { pub fn put(&self, x: i32) -> Basket { add_all(x, self.n); make() } }
"""
TS = """import { helper } from './util';
export function greet() { return helper('x'); }
class Shop { open() { this.bell?.ring(); obj["foo-bar"](); } }
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {"Cargo.toml": "", "src/lib.rs": LIB, "src/_hidden_name.rs": "pub fn under_score() {}\n", "web/package.json": "{}", "web/src/alpha.ts": TS, "gen/out.rs": "fn generated() {}", ".gitignore": "/gen/\n*.tmp.rs\n!keep.tmp.rs\n", "src/x.tmp.rs": "fn x() {}", "src/keep.tmp.rs": "fn keep() {}"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def call(spark, capsys, *argv):
    rc = cli.main([*argv, "--json"], spark)
    got = capsys.readouterr()
    return rc, json.loads(got.out or got.err)


def test_command_line(spark, tree, capsys):
    root = str(tree)
    rc, r = call(spark, capsys, "index", "--root", root)
    assert rc == 0 and r["ok"] and r["type"] == "index" and r["root"] == root and r["parsed"] == r["files"] and r["skipped"] == 0
    files = {x["file"] for x in code.listing(spark, root).collect()}
    assert files == {"Cargo.toml", "src/lib.rs", "src/_hidden_name.rs", "web/package.json", "web/src/alpha.ts", "src/keep.tmp.rs"} and r["files"] == len(files)
    rc, r = call(spark, capsys, "search", "add all", "-w", root, "-n", "2")
    assert rc == 0 and r["type"] == "search" and len(r["results"]) <= 2
    first = r["results"][0]
    assert set(first) == {"symbol", "kind", "file", "line", "score"} and (first["symbol"], first["line"], first["kind"]) == ("crate::add_all", 2, "function")
    rc, r = call(spark, capsys, "query", "add ext:rs -path:web", "--root", root, "-k", "3")
    assert r["top_k"] == 3 and all(x["file"].endswith(".rs") and x["start_line"] >= 1 for x in r["results"])
    rc, r = call(spark, capsys, "symbol", "put", "--root", root)
    assert r["type"] == "symbols" and [x["scoped_name"] for x in r["results"]] == ["crate::Basket::put"]
    rc, r = call(spark, capsys, "symbol", "crate::Basket::put", "--scoped", "--root", root)
    assert [x["line"] for x in r["results"]] == [6]
    rc, r = call(spark, capsys, "calls", "add_all", "--root", root)
    assert r["type"] == "calls" and [x["caller"] for x in r["results"]] == ["crate::Basket::put"]
    rc, r = call(spark, capsys, "calls", "add_all", "-d", "callees", "--root", root)
    assert [x["callee"] for x in r["results"]] == ["inner_sum"]
    rc, r = call(spark, capsys, "analyze", "dead-code", "--root", root)
    names = {x["scoped_name"] for x in r["symbols"]}
    assert r["type"] == "deadcode" and "crate::unused_thing" in names and "crate::inner_sum" not in names and r["dead_count"] == len(names)
    rc, r = call(spark, capsys, "export", "--root", root)
    assert "crate::add_all" in r["export"] and "score 0." in r["export"]
    rc, r = call(spark, capsys, "index-all", root)
    assert r["type"] == "indexall" and r["results"][0]["parsed"] == 0


def test_errors(spark, tree, capsys, tmp_path):
    for text in ("", "  ", "ext:rs"):
        rc, r = call(spark, capsys, "search", text, "-w", str(tree))
        assert rc == 1 and r["ok"] is False and r["error"]["code"] == "invalid_query" and r["error"]["message"]
    rc, r = call(spark, capsys, "symbol", "x", "--root", str(tmp_path))
    assert rc == 1 and r["error"]["code"] == "index_missing"
    rc, r = call(spark, capsys, "analyze", "nothing", "--root", str(tree))
    assert rc == 1 and r["error"]["code"] == "internal"
    with pytest.raises(index.IndexMissing):
        index.SourceIndex(spark, str(tmp_path / "none"), str(tree)).search("x", build_missing=False)


def test_incremental_index(spark, tmp_path):
    root, home = tmp_path / "t", str(tmp_path / "home")
    (root / "src").mkdir(parents=True)
    for n in ("a", "b", "c"):
        (root / f"src/{n}.rs").write_text(f"pub fn fn_{n}() {{}}\n")
    x = index.SourceIndex(spark, home, str(root))
    assert x.index() == {"total": 3, "parsed": 3, "skipped": 0, "removed": 0, "docs_indexed": 3, "symbols": 3}
    (root / "src/a.rs").write_text("pub fn fn_a2() { fn_b(); }\npub fn more() {}\n")
    os.remove(root / "src/c.rs")
    assert x.index() == {"total": 2, "parsed": 1, "skipped": 1, "removed": 1, "docs_indexed": 2, "symbols": 3}
    assert {r["name"] for r in x.table("symbols").collect()} == {"fn_a2", "more", "fn_b"}
    assert [r["symbol"] for r in x.search("fn a2", 1).collect()] == ["crate::fn_a2"]
    # searching an index that was maintained gives what one that was built anew gives
    y = index.SourceIndex(spark, str(tmp_path / "fresh"), str(root))
    y.index()
    rows = lambda i: [(r["symbol"], round(r["score"], 6)) for r in i.search("fn b more", 5).collect()]
    assert rows(x) == rows(y)
    x.clear_file("src/b.rs")
    assert {r["name"] for r in x.table("symbols").collect()} == {"fn_a2", "more"} and x.stats()["files"] == 1
    assert not index.SourceIndex(spark, home, str(tmp_path)).exists()  # another root
    x.index(force=True)
    assert x.stats()["symbols"] == 3


def test_server(spark, tree):
    s = Server(spark, str(tree))
    s.w.index()
    asked = [{"id": 1, "tool": "search", "arguments": {"query": "basket"}}, {"id": 2, "tool": "nope"}, {"id": 3, "tool": "topology", "arguments": {"op": "dependencies", "path": "root"}}, {"id": 4, "tool": "get_context", "arguments": {"file": "src/lib.rs", "line": 6}}, {"id": 5, "tool": "intervene", "arguments": {"name": "add_all", "file": "src/lib.rs", "signature": "fn add_al(a: i32, b: i32) -> i32"}}, {"id": 6, "tool": "index", "arguments": {"op": "status"}}]
    out = io.StringIO()
    s.serve(io.StringIO("\n".join([*map(json.dumps, asked), "{bad"])), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert got[1]["ok"] and got[2]["error"]["code"] == "internal" and got[None]["ok"] is False and got[6]["result"]["symbols"] > 0
    assert any(r["dst"] == "src/lib.rs" for r in got[3]["result"]["results"])
    chunks = got[4]["result"]["chunks"]
    assert chunks[0]["reason"] == "location" and {"crate::add_all", "crate::Basket"} & {c["symbol"] for c in chunks}
    assert got[5]["result"]["conflicts"][0]["severity"] == "block" and got[5]["result"]["duplicates"][0]["symbol"] == "crate::add_all"


def test_typescript():
    f = typescript.parse("web/src/alpha.ts", TS, "src/alpha.ts")
    assert [(s["scoped_name"], s["kind"]) for s in f.symbols] == [("file:src/alpha.ts::greet", "function"), ("file:src/alpha.ts::Shop", "struct"), ("file:src/alpha.ts::Shop::open", "method")]
    assert [(c["caller"], c["callee_name"], c["is_method_call"]) for c in f.calls] == [("file:src/alpha.ts::greet", "helper", False), ("file:src/alpha.ts::Shop::open", "ring", True), ("file:src/alpha.ts::Shop::open", "foo-bar", True)]
    src = "// f()\nconst s = `g(${1})`;\nlet re = /h()\\//;\ninterface I { m(): void }\nnew Thing(a());\nexport default function () {}\nconst é = async (x) => { await go(x); };\n"
    f = typescript.parse("a.ts", src)
    assert [c["callee_name"] for c in f.calls] == ["a", "go"] and ("I", "trait") in {(s["name"], s["kind"]) for s in f.symbols}
    assert typescript.parse("e.ts", "").symbols == [] and typescript.parse("e.ts", "class {").calls == []


def test_fold():
    src = "//! Top\nuse a::b;\n// gone\n/// Doc\n#[inline]\npub fn f(x: i32) -> i32 { body(); }\nconst N: [u8; 2] = [1, 2];\nimpl<T> S<T> where T: X {\n  // gone\n  #[test]\n  fn m(&self) { 1; }\n  type A = u8;\n}\ntrait Q { fn d(&self); }\nextern crate z;\nmac!(1, 2);\n"
    out = rust.fold(src)
    assert out == "//! Top\nuse a::b;\n/// Doc\n#[inline]\npub fn f(x: i32) -> i32 { /* ... */ }\nconst N: [u8; 2] = /* ... */;\nimpl<T> S<T> where T: X {\n    #[test]\n    fn m(&self) { /* ... */ }\n    type A = u8;\n}\ntrait Q { fn d(&self); }\nextern crate z;\nmac!(1, 2);\n"
    assert "elided" not in rust.fold("big!(" + "x, " * 100 + ");") and "/* ... */" in rust.fold("big!(" + "x, " * 100 + ");")
    assert [x["name"] for x in rust.functions("fn a() { fn inner() {} } trait T { fn d(&self) {} }")] == ["a", "d"]
    assert rust.fold("") == "\n"


def test_history(spark, tmp_path):
    with pytest.raises(ValueError, match="not a git repository"):
        git.history(spark, str(tmp_path))
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A | B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    assert git.history(spark, str(tmp_path)).count() == 0
    for k in range(3):
        (tmp_path / "f.txt").write_text("x\n" * (k + 1))
        run("add", ".")
        run("commit", "-q", "-m", f"c{k}")
    rows = git.history(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {(r["author"], r["path"], r["added"], r["removed"]) for r in rows} == {("A | B", "f.txt", "1", "0")}


def test_embedder(spark):
    s = spark.createDataFrame([("crate::parse_query", "function", "a.rs", None, None, None), ("crate::Basket", "struct", "b.rs", "/// Holds fruit", None, None)], f"scoped_name string, kind string, file string, doc_comment string, signature {code.SIGNATURE}, parent string")
    v = embedding.build_index(s)
    q = spark.createDataFrame([(1, "query parser"), (2, "fruit basket")], "query_id int, text string")
    top = {r["query_id"]: r["id"] for r in embedding.search(v, q, 1).collect()}
    assert top == {1: "crate::parse_query", 2: "crate::Basket"}
    assert embedding.search(v.where("false"), q, 1).count() == 0
    gone = embedding.remove(v, spark.createDataFrame([("crate::Basket",)], "id string"))
    assert embedding.upsert(gone, v).count() == 2 and gone.count() == 1
    with pytest.raises(ValueError):
        fusion.hybrid(v, v, fusion.Config(method="other"))


def test_five_fields(spark):
    docs = spark.createDataFrame([(0, "src/a.rs", "crate::a", '/// Walks the graph\nfn a() { log("walk done"); }', 0), (1, "src/b.rs", "crate::b", "fn graph_b() {}", 0)], "doc_id int, file string, symbol string, text string, start_byte int")
    fields = list(bm25.WEIGHTS)
    ix = bm25.build(bm25.all_field_terms(docs), fields)
    assert len(ix) == 2 and ix.postings.where("term = 'walk done'").first()["tf_string"] == 1 and ix.postings.where("term = 'graph' and doc_id = 0").first()["tf_doc"] == 1
    q = spark.createDataFrame([(0, "walks graph")], "query_id int, text string")
    assert [r["doc_id"] for r in bm25.search(ix, q, fields, 2).orderBy("rank").collect()] == [0, 1]
    with pytest.raises(ValueError, match="unique"):
        bm25.build(bm25.field_terms(docs.withColumn("doc_id", docs.start_byte)), ["path", "ident", "code"])
    with pytest.raises(FileNotFoundError, match="index_missing"):
        bm25.load(spark, "/nowhere/at/all")

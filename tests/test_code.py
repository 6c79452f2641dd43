"""Discovery, the Rust scanner and search over parsed source."""

from weftline.functions import rust
from weftline.operators import analysis, bm25
from weftline.sources import code

SRC = '''use std::collections::{HashMap, hash_map::Entry as E};
use super::*;

/// Adds two numbers.
#[inline]
pub fn add_pair(a: i32, b: i32) -> i32 { helper(a) + b }

fn helper(x: i32) -> i32 { // } brace in a comment
    let s = "fn not_me() { call(1) }";
    println!("{}", hidden(1));
    let v = list.iter().map(|q| Some(q)).collect::<Vec<_>>();
    if let Some(z) = v.first() { inner(z); }
    fn inner(k: i32) {}
    x.twice()
}

fn lonely() { lonely(); }

pub struct Ünit<T> { f: T }
impl<T> Ünit<T> { pub(crate) async fn go(&self, n: Vec<(u8, u8)>) -> Option<T> { None } }
mod deep { pub trait Tr { fn dflt(&self) {} } impl Tr for super::Thing { const C: u8 = 1; } }
const LIMIT: usize = make();
'''


def test_symbols():
    f = rust.parse("a.rs", SRC)
    got = {(s["scoped_name"], s["kind"], s["visibility"]) for s in f.symbols}
    assert {("crate::add_pair", "function", "public"), ("crate::helper", "function", "private"), ("crate::inner", "function", "private"), ("crate::deep", "module", "private"), ("crate::deep::Tr", "trait", "public"), ("crate::deep::dflt", "function", "private"), ("crate::LIMIT", "const", "private")} <= got
    assert not any("not_me" in s["name"] for s in f.symbols)
    s = next(s for s in f.symbols if s["name"] == "add_pair")
    assert s["doc_comment"] == "/// Adds two numbers." and s["attributes"] == ["#[inline]"] and s["signature"]["params"] == ["a: i32", "b: i32"] and s["signature"]["return_type"] == "i32"
    g = next(s for s in f.symbols if s["name"] == "go")
    assert g["kind"] == "method" and g["visibility"] == "crate" and g["signature"]["is_async"] and g["signature"]["params"] == ["&self", "n: Vec<(u8, u8)>"]
    for s in f.symbols:
        assert s["name"].encode() in SRC.encode()[s["start_byte"] : s["end_byte"]]


def test_calls_and_imports():
    f = rust.parse("a.rs", SRC)
    got = {(c["caller"], c["callee_name"], c["is_method_call"]) for c in f.calls}
    assert {("crate::add_pair", "helper", False), ("crate::helper", "inner", False), ("crate::helper", "twice", True), ("crate::helper", "_", False), ("crate::lonely", "lonely", False), ("crate::<toplevel>", "make", False)} <= got
    assert not {"hidden", "call", "not_me"} & {c["callee_name"] for c in f.calls}
    assert [(i["path"], i["name"], i["is_glob"]) for i in f.imports] == [("std::collections::HashMap", "HashMap", False), ("std::collections::hash_map::Entry", "E", False), ("super", "*", True)]


def test_index_from_files(spark, tmp_path):
    for name, text in {"src/lib.rs": SRC, "src/b.rs": "pub fn subtract_pair() {}\n", "target/gen.rs": "fn gen() {}", ".hide/x.rs": "fn x() {}", "Cargo.lock": "", "note.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = code.discover(spark, str(tmp_path))
    assert {r["file"] for r in files.select("file").collect()} == {"src/lib.rs", "src/b.rs", "note.txt"}
    assert "target/gen.rs" in {r["file"] for r in code.discover(spark, str(tmp_path), include=["**/target/**"]).select("file").collect()}
    assert {r["file"] for r in code.discover(spark, str(tmp_path), max_bytes=10).select("file").collect()} == {"note.txt"}
    syms = code.symbols(files)
    hits = bm25.execute(bm25.field_terms(code.search_docs(syms)), "add pair", 3, ["path", "ident", "code"]).collect()
    assert hits and hits[0]["file"] == "src/lib.rs"
    dead = {r["scoped_name"] for r in analysis.dead_symbols(syms.select("name", "scoped_name", "kind", "visibility", "attributes", "parent"), code.calls(files)).collect()}
    assert "crate::lonely" in dead and "crate::helper" not in dead and "crate::add_pair" not in dead
    assert {r["name"] for r in code.imports(files).collect()} == {"HashMap", "E", "*"}


def test_query_filters():
    text, f = bm25.parse_query("add -foo path:src -path:gen ext:.RS -ext:ts")
    assert text == "add -foo" and (f.include, f.exclude, f.ext, f.not_ext) == (["src"], ["gen"], ["rs"], ["ts"])

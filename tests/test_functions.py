"""Golden cases of operators that no registered query covers, and of functions."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import analysis, context, fusion, graph, topology


def test_tokenizer(spark):
    cases = {"HelloWorld": ["Hello", "World", "HelloWorld"], "hello_world": ["hello", "world", "hello_world"], "HTTPServer": ["HTTPServer"], "_foo": [], "_foo_bar": ["bar"], "__init__": ["init"], "a__b": ["a", "b", "a__b"], "parseJSON2Xml": ["parse", "JSON2Xml", "parseJSON2Xml"], "": []}
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.tokenize("t").alias("x")).collect()}
    assert got == cases


def test_type_functions(spark):
    df = spark.createDataFrame([("Vec<String>", "Vec"), ("&mut Foo", "Foo"), ("&Bar", "Bar"), ("i32", None), ("", None)], "t string, e string")
    assert all(r["x"] == r["e"] for r in df.select("e", T.type_name("t").alias("x")).collect())
    assert df.limit(1).select(T.normalize_type("' &mut T '")).first()[0] == "t"
    assert T.parse_signature("pub async fn go(a: i32, b: &str) -> Vec<u8> {") == {"name": "go", "params": ["i32", "&str"], "return_type": "Vec<u8>", "is_async": True, "is_unsafe": False}
    assert T.parse_signature("no signature") is None


def test_comments_and_literals(spark):
    src = '/// One\n/** two\n * three */\nlet a = "x\\"y"; let b = "";\n'
    r = spark.createDataFrame([(src,)], "t string").select(T.doc_comments("t").alias("d"), T.string_literals("t").alias("s")).first()
    assert r["d"] == ["One", "two", "three"] and r["s"] == ['x\\"y']


def test_jaro_winkler(spark):
    rows = [("martha", "marhta", 0.961111), ("abc", "abc", 1.0), ("", "a", 0.0), ("abcd", "wxyz", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, e double")
    assert all(r["x"] == pytest.approx(r["e"], abs=1e-5) for r in df.select("e", T.jaro_winkler(F.col("a"), F.col("b")).alias("x")).collect())


def test_fusion(spark):
    sem = spark.createDataFrame([(1, 0.9), (2, 0.7), (3, 0.5)], "id int, score double")
    bm = spark.createDataFrame([(2, 5.0), (1, 4.0), (3, 2.0)], "id int, score double")
    assert [(r["id"], round(r["score"], 9), r["found_by"]) for r in fusion.rrf(sem, bm).collect()] == [(2, 0.016287678, "both"), (1, 0.016234796, "both"), (3, 0.015873016, "both")]
    one = fusion.weighted(sem.where("id = 1").withColumn("score", F.lit(0.8)), bm.where("id = 1"), 0.5, 0.5).first()
    assert one["score"] == pytest.approx(0.9)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (9, 9)], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    pr = {r["id"]: round(r["score"], 6) for r in graph.pagerank(nodes, edges.where("src < 9"), tol=0).collect()}
    assert pr == {1: 0.38779, 2: 0.214811, 3: 0.3974}
    assert {r["id"] for r in graph.reachable(nodes.where("id = 2"), edges).collect()} == {1, 2, 3}
    assert graph.pagerank(nodes.where("false"), edges).count() == 0


def test_topology(spark):
    files = spark.createDataFrame([("src/lib.rs",), ("src/a/mod.rs",), ("src/a/x.rs",), ("src/a/b/mod.rs",), ("src/a/b/y.rs",), ("src/a/c/z.rs",)], "file string")
    got = {r["child"]: r["parent"] for r in topology.containment(files).collect()}
    assert got == {"src/lib.rs": "root", "src/a/mod.rs": "module:src/a", "src/a/x.rs": "module:src/a", "src/a/b/mod.rs": "module:src/a/b", "src/a/b/y.rs": "module:src/a/b", "src/a/c/z.rs": "module:src/a", "module:src/a": "root", "module:src/a/b": "module:src/a"}
    nodes = spark.createDataFrame([("root", "crate", "pkg", 0), ("src/a/x.rs", "file", "x", 1), ("module:src/a", "module", "a", 2)], "id string, node_type string, name string, node_seq int")
    imp = spark.createDataFrame([("f", "crate::x::Y"), ("g", "pkg::z"), ("h", "b::q")], "file string, path string")
    assert {(r["src"], r["dst"]) for r in topology.import_edges(imp, nodes).collect()} == {("f", "src/a/x.rs"), ("g", "root")}


def test_context(spark):
    c = spark.createDataFrame([("a", "f", 1.0, "current", 50), ("b", "f", 0.8, "callee", 60), ("b", "f", 0.6, "caller", 60), ("c", "g", 0.5, "type", 30), ("d", "g", 0.4, "import", 20)], "symbol string, file string, base_score double, reason string, tokens int")
    ranks = spark.createDataFrame([("g", 0.5)], "file string, pagerank double")
    got = [(r["symbol"], r["primary"]) for r in context.within_budget(context.blend(c, ranks), 100).orderBy(F.desc("score")).collect()]
    assert got == [("a", True), ("c", False), ("d", False)]


def test_coverage_and_naming(spark):
    s = spark.createDataFrame([("s", "f", 10, 15), ("t", "f", 0, 9)], "symbol string, file string, start_line int, end_line int")
    lines = spark.createDataFrame([("f", n, n < 13) for n in range(10, 15)] + [("f", 10, False)], "file string, line int, covered boolean")
    r = analysis.correlate_coverage(s, lines).collect()
    assert [(x["symbol"], x["lines_total"], x["lines_covered"], x["coverage"]) for x in r] == [("s", 5, 3, 0.6)]
    names = spark.createDataFrame([("x", "process"), ("y", "Process"), ("z", "procesz"), ("q", "other")], "symbol string, name string")
    got = {(r["symbol"], r["severity"], round(r["score"], 3)) for r in analysis.naming_conflicts(names, "process").collect()}
    assert got == {("x", "block", 1.0), ("y", "warning", 0.857), ("y", "warning", 0.95), ("z", "warning", 0.857)}
    alt = [(r["symbol"], r["severity"]) for r in analysis.alternatives(spark.createDataFrame([("x", "process"), ("y", "process_all"), ("q", "other")], "symbol string, name string"), "process").collect()]
    assert sorted(alt) == [("x", "warning"), ("y", "info")]


def test_potentially_live(spark):
    s = spark.createDataFrame([("a", "const", []), ("b", "function", ["#[no_mangle]"]), ("c", "function", [])], "scoped_name string, kind string, attributes array<string>")
    assert {r["scoped_name"] for r in analysis.potentially_live(s).collect()} == {"a", "b"}

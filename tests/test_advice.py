"""Cases of the review: each failed before its finding was settled."""

from pyspark.sql import functions as F

from weftline.operators import context, fusion
from weftline.plans import registry

DATA = "/root/testdata/sf0.001"


def test_calls_leave_no_caller_and_no_line_out(spark):
    x = registry._calls(spark, DATA)
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    longer = li.groupBy("l_orderkey").count().where("count > 1").select("l_orderkey")
    first = li.join(longer, "l_orderkey").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("k"))
    assert first.select(F.concat(F.lit("p::"), "k").alias("caller")).join(x, "caller", "left_anti").count() == 0
    assert x.where("cast(substring(caller, 4) as bigint) % 50 <> 0").count() > 0.9 * x.count() > 0


def test_nearest_takes_every_query(spark, monkeypatch):
    monkeypatch.setattr(fusion, "BLOCK", 2, raising=False)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([("x", [2.0, 0.0]), ("y", [0.0, 1.0])], "query_id string, qv array<float>")
    got = {}
    for r in sorted(fusion.nearest(v, q, 3).collect(), key=lambda r: (-r["score"], r["id"])):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got == {"x": [(1, 1.0), (2, 1.0), (5, 0.707107)], "y": [(3, 1.0), (5, 0.707107), (1, 0.0)]}


def test_pagerank_over_whole_tables(spark):
    ids = {r["id"] for r in registry.QUERIES["pagerank"](spark, DATA).collect()}
    for kind, table, key in (("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey")):
        assert {f"{kind}{r[0]}" for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()} <= ids


def test_budget_fold_walks_all_candidates(spark):
    big = spark.range(3000).selectExpr("concat('b', id) symbol", "90L tokens", "1.0 - id / 10000 score")
    small = spark.createDataFrame([("s1", 10, 0.01), ("s2", 10, 0.005), ("huge", 101, 2.0)], "symbol string, tokens bigint, score double")
    got = [r["symbol"] for r in context.within_budget(big.unionByName(small), 100).orderBy(F.desc("score")).collect()]
    assert got == ["b0", "s1"]

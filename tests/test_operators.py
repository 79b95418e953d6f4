"""Reachability, dedup, ids and compat functions on small inputs."""

from pyspark.sql import functions as F

from astrolith.functions import compat
from astrolith.operators import dedup, graph


def test_reachable_with_loops_and_nulls(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 3), (3, 4), (None, 9), (4, None), (7, 8)], "src long, dst long")
    assert {tuple(r) for r in graph.reachable(e, [1, None]).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in graph.reachable(e, [1], max_depth=1).collect()} == {(1, 0), (2, 1)}
    assert graph.reachable(e.limit(0), [5]).count() == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long")
    assert graph.reachable(chain, [0]).agg(F.max("depth")).first()[0] == 14


def test_first_wins_and_ids(spark):
    df = spark.createDataFrame([("b", 2, "x"), ("a", 3, "y"), ("b", 1, "z"), (None, 0, "n"), ("c", 1, "q")], "k string, o long, v string")
    assert {(r.k, r.v) for r in dedup.first_wins(df, ["k"], ["o", "v"]).collect()} == {("b", "z"), ("a", "y"), (None, "n"), ("c", "q")}
    ids = dedup.first_seen_ids(df, "k", ["o", "v"])
    assert {tuple(r) for r in ids.collect()} == {("c", 1), ("b", 2), ("a", 3)}
    assert {(r.v, r.i) for r in dedup.remap(df, ids, "k", "i").collect()} == {("x", 2), ("y", 3), ("z", 2), ("n", 0), ("q", 1)}
    big = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    out = dedup.resequence(big, ["id"], "n").collect()
    assert sorted(r.n for r in out) == list(range(1, 1001)) and all(r.n == r.id + 1 for r in out)
    assert dedup.resequence(big.limit(0), ["id"], "n").count() == 0


def test_compat_functions(spark):
    r = spark.range(1).select(
        compat.int_div(F.lit(-7), F.lit(2)).alias("d"), compat.int_div(F.lit(1), F.lit(0)).alias("z"), compat.scalar_min(F.lit(2), F.lit(None)).alias("m"),
        compat.cast_integer(F.lit("12ab")).alias("c"), compat.cast_integer(F.lit("x")).alias("c0"), compat.trim_chars(F.lit("xaxx"), "x").alias("t"),
        compat.literal_content(F.lit('L"a\\"b"')).alias("l"), compat.is_wide_literal(F.lit('L"a"')).alias("w"), compat.access_name(F.lit("friend")).alias("a"),
        compat.iif(F.lit(True), F.lit(1), F.lit(2)).alias("i"), compat.is_system_path(F.lit("/usr/include/x.h")).alias("s"),
    ).first()
    assert (r.d, r.z, r.m, r.c, r.c0, r.t, r.l, r.w, r.a, r.i, r.s) == (-3, None, None, 12, 0, "a", 'a\\"b', 1, "unknown", 1, 1)


def test_globs(spark):
    df = spark.createDataFrame([("a.cpp",), ("x/b.CPP",), ("x/y/c.cc",), ("x/d.h",)], "path string")
    got = lambda *g: [r.path for r in df.where(compat.matches_globs("path", list(g))).collect()]
    assert got("**/*.cpp") == ["a.cpp", "x/b.CPP"] and got("*.cpp") == ["a.cpp"] and got("x/**") == ["x/b.CPP", "x/y/c.cc", "x/d.h"]
    assert df.where(compat.glob("x/*.[ch]*", "path")).count() == 2
    assert df.where(compat.has_component("path", ["Y"], ignore_case=True)).count() == 1


def test_reach_over_calls_and_inheritance(spark, tmp_path):
    from astrolith.plans.problems import QUERIES

    put = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    put("src_calls", [("a", "b"), ("b", "c"), ("c", "b"), ("z", "c"), ("", "q"), ("q", None)], "caller_usr string, callee_usr string")
    put("src_inheritance", [("d", "b"), ("e", "b"), ("f", "e"), ("b", "f"), ("y", "x"), ("", "x")], "derived_usr string, base_usr string")
    put("src_classes", [("b", "B"), ("d", "D"), ("e", "E"), ("f", "F"), ("x", "X"), ("y", "Y")], "usr string, name string")
    rows = lambda q: {tuple(r) for r in QUERIES[q](spark, str(tmp_path)).collect()}
    assert rows("call_reach") == {("a", 0), ("z", 0), ("b", 1), ("c", 1)}
    assert rows("class_subtree") == {("b", "B", 0), ("d", "D", 1), ("e", "E", 1), ("f", "F", 2)}

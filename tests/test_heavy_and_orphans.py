from datetime import datetime

from astrolith.operators import heavykeys, orphans


def test_heavy_keys_ties_nulls_and_empty(spark):
    df = spark.createDataFrame(
        [("a", "p", 1)] * 50 + [("b", None, 0)] * 2 + [(None, "p", 1)] * 40 + [("", "p", 1)] * 7 + [("A", "", 3)],
        "k string, p string, file_id long",
    )
    assert {tuple(r) for r in heavykeys.heavy_keys(df, "k", 0.02).collect()} == {("a", 50), ("b", 2)}
    assert heavykeys.heavy_keys(df.limit(0), "k").collect() == []
    stats = {r.key_value: tuple(r)[1:] for r in heavykeys.per_key_stats(df, "k", "p").collect()}
    assert stats == {"a": (50, 1, 1, 1), "b": (2, 0, 0, 1), "A": (1, 0, 1, 0)}
    assert heavykeys.per_key_stats(df.limit(0), "k", "p").collect() == []


def test_skew_join_equals_plain_join(spark):
    big = spark.createDataFrame([("h", i) for i in range(200)] + [("x", 1), (None, 2)], "k string, v int")
    small = spark.createDataFrame([("h", 1), ("y", 2)], "k string, w int")
    for how in ("inner", "left", "left_anti", "left_semi"):
        got = sorted(map(str, heavykeys.skew_join(big, small, "k", how).collect()))
        assert got == sorted(map(str, big.join(small, "k", how).collect()))


def test_orphan_states(spark):
    t = lambda m, d=1: datetime(2025, m, d)
    refs = spark.createDataFrame(
        [(1, "here", t(3)), (2, "gone", t(3)), (3, "never", t(3)), (4, "late", t(3)), (5, "late", t(5)),
         (6, None, t(3)), (7, "", t(3)), (8, "same", t(4, 10)), (9, "same", t(4, 20)), (10, "never", t(3))],
        "seq long, base string, loaded_at timestamp",
    )
    parents = spark.createDataFrame(
        [("here", t(1)), ("here", t(6)), ("late", t(4)), ("same", t(4, 15)), (None, t(1))],
        "usr string, loaded_at timestamp",
    )
    gone = spark.createDataFrame([("gone",), ("here",)], "key string")

    def run(r):
        out = orphans.orphans([orphans.Reference("t", r, "base", "s")], {"s": [(parents, "usr")]}, {"s": gone})
        return {(x.seq, x.state) for x in out.collect()}

    assert run(refs) == {(2, "deleted"), (3, "missing"), (4, "late"), (8, "late"), (10, "missing")}
    assert run(refs.limit(0)) == set()


def test_clashing_columns(spark):
    """Columns named like the operators' own do no harm."""
    df = spark.createDataFrame([("a", "p", 1, 7, 8, "x")] * 3, "k string, p string, file_id long, n_rows long, total long, hk string")
    assert [tuple(r) for r in heavykeys.heavy_keys(df, "k", 0.5).collect()] == [("a", 3)]
    assert [tuple(r) for r in heavykeys.per_key_stats(df, "k", "p").collect()] == [("a", 3, 1, 1, 1)]
    small = spark.createDataFrame([("a", 5, 6)], "k string, n_rows long, w long")
    assert heavykeys.skew_join(df, small, "k").columns == [*df.columns, "w"]
    refs = spark.createDataFrame([(1, "z", datetime(2025, 1, 1), "x", "y")], "seq long, base string, loaded_at timestamp, key string, month string")
    gone = spark.createDataFrame([], "key string")
    out = orphans.orphans([orphans.Reference("t", refs, "base", "s")], {"s": [(refs.limit(0), "key")]}, {"s": gone}).collect()
    assert [(r.seq, r.state) for r in out] == [(1, "missing")]


def test_ties_at_the_threshold_are_heavy(spark):
    df = spark.createDataFrame([("a",)] * 7 + [(f"r{i}",) for i in range(343)], "k string")
    assert [tuple(r) for r in heavykeys.heavy_keys(df, "k", 0.02).collect()] == [("a", 7)]


def test_more_heavy_keys_than_a_sketch_names(spark):
    df = spark.range(60_000).selectExpr("concat('k', id % 6000) AS k")
    got = heavykeys.heavy_keys(df, "k", 0.0001).collect()
    assert len(got) == 6000 and {r.n_rows for r in got} == {10}


def test_heavy_values_of_several_tables(spark):
    a = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 'x:y' ELSE CAST(id AS STRING) END AS c")
    b = spark.range(100).selectExpr("CASE WHEN id < 50 THEN 7 ELSE id + 1000 END AS c")
    assert heavykeys.heavy_values_of([(a, "c"), (b, "c")], 0.2) == [["x:y"], ["7"]]

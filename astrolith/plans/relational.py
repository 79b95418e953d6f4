"""The relational surface: one query per operator, each with its SQL.

The queries run over whole tables.  Doubles are rounded, sums and ranks are
cast to bigint, so that both engines give the same types and values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolith.functions import compat
from astrolith.operators import dedup, graph
from astrolith.runtime import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark, d, *names):
    frames = [read(spark, d, n) for n in names]
    return frames[0] if len(frames) == 1 else frames


# -- projection, filter, predicates ------------------------------------------

@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def scan_project(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("SELECT * FROM region")
def scan_star(spark, d):
    return _t(spark, d, "region")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus <> 'F' AND o_totalprice < 50000) OR o_orderpriority = '1-URGENT'")
def filter_and_or_ne(spark, d):
    return _t(spark, d, "orders").where(
        ((F.col("o_orderstatus") != "F") & (F.col("o_totalprice") < 50000)) | (F.col("o_orderpriority") == "1-URGENT")
    ).select("o_orderkey")


@query("SELECT id, name FROM src_methods WHERE is_virtual <> 0")
def int_as_bool(spark, d):
    return _t(spark, d, "src_methods").where(F.col("is_virtual") != 0).select("id", "name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'RED%'")
def like_ci(spark, d):
    return _t(spark, d, "part").where(F.col("p_name").ilike("RED%")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name NOT ILIKE 'red%'")
def not_like(spark, d):
    return _t(spark, d, "part").where(~F.col("p_name").ilike("red%")).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '_%e_ %n'")
def like_wildcards(spark, d):
    return _t(spark, d, "part").where(F.col("p_name").ilike("_%e_ %n")).select("p_partkey", "p_name")


@query("SELECT seq FROM src_calls WHERE callee_usr IS NULL OR callee_usr = ''")
def is_null_or_empty(spark, d):
    return _t(spark, d, "src_calls").where(F.col("callee_usr").isNull() | (F.col("callee_usr") == "")).select("seq")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 100000 THEN 'large' END AS label FROM orders")
def case_no_else(spark, d):
    return _t(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_totalprice") > 100000, "large").alias("label")
    )


@query("SELECT seq, CAST(end_line - line + 1 AS BIGINT) AS lines FROM src_functions WHERE is_definition = 1")
def arith_span(spark, d):
    return _t(spark, d, "src_functions").where(F.col("is_definition") == 1).select(
        "seq", (F.col("end_line") - F.col("line") + 1).cast("bigint").alias("lines")
    )


@query("SELECT 'function' AS kind, seq FROM src_functions UNION ALL SELECT 'method', seq FROM src_methods")
def constant_column(spark, d):
    f, m = _t(spark, d, "src_functions", "src_methods")
    return f.select(F.lit("function").alias("kind"), "seq").unionByName(m.select(F.lit("method").alias("kind"), "seq"))


@query('SELECT seq, col_no AS "column" FROM src_calls')
def reserved_column_name(spark, d):
    return _t(spark, d, "src_calls").select("seq", F.col("col_no").alias("column"))


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey BETWEEN 2 AND 15")
def in_between(spark, d):
    return _t(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3) & F.col("n_nationkey").between(2, 15)).select("n_name")


@query("SELECT id, seq FROM src_functions WHERE return_type IS NOT DISTINCT FROM NULL OR return_type IS NOT DISTINCT FROM 'void'")
def null_safe_equal(spark, d):
    c = F.col("return_type")
    return _t(spark, d, "src_functions").where(c.eqNullSafe(F.lit(None)) | c.eqNullSafe("void")).select("id", "seq")


@query("SELECT id, path FROM src_files WHERE regexp_full_match(path, 'src/.*[.]h', 's')")
def glob_operator(spark, d):
    return _t(spark, d, "src_files").where(compat.glob("src/*.h", "path")).select("id", "path")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
def scalar_subquery(spark, d):
    c = _t(spark, d, "customer")
    mean = c.agg(F.avg("c_acctbal").alias("m"))
    # one row on the right side
    return c.join(F.broadcast(mean), F.col("c_acctbal") > F.col("m")).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def exists_subquery(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    big = o.where(F.col("o_totalprice") > 300000)
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30 AND l_partkey IS NOT NULL)")
def not_in_subquery(spark, d):
    p, line = _t(spark, d, "part", "lineitem")
    sold = line.where(F.col("l_quantity") > 30)
    return p.join(sold, p["p_partkey"] == sold["l_partkey"], "left_anti").select("p_partkey")


# -- joins --------------------------------------------------------------------

@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_id(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name")


@query("SELECT c.seq, f.name AS caller, c.callee_name FROM src_calls c JOIN src_functions f ON c.caller_usr = f.usr WHERE c.is_system = 0 AND c.caller_usr <> ''")
def join_usr(spark, d):
    c, f = _t(spark, d, "src_calls", "src_functions")
    c = c.where((F.col("is_system") == 0) & (F.col("caller_usr") != ""))
    return c.join(f.select("usr", "name"), c["caller_usr"] == F.col("usr")).select("seq", F.col("name").alias("caller"), "callee_name")


@query("SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def left_join_count(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    # aggregated before the join: one row a customer is shuffled
    n = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_three_way(spark, d):
    c, n, r = _t(spark, d, "customer", "nation", "region")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta_self(spark, d):
    n = _t(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(
        F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n FULL OUTER JOIN region r ON n.n_nationkey = r.r_regionkey")
def full_outer(spark, d):
    n, r = _t(spark, d, "nation", "region")
    return n.join(r, n["n_nationkey"] == r["r_regionkey"], "full").select("n_nationkey", "r_regionkey")


@query("SELECT r.r_regionkey, n.n_nationkey FROM nation n RIGHT JOIN region r ON n.n_nationkey = r.r_regionkey + 22")
def right_outer(spark, d):
    n, r = _t(spark, d, "nation", "region")
    return n.join(r, n["n_nationkey"] == r["r_regionkey"] + 22, "right").select("r_regionkey", "n_nationkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_leaf(spark, d):
    o, line = _t(spark, d, "orders", "lineitem")
    return o.join(line.select("l_orderkey"), o["o_orderkey"] == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT DISTINCT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49")
def semi_distinct(spark, d):
    p, line = _t(spark, d, "part", "lineitem")
    line = line.where(F.col("l_quantity") > 49).select("l_partkey")
    return p.join(line, p["p_partkey"] == line["l_partkey"], "left_semi").select("p_name").distinct()


@query("SELECT r_regionkey, r_name, n_name FROM (SELECT r_regionkey, r_name FROM region) JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) USING (r_regionkey)")
def join_using(spark, d):
    r, n = _t(spark, d, "region", "nation")
    return r.select("r_regionkey", "r_name").join(n.select(F.col("n_regionkey").alias("r_regionkey"), "n_name"), "r_regionkey")


# -- aggregation --------------------------------------------------------------

@query("SELECT lang, COUNT(*) AS n, MAX(length(text)) AS longest FROM documents GROUP BY lang")
def group_count(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("n"))


@query("SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag")
def sum_avg(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 70")
def having(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 70)


@query("SELECT o_custkey, COUNT(*) AS n, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def bare_column_first(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("o_orderstatus", "o_orderkey").alias("status"))


@query("SELECT DISTINCT m FROM (SELECT event_type, MIN(user_id) AS m FROM events GROUP BY event_type)")
def distinct_after_group(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.min("user_id").alias("m")).select("m").distinct()


@query("SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 40) AS big, COALESCE(SUM(CAST(CASE WHEN l_quantity > 60 THEN 1 END AS DOUBLE)), 0) AS total FROM lineitem GROUP BY l_returnflag")
def filter_and_total(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 40).alias("big"),
        compat.total(F.when(F.col("l_quantity") > 60, 1)).alias("total"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_concat(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(compat.group_concat("n_name").alias("names"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
def topk_offset(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(10)


@query("SELECT kind, is_abstract, COUNT(*) AS n FROM src_classes GROUP BY CUBE (kind, is_abstract)")
def cube_counts(spark, d):
    return _t(spark, d, "src_classes").cube("kind", "is_abstract").agg(F.count(F.lit(1)).alias("n"))


# -- set operations -----------------------------------------------------------

@query("SELECT COUNT(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)")
def union_all_count(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select("c_name").union(s.select("s_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey AS k FROM region UNION SELECT n_regionkey FROM nation")
def union_distinct(spark, d):
    r, n = _t(spark, d, "region", "nation")
    return r.select(F.col("r_regionkey").alias("k")).union(n.select("n_regionkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def except_keys(spark, d):
    o, line = _t(spark, d, "orders", "lineitem")
    return o.select(F.col("o_orderkey").alias("k")).subtract(line.select("l_orderkey"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(k, v)")
def values_table(spark, d):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL) AS t(k, v)")


# -- windows ------------------------------------------------------------------

def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk,
 CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS q, ROUND(percent_rank() OVER w, 6) AS pr, ROUND(cume_dist() OVER w, 6) AS cd
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rank_family(spark, d):
    w = _by_user()
    big = lambda c, n: c.over(w).cast("bigint").alias(n)
    return _t(spark, d, "events").select(
        "event_id", big(F.row_number(), "rn"), big(F.rank(), "rk"), big(F.dense_rank(), "dr"), big(F.ntile(4), "q"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark, d):
    return _t(spark, d, "events").select("event_id", F.lag("value").over(_by_user()).alias("before"), F.lead("value").over(_by_user()).alias("after"))


@query("SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
def frame_rows(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(F.sum("value").over(_by_user().rowsBetween(-2, 0)), 4).alias("s"))


@query("""SELECT event_id, first_value(event_type) OVER w AS first, last_value(event_type) OVER w AS last, nth_value(event_type, 2) OVER w AS second
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def first_last_nth(spark, d):
    w = _by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _t(spark, d, "events").select(
        "event_id", F.first("event_type").over(w).alias("first"), F.last("event_type").over(w).alias("last"), F.nth_value("event_type", 2).over(w).alias("second"))


# -- recursion and graphs -----------------------------------------------------

@query("""WITH RECURSIVE h AS (SELECT p_partkey AS k, CAST(0 AS BIGINT) AS depth FROM part WHERE p_partkey = 1
 UNION ALL SELECT p.p_partkey, h.depth + 1 FROM part p JOIN h ON p.p_partkey // 2 = h.k WHERE p.p_partkey > 1)
SELECT k, depth FROM h""")
def recursive_hierarchy(spark, d):
    edges = _t(spark, d, "part").where(F.col("p_partkey") > 1).select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    return graph.reachable(edges, [1]).select(F.col("node").alias("k"), "depth")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT caller_usr AS src, callee_usr AS dst FROM src_calls WHERE caller_usr <> '' AND callee_usr <> ''),
r AS (SELECT DISTINCT src AS node, CAST(0 AS BIGINT) AS depth FROM e WHERE src NOT IN (SELECT dst FROM e)
 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3)
SELECT node, MIN(depth) AS depth FROM r GROUP BY node""")
def recursive_callgraph(spark, d):
    """What the callers that nothing calls reach in up to three steps, over all calls."""
    edges = _t(spark, d, "src_calls").where((F.col("caller_usr") != "") & (F.col("callee_usr") != "")).select(F.col("caller_usr").alias("src"), F.col("callee_usr").alias("dst"))
    top = edges.select("src").join(edges.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
    return graph.reachable(edges, top, max_depth=3)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT base_usr AS src, derived_usr AS dst FROM src_inheritance WHERE derived_usr <> '' AND base_usr <> ''),
r AS (SELECT DISTINCT src AS node FROM e UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def bfs_set_semantics(spark, d):
    """All nodes at or below a base, loops included, each once."""
    links = _t(spark, d, "src_inheritance").where((F.col("derived_usr") != "") & (F.col("base_usr") != ""))
    return graph.reachable(links.select(F.col("base_usr").alias("src"), F.col("derived_usr").alias("dst")), links.select("base_usr")).select("node")


# -- project merge ------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def first_wins_dedup(spark, d):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return dedup.first_wins(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_mktsegment AS key, CAST(row_number() OVER (ORDER BY MIN(c_custkey)) AS BIGINT) AS gid FROM customer GROUP BY c_mktsegment")
def first_seen_id(spark, d):
    return dedup.first_seen_ids(_t(spark, d, "customer"), "c_mktsegment", ["c_custkey"])


@query("SELECT DISTINCT c_mktsegment AS key, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS BIGINT) AS gid FROM customer")
def dense_id(spark, d):
    return dedup.first_seen_ids(_t(spark, d, "customer"), "c_mktsegment", ["c_mktsegment"])


@query("""WITH g AS (SELECT c_mktsegment AS s, CAST(row_number() OVER (ORDER BY MIN(c_custkey)) AS BIGINT) AS gid FROM customer GROUP BY c_mktsegment)
SELECT o.o_orderkey, COALESCE(g.gid, 0) AS segment_id FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN g ON g.s = c.c_mktsegment""")
def fk_remap(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    ids = dedup.first_seen_ids(c, "c_mktsegment", ["c_custkey"])
    keyed = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("key")), "o_custkey", "left")
    return dedup.remap(keyed, ids, "key", "segment_id").select("o_orderkey", "segment_id")


@query("SELECT seq, CAST(row_number() OVER (ORDER BY tu_ord, seq) AS BIGINT) AS new_id FROM src_calls")
def resequence_ids(spark, d):
    return dedup.resequence(_t(spark, d, "src_calls"), ["tu_ord", "seq"], "new_id").select("seq", "new_id")


@query("""SELECT usr, id, seq, is_definition FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN usr <> '' THEN usr ELSE '#' || CAST(seq AS VARCHAR) END
 ORDER BY tu_ord, seq) AS rn FROM src_functions) WHERE rn = 1""")
def merged_functions(spark, d):
    key = F.when(F.col("usr") != "", F.col("usr")).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))
    return dedup.first_wins(_t(spark, d, "src_functions").withColumn("__k", key), ["__k"], ["tu_ord", "seq"]).select("usr", "id", "seq", "is_definition")


@query("SELECT derived_usr, base_usr, seq FROM (SELECT *, row_number() OVER (PARTITION BY derived_usr, base_usr ORDER BY tu_ord, seq) AS rn FROM src_inheritance) WHERE rn = 1")
def merged_inheritance(spark, d):
    return dedup.first_wins(_t(spark, d, "src_inheritance"), ["derived_usr", "base_usr"], ["tu_ord", "seq"]).select("derived_usr", "base_usr", "seq")


# -- paths, names, literals ---------------------------------------------------

@query("""SELECT id, seq, regexp_replace(regexp_replace(regexp_replace(path, '^.*[/\\\\]', ''), '[.][^.]*$', ''), '[^A-Za-z0-9]', '_', 'g') AS schema_name FROM src_files""")
def schema_from_path(spark, d):
    return _t(spark, d, "src_files").select("id", "seq", compat.schema_from_path("path").alias("schema_name"))


@query("SELECT id, seq FROM src_files WHERE regexp_full_match(lower(path), '(.*/)?[^/]*[.](cc|cpp)')")
def glob_match(spark, d):
    return _t(spark, d, "src_files").where(compat.matches_globs("path", ["**/*.cc", "**/*.cpp"])).select("id", "seq")


@query("SELECT id, seq FROM src_files WHERE NOT list_has_any(string_split(path, '/'), ['include', 'delta'])")
def exclude_component(spark, d):
    return _t(spark, d, "src_files").where(~compat.has_component("path", ["include", "delta"])).select("id", "seq")


@query("""SELECT id, seq, CASE WHEN contains(path, '.h') THEN 1 ELSE 0 END AS is_header,
 CASE WHEN contains(path, '/usr/include') OR contains(path, '/usr/lib') THEN 1 ELSE 0 END AS is_system_path FROM src_files""")
def path_flags(spark, d):
    return _t(spark, d, "src_files").select("id", "seq", compat.is_header("path").alias("is_header"),
                                            (F.col("path").contains("/usr/include") | F.col("path").contains("/usr/lib")).cast("int").alias("is_system_path"))


@query("SELECT c_custkey, r_name || '::' || n_name || '::' || c_name AS qualified_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def qualified_name(spark, d):
    c, n, r = _t(spark, d, "customer", "nation", "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select("c_custkey", compat.qualified_name("r_name", "n_name", "c_name").alias("qualified_name"))


@query("""SELECT event_id, regexp_extract(props, '"(.*)"', 1, 's') AS content FROM events""")
def extract_literal(spark, d):
    return _t(spark, d, "events").select("event_id", compat.literal_content("props").alias("content"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT user_id, MAX(ts) AS latest FROM events GROUP BY user_id HAVING MAX(ts) > (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) * 0.999 FROM events)""")
def staleness(spark, d):
    e = _t(spark, d, "events")
    cut = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) * 0.999").alias("cut"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("latest"))
    return last.join(F.broadcast(cut), F.col("latest") > F.col("cut")).select("user_id", "latest")


@query("""SELECT seq, substr('hello', 0, 2) AS s, CASE WHEN 2 <> 0 THEN CAST(end_line // 2 AS BIGINT) END AS half,
 CASE WHEN end_column IS NULL OR col_no IS NULL THEN NULL ELSE greatest(end_column, col_no) END AS widest FROM src_functions""")
def sqlite_scalars(spark, d):
    return _t(spark, d, "src_functions").select(
        "seq", compat.substr(F.lit("hello"), 0, 2).alias("s"), compat.int_div(F.col("end_line"), F.lit(2)).cast("bigint").alias("half"),
        compat.scalar_max("end_column", "col_no").alias("widest"))

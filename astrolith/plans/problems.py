"""Queries p1, p3 and p6 over the source-fact tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.operators import graph, heavykeys, orphans
from astrolith.operators.hierarchy import Forest, descendants
from astrolith.runtime import present, read


def inheritance_links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "src_inheritance").select(
        F.col("derived_usr").alias("child"), F.col("base_usr").alias("parent")
    )


def namespace_links(spark: SparkSession, d: str) -> DataFrame:
    ns = read(spark, d, "src_namespaces").where(present("id") & present("parent_id"))
    cl = read(spark, d, "src_classes").where(present("usr") & present("namespace_id"))
    return ns.select(
        F.col("id").cast("string").alias("child"), F.col("parent_id").cast("string").alias("parent")
    ).unionByName(cl.select(F.col("usr").alias("child"), F.col("namespace_id").cast("string").alias("parent")))


TREES = {"inheritance": inheritance_links, "namespace": namespace_links}


def _forest(spark: SparkSession, d: str) -> Forest:
    """One forest of all trees, so that they share the rounds; keys carry their tree's mark."""
    out = None
    for mark, links in zip("in", TREES.values()):
        part = links(spark, d).select(*[
            F.when(F.col(c) != "", F.concat(F.lit(mark), F.col(c))).alias(c) for c in ("child", "parent")])
        out = part if out is None else out.unionByName(part)
    return Forest(out)


def _tree_and(*keys: str):
    tree = F.when(F.substring("node_key", 1, 1) == "i", "inheritance").otherwise("namespace").alias("tree")
    return [tree, *[F.expr(f"substring({k}, 2)").alias(k) for k in keys]]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each node with each root it reaches, and the nodes at or below a loop."""
    return _forest(spark, d).distances().select(*_tree_and("node_key", "root_key"), "depth")


def p1_nested(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, nested-set range and number of nodes below, per node of
    the least-key spanning forest only; p1_all_paths follows all links."""
    return _forest(spark, d).nested(with_path=True).select(
        *_tree_and("node_key", "parent_key", "root_key"), "depth", "pre", "size", "on_loop",
        F.array_join(F.transform("path", lambda k: F.substring(k, 2, 1 << 30)), " > ").alias("path"),
    )


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The nested view without its positions, which SQL can check."""
    return p1_nested(spark, d).drop("pre")


def p1_all_paths(spark: SparkSession, d: str) -> DataFrame:
    """Per node and root it reaches, over all links: depth, path, loop state, nodes below."""
    return _forest(spark, d).all_paths().select(
        *_tree_and("node_key"), "n_parents", F.expr("substring(root_key, 2)").alias("root_key"), "depth", "at_loop", "n_below",
        F.array_join(F.transform("path", lambda k: F.substring(k, 2, 1 << 30)), " > ").alias("path"),
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All classes and namespaces below each namespace with a root, with their distance."""
    nested = Forest(namespace_links(spark, d)).nested()
    asked = read(spark, d, "src_namespaces").select(F.col("id").cast("string").alias("node_key"))
    return descendants(nested, asked)


def p1_tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All nodes below each node of both trees over all links, with the fewest links between them."""
    return _forest(spark, d).descendants().select(*_tree_and("ancestor_key", "node_key"), "distance")


def p3_found_with_month(spark: SparkSession, d: str) -> DataFrame:
    t = {n: read(spark, d, f"src_{n}") for n in (
        "inheritance", "methods", "string_literals", "calls", "classes", "functions")}
    gone = read(spark, d, "removed_entities")

    def removed(kinds: list[str], column: str) -> DataFrame:
        return gone.where(F.col("entity_kind").isin(kinds) & F.col(column).isNotNull()).select(
            F.col(column).cast("string").alias("key"))

    ref = orphans.Reference
    return orphans.orphans(
        [
            ref("src_inheritance", t["inheritance"], "base_usr", "class_usr"),
            ref("src_methods", t["methods"], "class_id", "class_id"),
            ref("src_string_literals", t["string_literals"], "func_id", "function_id"),
            ref("src_calls", t["calls"], "callee_usr", "callable_usr"),
        ],
        {
            "class_usr": [(t["classes"], "usr")],
            "class_id": [(t["classes"], "id")],
            "function_id": [(t["functions"], "id")],
            "callable_usr": [(t["functions"], "usr"), (t["methods"], "usr")],
        },
        {
            "class_usr": removed(["class"], "usr"),
            "class_id": removed(["class"], "entity_id"),
            "function_id": removed(["function"], "entity_id"),
            "callable_usr": removed(["function", "method"], "usr"),
        },
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose reference has no target row, was removed, or arrives later."""
    return p3_found_with_month(spark, d).select("table_name", "seq", "state")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month of arrival and state."""
    return orphans.orphan_report(p3_found_with_month(spark, d))


def call_reach(spark: SparkSession, d: str) -> DataFrame:
    """(usr, depth): all that callers reach which nothing calls, over all of src_calls, and the fewest steps."""
    edges = read(spark, d, "src_calls").where(present("caller_usr") & present("callee_usr")).select(
        F.col("caller_usr").alias("src"), F.col("callee_usr").alias("dst"))
    top = edges.select("src").join(edges.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
    return graph.reachable(edges, top).select(F.col("node").alias("usr"), "depth")


def class_subtree(spark: SparkSession, d: str) -> DataFrame:
    """subclass_tree over src_inheritance below the class name with most derived classes (then the least)."""
    links = read(spark, d, "src_inheritance").where(present("derived_usr") & present("base_usr"))
    classes = read(spark, d, "src_classes")
    names = classes.where(present("usr") & present("name")).select("usr", "name").distinct()
    counts = links.select(F.col("base_usr").alias("usr"), "derived_usr").join(names, "usr").groupBy("name").agg(F.count_distinct("derived_usr").alias("n"))
    most = counts.orderBy(F.desc("n"), "name").limit(1).collect()
    name = most[0]["name"] if most else ""
    return graph.subclass_tree(links, classes, name)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Values holding at least 2 % of all rows of src_calls: the heavy part of the per-key results."""
    parts = [
        f(spark, d).where(F.col("is_heavy") == 1).select(F.lit(c).alias("field_name"), "key_value")
        for c, f in (("callee_name", p6_callee_stats), ("caller_usr", p6_caller_stats))
    ]
    return parts[0].unionByName(parts[1])


def p6_callee_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per callee name: rows, distinct callers, distinct files."""
    return heavykeys.per_key_stats(read(spark, d, "src_calls"), "callee_name", "caller_usr")


def p6_caller_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per caller: rows, distinct callee names, distinct files."""
    return heavykeys.per_key_stats(read(spark, d, "src_calls"), "caller_usr", "callee_name")


_P3 = """
WITH cu AS (SELECT usr AS k, MIN(loaded_at) AS t FROM src_classes WHERE usr <> '' GROUP BY usr),
ci AS (SELECT id AS k, MIN(loaded_at) AS t FROM src_classes WHERE id <> 0 GROUP BY id),
fi AS (SELECT id AS k, MIN(loaded_at) AS t FROM src_functions WHERE id <> 0 GROUP BY id),
au AS (SELECT usr AS k, MIN(loaded_at) AS t FROM (
  SELECT usr, loaded_at FROM src_functions UNION ALL SELECT usr, loaded_at FROM src_methods) x WHERE usr <> '' GROUP BY usr),
r AS (
SELECT 'src_inheritance' AS table_name, s.seq, s.loaded_at, cu.t,
  s.base_usr IN (SELECT usr FROM removed_entities WHERE entity_kind = 'class' AND usr IS NOT NULL) AS gone
  FROM src_inheritance s LEFT JOIN cu ON cu.k = s.base_usr WHERE s.base_usr <> ''
UNION ALL
SELECT 'src_methods', s.seq, s.loaded_at, ci.t,
  s.class_id IN (SELECT entity_id FROM removed_entities WHERE entity_kind = 'class' AND entity_id IS NOT NULL)
  FROM src_methods s LEFT JOIN ci ON ci.k = s.class_id WHERE s.class_id <> 0
UNION ALL
SELECT 'src_string_literals', s.seq, s.loaded_at, fi.t,
  s.func_id IN (SELECT entity_id FROM removed_entities WHERE entity_kind = 'function' AND entity_id IS NOT NULL)
  FROM src_string_literals s LEFT JOIN fi ON fi.k = s.func_id WHERE s.func_id <> 0
UNION ALL
SELECT 'src_calls', s.seq, s.loaded_at, au.t,
  s.callee_usr IN (SELECT usr FROM removed_entities WHERE entity_kind IN ('function', 'method') AND usr IS NOT NULL)
  FROM src_calls s LEFT JOIN au ON au.k = s.callee_usr WHERE s.callee_usr <> ''),
f AS (SELECT table_name, seq, strftime(loaded_at, '%Y-%m') AS month,
  CASE WHEN t IS NULL THEN CASE WHEN gone THEN 'deleted' ELSE 'missing' END WHEN t > loaded_at THEN 'late' END AS state FROM r)
"""

_P6 = """
WITH c AS (SELECT NULLIF({key}, '') AS k, NULLIF({partner}, '') AS p, NULLIF(file_id, 0) AS f FROM src_calls)
SELECT k AS key_value, COUNT(*) AS n_rows, COUNT(DISTINCT p) AS n_partners, COUNT(DISTINCT f) AS n_files,
  CASE WHEN COUNT(*) >= 0.02 * (SELECT COUNT(*) FROM src_calls) THEN 1 ELSE 0 END AS is_heavy
FROM c WHERE k IS NOT NULL GROUP BY k
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_nested": p1_nested,
    "p1_paths": p1_paths,
    "p1_all_paths": p1_all_paths,
    "p1_descendants": p1_descendants,
    "p1_tree_descendants": p1_tree_descendants,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "call_reach": call_reach,
    "class_subtree": class_subtree,
    "p6_found": p6_found,
    "p6_callee_stats": p6_callee_stats,
    "p6_caller_stats": p6_caller_stats,
}

_P1_TREE = """
 e_{t} AS (SELECT DISTINCT c, p FROM ({links}) x),
 n_{t} AS (SELECT c AS n FROM e_{t} UNION SELECT p FROM e_{t}),
 r_{t} AS (SELECT n AS node, n AS anc, CAST(0 AS BIGINT) AS depth FROM n_{t}
   UNION SELECT r.node, e.p, r.depth + 1 FROM r_{t} r JOIN e_{t} e ON e.c = r.anc WHERE r.depth < (SELECT COUNT(*) FROM n_{t})),
 d_{t} AS (SELECT node, anc, MIN(depth) AS depth FROM r_{t} GROUP BY node, anc),
 l_{t} AS (SELECT DISTINCT e.c AS node FROM e_{t} e JOIN d_{t} d ON d.node = e.p AND d.anc = e.c),
 o_{t} AS (SELECT '{t}' AS tree, node AS node_key, anc AS root_key, depth FROM d_{t} WHERE anc NOT IN (SELECT c FROM e_{t})
   UNION ALL SELECT DISTINCT '{t}', d.node, '', CAST(-1 AS BIGINT) FROM d_{t} d JOIN l_{t} l ON l.node = d.anc)"""

_P1_PATHS = """
 e_{t} AS (SELECT c, MIN(p) AS p FROM ({links}) x GROUP BY c),
 n_{t} AS (SELECT c AS n FROM ({links}) x UNION SELECT p FROM ({links}) y),
 w_{t} AS (SELECT n AS node, n AS root, CAST(0 AS BIGINT) AS depth, n AS path FROM n_{t} WHERE n NOT IN (SELECT c FROM e_{t})
   UNION ALL SELECT e.c, w.root, w.depth + 1, w.path || ' > ' || e.c FROM w_{t} w JOIN e_{t} e ON e.p = w.node),
 a_{t} AS (SELECT node AS anc, node FROM w_{t} UNION ALL SELECT e.p, a.node FROM a_{t} a JOIN e_{t} e ON e.c = a.anc),
 s_{t} AS (SELECT anc, COUNT(*) AS size FROM a_{t} GROUP BY anc),
 o_{t} AS (SELECT '{t}' AS tree, n.n AS node_key, e.p AS parent_key, w.root AS root_key, w.depth, s.size,
   CASE WHEN w.node IS NULL THEN 1 ELSE 0 END AS on_loop, w.path
   FROM n_{t} n LEFT JOIN e_{t} e ON e.c = n.n LEFT JOIN w_{t} w ON w.node = n.n LEFT JOIN s_{t} s ON s.anc = n.n)"""

_P1_ALL_PATHS = """
 v_{t} AS (SELECT a.node, a.anc AS root, a.depth, MIN(e.p) AS via FROM o_{t} o JOIN d_{t} a ON a.node = o.node_key AND a.anc = o.root_key
   JOIN e_{t} e ON e.c = a.node JOIN d_{t} b ON b.node = e.p AND b.anc = a.anc AND b.depth = a.depth - 1 GROUP BY ALL),
 w_{t} AS (SELECT node_key AS node, root_key AS root, depth, node_key AS path FROM o_{t} WHERE depth = 0
   UNION ALL SELECT v.node, v.root, v.depth, w.path || ' > ' || v.node FROM w_{t} w JOIN v_{t} v ON v.via = w.node AND v.root = w.root),
 q_{t} AS (SELECT '{t}' AS tree, n.n AS node_key, (SELECT COUNT(*) FROM e_{t} e WHERE e.c = n.n) AS n_parents,
   w.root AS root_key, w.depth, CASE WHEN n.n IN (SELECT node_key FROM o_{t} WHERE depth < 0) THEN 1 ELSE 0 END AS at_loop,
   (SELECT COUNT(*) FROM d_{t} d WHERE d.anc = n.n AND d.node <> n.n) AS n_below, w.path
   FROM n_{t} n LEFT JOIN w_{t} w ON w.node = n.n)"""

_P1_LINKS = (
    ("inheritance", "SELECT derived_usr AS c, base_usr AS p FROM src_inheritance WHERE derived_usr <> '' AND base_usr <> ''"),
    ("namespace", "SELECT CAST(id AS VARCHAR) AS c, CAST(parent_id AS VARCHAR) AS p FROM src_namespaces WHERE id <> 0 AND parent_id <> 0 "
     "UNION ALL SELECT usr, CAST(namespace_id AS VARCHAR) FROM src_classes WHERE usr <> '' AND namespace_id <> 0"),
)

SQL = {
    "p1_paths": "WITH RECURSIVE" + ",".join(_P1_PATHS.format(t=t, links=links) for t, links in _P1_LINKS)
    + " SELECT * FROM o_inheritance UNION ALL SELECT * FROM o_namespace",
    # a shortest way has fewer links than there are nodes, which bounds the recursion
    "p1_found": "WITH RECURSIVE" + ",".join(_P1_TREE.format(t=t, links=links) for t, links in _P1_LINKS) + " SELECT * FROM o_inheritance UNION ALL SELECT * FROM o_namespace",
    "p1_descendants": """
WITH RECURSIVE link AS (
  SELECT DISTINCT CAST(id AS VARCHAR) AS c, CAST(parent_id AS VARCHAR) AS p FROM src_namespaces WHERE id <> 0 AND parent_id <> 0
  UNION SELECT DISTINCT usr, CAST(namespace_id AS VARCHAR) FROM src_classes WHERE usr <> '' AND namespace_id <> 0),
top AS (SELECT DISTINCT p AS n FROM link WHERE p NOT IN (SELECT c FROM link)),
good AS (SELECT n FROM top UNION ALL SELECT l.c FROM link l JOIN good g ON l.p = g.n),
walk AS (
  SELECT l.p AS ancestor_key, l.c AS node_key, 1 AS distance FROM link l JOIN good g ON l.p = g.n
  UNION ALL SELECT w.ancestor_key, l.c, w.distance + 1 FROM walk w JOIN link l ON l.p = w.node_key)
SELECT ancestor_key, node_key, CAST(distance AS BIGINT) AS distance FROM walk
""",
    "p1_all_paths": "WITH RECURSIVE" + ",".join((_P1_TREE + "," + _P1_ALL_PATHS).format(t=t, links=links) for t, links in _P1_LINKS)
    + " SELECT * FROM q_inheritance UNION ALL SELECT * FROM q_namespace",
    "p1_tree_descendants": "WITH RECURSIVE" + ",".join(_P1_TREE.format(t=t, links=links) for t, links in _P1_LINKS) + " UNION ALL ".join(
        f" SELECT '{t}' AS tree, d.anc AS ancestor_key, e.c AS node_key, MIN(d.depth) + 1 AS distance"
        f" FROM e_{t} e JOIN d_{t} d ON d.node = e.p GROUP BY ALL" for t, _ in _P1_LINKS),
    "p3_found": _P3 + "SELECT table_name, seq, state FROM f WHERE state IS NOT NULL",
    "p3_report": _P3 + "SELECT table_name, month, state, COUNT(*) AS n_rows FROM f WHERE state IS NOT NULL GROUP BY ALL",
    "call_reach": """
WITH RECURSIVE e AS (SELECT DISTINCT caller_usr AS src, callee_usr AS dst FROM src_calls WHERE caller_usr <> '' AND callee_usr <> ''),
r AS (SELECT DISTINCT src AS usr, CAST(0 AS BIGINT) AS depth FROM e WHERE src NOT IN (SELECT dst FROM e)
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.usr WHERE r.depth < (SELECT COUNT(*) FROM e))
SELECT usr, MIN(depth) AS depth FROM r GROUP BY usr
""",
    "class_subtree": """
WITH RECURSIVE e AS (SELECT DISTINCT base_usr AS src, derived_usr AS dst FROM src_inheritance WHERE derived_usr <> '' AND base_usr <> ''),
s AS (SELECT c.name FROM src_classes c JOIN e ON e.src = c.usr WHERE c.name <> '' GROUP BY c.name ORDER BY COUNT(DISTINCT e.dst) DESC, c.name LIMIT 1),
r AS (SELECT DISTINCT usr, CAST(0 AS BIGINT) AS depth FROM src_classes WHERE name = (SELECT name FROM s) AND usr IS NOT NULL
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.usr WHERE r.depth < (SELECT COUNT(*) FROM e))
SELECT r.usr, MIN(c.name) AS name, MIN(r.depth) AS depth FROM r JOIN src_classes c ON c.usr = r.usr WHERE c.usr <> '' GROUP BY r.usr
""",
    "p6_found": """
SELECT 'callee_name' AS field_name, callee_name AS key_value FROM src_calls WHERE callee_name <> ''
GROUP BY callee_name HAVING COUNT(*) >= 0.02 * (SELECT COUNT(*) FROM src_calls)
UNION ALL
SELECT 'caller_usr', caller_usr FROM src_calls WHERE caller_usr <> ''
GROUP BY caller_usr HAVING COUNT(*) >= 0.02 * (SELECT COUNT(*) FROM src_calls)
""",
    "p6_callee_stats": _P6.format(key="callee_name", partner="caller_usr"),
    "p6_caller_stats": _P6.format(key="caller_usr", partner="callee_name"),
}

"""Reachability over edge tables that may hold loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.runtime import Scratch


def reachable(edges: DataFrame, start, max_depth: int | None = None) -> DataFrame:
    """(node, depth): nodes reachable from the start nodes, with fewest steps.

    ``edges`` has src and dst; ``start`` is a list of values or a frame with
    one column.  A node is visited once, so loops end the search and paths do
    not multiply.  Each round joins only the last frontier with the edges.
    Edges with a NULL end lead nowhere; start nodes need no edge.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "reach")
    e = scratch.put(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct(), "edges")
    kind = e.schema["src"].dataType
    if not isinstance(start, DataFrame):
        start = spark.createDataFrame([(x,) for x in start], ["node"])
    first = start.select(F.col(start.columns[0]).cast(kind).alias("node")).where(F.col("node").isNotNull()).distinct()
    seen = scratch.put(first.withColumn("depth", F.lit(0).cast("bigint")), "seen")
    frontier, depth = seen, 0
    parts = [seen]
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = e.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        for p in parts:
            nxt = nxt.join(p.select("node"), "node", "left_anti")
        frontier = scratch.put(nxt.withColumn("depth", F.lit(depth).cast("bigint")), "frontier")
        if not frontier.limit(1).count():
            break
        parts.append(frontier)
        if len(parts) > 8:  # keep the plan short on deep graphs
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionByName(p)
            parts = [scratch.put(merged, "seen")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subclass_tree(inheritance: DataFrame, classes: DataFrame, base_name: str) -> DataFrame:
    """(name, depth) of all classes below the classes of that name."""
    edges = inheritance.select(F.col("base_usr").alias("src"), F.col("derived_usr").alias("dst"))
    start = classes.where(F.col("name") == base_name).select("usr")
    names = classes.where(F.col("usr") != "").groupBy("usr").agg(F.min("name").alias("name"))
    return reachable(edges, start).join(names, F.col("node") == F.col("usr")).select("usr", "name", "depth")

"""Merging the facts of many translation units into one project view.

Rows carry ``tu_ord`` and ``seq``; together they are the total order that
"first seen" means.  Ids of entity tables become dense over the project,
references are remapped from (tu_ord, local id) to the project's id, child
tables are renumbered in emission order.  One function serves all twelve
tables; what differs is in ``schemas.TABLES``.

Defined results: a reference that resolves to nothing becomes 0; rows with an
empty key are kept where the table says so and are dropped otherwise (methods,
inheritance never have one); empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.operators import dedup
from astrolith.schemas import TABLES, Table

_ORDER = ["tu_ord", "seq"]


def _key(table: Table) -> Column:
    parts = [F.col(c) for c in table.key]
    joined = F.concat_ws(":", *parts)
    if table.keep_empty:
        own = F.concat(F.lit("\x01"), F.col("tu_ord").cast("string"), F.lit("#"), F.lit(table.name), F.lit("#"), F.col("id").cast("string"))
        return F.when(joined == "", own).otherwise(joined)
    return joined


def _global_ids(staged: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """(key, gid) in first-seen order, and (tu_ord, local id, gid)."""
    keyed = staged.withColumn("__k", _key(table)).where(F.col("__k") != "")
    ids = dedup.first_seen_ids(keyed, "__k", _ORDER)
    local = keyed.groupBy("tu_ord", "id").agg(F.min_by("__k", F.struct("seq", "__k")).alias("key"))
    return ids, local.join(ids, "key").select("tu_ord", F.col("id").alias("local"), "gid")


def merge(staged: dict[str, DataFrame], prefer_definition: bool = False) -> dict[str, DataFrame]:
    """The twelve tables of a project from the staged rows of its units."""
    targets = {t for table in TABLES.values() for t in table.refs.values()} | {n for n, t in TABLES.items() if t.key and not t.dense}
    ids = {n: _global_ids(staged[n], TABLES[n]) for n in targets}
    out = {}
    for name, table in TABLES.items():
        rows = staged[name]
        for column, target in table.refs.items():
            mapping = ids[target][1].select(F.col("tu_ord").alias("__t"), F.col("local").alias("__l"), F.col("gid").alias("__g"))
            rows = (
                rows.join(mapping, (F.col("tu_ord") == F.col("__t")) & (F.col(column) == F.col("__l")), "left")
                .withColumn(column, F.coalesce("__g", F.lit(0)))
                .drop("__t", "__l", "__g")
            )
        if table.key:
            rows = rows.withColumn("__k", _key(table)).where(F.col("__k") != "")
            order = _ORDER
            if prefer_definition and "is_definition" in rows.columns:
                rows = rows.withColumn("__d", 1 - F.col("is_definition"))
                order = ["__d", *_ORDER]
            rows = dedup.first_wins(rows, ["__k"], order)
        if table.dense:
            rows = dedup.resequence(rows.drop("id"), _ORDER, "id")
        elif table.key:
            rows = rows.drop("id").join(ids[name][0].withColumnRenamed("key", "__k").withColumnRenamed("gid", "id"), "__k")
        out[name] = rows.select(*table.column_names)
    return out

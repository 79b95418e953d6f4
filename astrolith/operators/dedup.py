"""First-wins deduplication, first-seen ids, key remap and dense resequencing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from astrolith.runtime import Scratch


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate, not a window: each task keeps one row a key before anything
    is shuffled, so a key that holds most rows costs one row a task.
    """
    columns = df.columns
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__row"))
    return packed.select(*[F.col("__row")[c].alias(c) for c in columns])


def first_seen_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, gid): distinct keys numbered from 1 in order of their first row.

    NULL is not a key.  The numbering is ``resequence`` over the distinct
    keys, so no single task sorts them all.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*order)).alias("__o"))
    return resequence(firsts, ["__o", "key"], "gid").select("key", "gid")


def remap(df: DataFrame, ids: DataFrame, key: str, into: str) -> DataFrame:
    """``key`` replaced by its id; 0 where there is none."""
    renamed = ids.select(F.col("key").alias("__key"), F.col("gid").alias("__gid"))
    return (
        df.join(renamed, F.col(key) == F.col("__key"), "left")
        .withColumn(into, F.coalesce("__gid", F.lit(0)))
        .drop("__key", "__gid")
    )


def resequence(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Dense ids 1..n in the given total order, without one task for all rows.

    Rows are range-partitioned, sorted and numbered in their partition, and
    written once: a second evaluation might cut the ranges elsewhere.  The
    partitions' counts (one row each) give the offsets that are added.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # partition in the upper bits, place in the sorted partition in the lower 33
    numbered = placed.withColumn("__m", F.monotonically_increasing_id())
    numbered = numbered.withColumn("__p", F.shiftright("__m", 33)).withColumn("__n", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m")
    local = Scratch(spark, "resequence").put(numbered, "local")
    counts = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    # as many rows as partitions
    sums = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(sums), F.lit(0)).alias("__off"))
    return local.join(F.broadcast(offsets), "__p").withColumn(into, F.col("__n") + F.col("__off")).drop("__p", "__n", "__off")

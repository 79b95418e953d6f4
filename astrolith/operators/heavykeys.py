"""Per-key results when a few keys hold most rows.

A frequent-items sketch (built map-side, merged in one small aggregate) names
the candidates; an exact recount of only those values confirms them.  There
can be at most ``1 / share`` heavy keys, so the confirmed list is bounded by a
parameter and not by the data; that is why it may be broadcast and collected.
Rows of heavy keys are joined to that list by broadcast and aggregated in two
steps (first on key and partner, so that the key's rows spread over all
tasks); all other rows take an ordinary shuffle on their key; the two results
are put together with a union.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries of the frequent-items sketch; its error is about 3.5 / ITEMS of all rows
ITEMS = 16384
#: candidates that a sketch names at most; smaller shares are counted without one
CANDIDATES = 4096


def heavy_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """Values of ``key`` that hold at least ``share`` of all rows.

    Missing keys (NULL, '') never count as a key, but their rows count in the
    total.  Ties at the threshold are included.  An empty frame gives no rows.
    Where the share allows more than CANDIDATES / 2 heavy keys, no sketch names
    them all: then every key is counted, by map-side aggregation.
    Returns (key_value string, n_rows bigint).
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    k = int(2 / share) + 16
    text = df.select(F.col(key).cast("string").alias("k"))
    known = text.where(F.col("k").isNotNull() & (F.col("k") != ""))
    total = text.agg(F.count(F.lit(1)).alias("total"))
    # decimal, so that a tie at the threshold is one
    least = F.lit(Decimal(str(share))) * F.col("total").cast("decimal(20,0)")
    if k > CANDIDATES:
        counts = known.groupBy(F.col("k").alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows"))
        return counts.join(F.broadcast(total), F.col("n_rows") >= least).select("key_value", "n_rows")
    sketch = known.agg(F.expr(f"approx_top_k(k, {k}, {max(ITEMS, 4 * k)})").alias("top"))
    candidates = sketch.select(F.explode("top.item").alias("key_value"))
    exact = (
        known.join(F.broadcast(candidates), F.col("k") == F.col("key_value"), "left_semi")
        .groupBy(F.col("k").alias("key_value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    # one row on the right: a scalar, not a growing side
    return exact.join(F.broadcast(total), F.col("n_rows") >= least).select("key_value", "n_rows")


def per_key_stats(
    df: DataFrame, key: str, partner: str, file: str = "file_id", share: float = 0.02
) -> DataFrame:
    """Row count, distinct partners and distinct files for every value of ``key``.

    Missing partners and files (NULL, '' or 0) are not counted as values.
    Rows without a key form no group.  Empty input gives no rows.
    Returns (key_value, n_rows, n_partners, n_files, is_heavy int).
    """
    def clean(c: str):
        s = F.col(c).cast("string")
        return F.when((s != "") & (s != "0"), s)

    rows = df.select(
        F.col(key).cast("string").alias("k"), clean(partner).alias("p"), clean(file).alias("f")
    ).where(F.col("k").isNotNull() & (F.col("k") != ""))
    # at most 1/share values: bounded by the parameter
    heavy = [r["key_value"] for r in heavy_keys(df, key, share).collect()]
    spark = df.sparkSession
    listed = spark.createDataFrame([(x,) for x in heavy], "hk string")
    tagged = rows.join(F.broadcast(listed), F.col("k") == F.col("hk"), "left")

    hot = tagged.where(F.col("hk").isNotNull())
    # (key, partner) and (key, file) spread a hot key over all tasks; the last
    # step sees one partial row per task and key
    marks = (
        hot.groupBy("k", "p", "f").agg(F.count(F.lit(1)).alias("n"))
        .select("k", "n", F.explode(F.array(
            F.struct(F.lit("p").alias("what"), F.col("p").alias("v")),
            F.struct(F.lit("f").alias("what"), F.col("f").alias("v")),
        )).alias("x"))
        .select("k", "x.what", "x.v", "n")
        .groupBy("k", "what", "v").agg(F.sum("n").alias("n"))
    )
    hot_stats = marks.groupBy("k").agg(
        F.sum(F.when(F.col("what") == "p", F.col("n"))).alias("n_rows"),
        F.count(F.when((F.col("what") == "p") & F.col("v").isNotNull(), 1)).alias("n_partners"),
        F.count(F.when((F.col("what") == "f") & F.col("v").isNotNull(), 1)).alias("n_files"),
        F.lit(1).alias("is_heavy"),
    )
    rest_stats = (
        tagged.where(F.col("hk").isNull())
        .groupBy("k")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("p").alias("n_partners"),
            F.count_distinct("f").alias("n_files"),
            F.lit(0).alias("is_heavy"),
        )
    )
    return hot_stats.unionByName(rest_stats).withColumnRenamed("k", "key_value")


def heavy_values(df: DataFrame, key: str, share: float = 0.01) -> list:
    """The heavy values of a column as a driver list, at most ``1 / share`` long."""
    return [r["key_value"] for r in heavy_keys(df, key, share).collect()]


def heavy_values_of(columns: list[tuple[DataFrame, str]], share: float = 0.01) -> list[list[str]]:
    """For each (frame, column) its values that hold at least ``share`` of the rows of
    all frames together, by one sketch and one recount; at most ``1 / share`` in all."""
    marked = [df.select(F.concat(F.lit(f"{i}:"), F.col(c).cast("string")).alias("k")) for i, (df, c) in enumerate(columns)]
    found: list[list[str]] = [[] for _ in columns]
    for v in heavy_values(reduce(DataFrame.unionByName, marked), "k", share):
        i, _, value = v.partition(":")
        found[int(i)].append(value)
    return found


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", share: float = 0.01) -> DataFrame:
    """Join on one text key of which a few values may hold most rows of ``big``.

    ``small`` must hold each key at most once, so the broadcast part has at
    most ``1 / share`` rows.  Other keys are joined by an ordinary shuffle.
    ``how`` is inner, left, left_semi or left_anti.  Columns of ``small`` that
    ``big`` has too are left out.
    """
    small = small.select(key, *[c for c in small.columns if c not in big.columns])
    heavy = heavy_values(big, key, share)
    if not heavy:
        return big.join(small, key, how)
    hot = F.col(key).cast("string").isin(heavy)
    a = big.where(hot).join(F.broadcast(small.where(hot)), key, how)
    b = big.where(~hot | hot.isNull()).join(small.where(~hot | hot.isNull()), key, how)
    return a.unionByName(b)

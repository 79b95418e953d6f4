"""References to records that do not exist, by compressed bitmaps.

Keys of one space (class USRs, class ids, function ids, callable USRs) are
dictionary-encoded to integers once.  Referring rows become bitmaps per
period and key range, parents become bitmaps of what had arrived before the
period, and reference AND-NOT parent leaves the keys that need a closer look:
missing, removed, or arrived in the same period or later.  Only the surviving
bits are decoded and joined back to the referring rows, where the exact
arrival decides.  The bitmap work does not depend on how often a key is
referred to, so a key that holds a third of all rows costs one bit.

Defined results: a missing reference (NULL, '' or 0) is no reference; -1 is
one; a NULL arrival of a referring row is later than nothing; repeated rows
each come out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from astrolith.operators.heavykeys import heavy_values_of
from astrolith.runtime import Scratch, present, workers_can_import

#: bits of one bitmap of Spark's bitmap functions
BITS = 32768


@dataclass(frozen=True)
class Reference:
    """One kind of reference: referring table and column, and its key space."""

    table_name: str
    rows: DataFrame
    column: str
    space: str


def _and_not(a: pd.Series, b: pd.Series) -> pd.Series:
    """Positions of the bits of a that are not in b; b may be NULL."""
    out = []
    for x, y in zip(a, b):
        bits = np.frombuffer(x, dtype=np.uint8)
        if y is not None and not (isinstance(y, float) and y != y):
            bits = bits & ~np.frombuffer(y, dtype=np.uint8)
        out.append(np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.int32))
    return pd.Series(out)


def orphans(
    refs: list[Reference],
    parents: dict[str, list[tuple[DataFrame, str]]],
    removed: dict[str, DataFrame],
    arrival: str = "loaded_at",
    row_id: str = "seq",
) -> DataFrame:
    """(table_name, seq, month, state) of every referring row without its target.

    ``parents``: per key space the target tables and key columns; ``removed``:
    per key space a frame with one column ``key`` of removed keys.  state is
    'missing', 'deleted' or 'late' (all target rows arrived after the row).
    """
    spark = refs[0].rows.sparkSession
    workers_can_import(spark)
    scratch = Scratch(spark, "orphans")
    put = scratch.put
    union = lambda frames: reduce(DataFrame.unionByName, frames)

    month = F.date_format(F.col(arrival), "yyyy-MM")
    # distinct before anything is shuffled whole: a hot key leaves one row a task
    wanted = union([
        r.rows.where(present(r.column)).select(
            F.lit(r.space).alias("space"), F.lit(r.table_name).alias("table_name"),
            F.col(r.column).cast("string").alias("key"), F.coalesce(month, F.lit("")).alias("month"),
        )
        for r in refs
    ]).distinct()
    arrived = union([
        df.where(present(col)).select(
            F.lit(space).alias("space"), F.col(col).cast("string").alias("key"), F.col(arrival).alias("at")
        )
        for space, targets in parents.items() for df, col in targets
    ]).groupBy("space", "key").agg(F.min("at").alias("first_at"))
    wanted = put(wanted, "wanted")
    arrived = put(arrived, "arrived")

    # dictionary: dense within each task's block of codes
    keys = wanted.select("space", "key").unionByName(arrived.select("space", "key")).distinct()
    coded = put(keys.select("space", "key", F.monotonically_increasing_id().alias("code")), "dictionary")
    bit = F.pmod(F.col("code"), F.lit(BITS)).cast("int")
    bucket = F.shiftright(F.col("code"), 15)

    ref_bits = (
        wanted.join(coded, ["space", "key"])
        .groupBy("space", "table_name", "month", bucket.alias("bucket"))
        .agg(F.bitmap_construct_agg(bit).alias("ref_map"))
    )
    parent_months = (
        arrived.join(coded, ["space", "key"])
        .groupBy("space", bucket.alias("bucket"), F.date_format("first_at", "yyyy-MM").alias("month"))
        .agg(F.bitmap_construct_agg(bit).alias("map"))
    )
    # what had arrived before the month: a running OR along the months of each bucket, in which
    # a month's references stand before its parents; as many rows a bucket as it has months and tables
    ordered = ref_bits.withColumn("map", F.lit(None).cast("binary")).unionByName(
        parent_months.select("space", F.lit(None).cast("string").alias("table_name"), "month", "bucket", F.lit(None).cast("binary").alias("ref_map"), "map"))
    along = Window.partitionBy("space", "bucket").orderBy("month", F.col("map").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    survive = F.pandas_udf(_and_not, ArrayType(IntegerType()))
    alive = (
        ordered.withColumn("parent_map", F.bitmap_or_agg("map").over(along)).where(F.col("ref_map").isNotNull())
        .select("space", "table_name", "month", "bucket",
                F.explode(survive("ref_map", "parent_map")).alias("pos"))
        .select("space", "table_name", "month", (F.col("bucket") * BITS + F.col("pos")).alias("code"))
    )
    gone = union([
        df.select(F.lit(space).alias("space"), F.col("key").cast("string").alias("key"))
        for space, df in removed.items()
    ]).distinct().withColumn("removed", F.lit(True))
    suspects = put(
        alive.join(coded, ["space", "code"])
        .join(arrived, ["space", "key"], "left")
        .join(gone, ["space", "key"], "left")
        .select("table_name", "key", "month", "first_at", F.coalesce("removed", F.lit(False)).alias("removed")),
        "suspects",
    )

    out = []
    # at most 100 keys are heavy in all; each has one suspect row a month
    heavies = heavy_values_of([(r.rows.where(present(r.column)), r.column) for r in refs])
    for r, heavy in zip(refs, heavies):
        rows = r.rows.where(present(r.column)).select(
            F.col(row_id).alias("seq"), F.col(r.column).cast("string").alias("key"),
            F.col(arrival).alias("at"), F.coalesce(month, F.lit("")).alias("month"),
        )
        mine = suspects.where(F.col("table_name") == r.table_name).drop("table_name")
        hot = F.col("key").isin(heavy) if heavy else F.lit(False)
        joined = rows.where(~hot).join(mine.where(~hot), ["key", "month"])
        if heavy:
            joined = joined.unionByName(rows.where(hot).join(F.broadcast(mine.where(hot)), ["key", "month"]))
        state = (
            F.when(F.col("first_at").isNull(), F.when(F.col("removed"), "deleted").otherwise("missing"))
            .when(F.col("first_at") > F.col("at"), "late")
        )
        out.append(joined.select(F.lit(r.table_name).alias("table_name"), "seq", "month", state.alias("state"))
                   .where(F.col("state").isNotNull()))
    return union(out)


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, month and state."""
    return found.groupBy("table_name", "month", "state").agg(F.count(F.lit(1)).alias("n_rows"))

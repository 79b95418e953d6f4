"""Best representative of each duplicate group by skyline selection.

Rows of a group are compared on trust, recency and the presence of each field.
A row is dominated when another is at least as good in all of these and better
in one.  Recency ends in the unique row number, so two rows never tie in all,
and a row that dominates another also precedes it in the lexicographic policy
(trust, then recency).  Only the latest row of each combination of trust and
present fields can be undominated, so a group is first reduced, map-side, to
at most 2 * 2^fields rows, however many rows it has; the layers of the skyline
are peeled within those, and each field is filled from the first layer, in
policy order, that has it.

With presence kept per field (not as a count) the fill is exact: the
best-ranked row that has a field is never dominated, because a dominating row
would have the field too and rank before it.  So a field's value does not
depend on which other fields are compared, and ``records`` takes any number of
fields in blocks of ``MAX_FIELDS``, each with a skyline of its own.

Defined results: missing keys (NULL, '') form no group; groups of one row give
nothing, except in ``records``, which gives one row for every key; NULL trust counts as untrusted; NULL recency is oldest; a field that
no row has gives no value; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolith.runtime import present

#: fields of one skyline; ``records`` takes more in blocks
MAX_FIELDS = 6


def skyline(
    df: DataFrame, key: str, trust: Column, recency: list[str], fields: list[str], carry: list[str] = (), whole: list[str] = (), least_rows: int = 2
) -> DataFrame:
    """One row per group of ``least_rows`` or more: the key, ``n_rows`` and ``reps``.

    ``reps`` holds the latest row per combination of trust and present fields,
    in policy order, as structs (trust, at, mask, vals, layer); ``at`` ends in the
    row number, which is the last column of ``recency``.  Fields in ``whole`` are
    missing only where NULL.
    """
    if not 0 < len(fields) <= MAX_FIELDS:
        raise ValueError(f"between 1 and {MAX_FIELDS} fields; records() takes more")
    has = lambda f: F.col(f).isNotNull() if f in whole else present(f)
    mask = sum((F.when(has(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    vals = F.struct(*[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    rows = df.where(present(key)).select(
        F.col(key).alias("k"), F.coalesce(trust.cast("int"), F.lit(0)).alias("trust"), mask.alias("mask"),
        F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(recency)]).alias("at"), vals.alias("vals"),
    )
    best = rows.groupBy("k", "trust", "mask").agg(
        F.max_by("vals", "at").alias("vals"), F.max("at").alias("at"), F.count(F.lit(1)).alias("n")
    )
    # at most 2 * 2^fields structs a group
    groups = best.groupBy("k").agg(
        F.sum("n").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct("trust", "at", "mask", "vals")), asc=False).alias("sorted"),
    ).where(F.col("n_rows") >= least_rows)
    # in policy order every dominating row stands before the row it dominates
    with_layer = F.expr("""
        aggregate(sorted, cast(array() as array<struct<trust:int,at:struct<%s>,mask:int,vals:struct<%s>,layer:int>>),
          (done, x) -> concat(done, array(named_struct(
            'trust', x.trust, 'at', x.at, 'mask', x.mask, 'vals', x.vals,
            'layer', 1 + coalesce(array_max(transform(
               filter(done, y -> (y.mask & x.mask) = x.mask and y.trust >= x.trust and y.at > x.at),
               y -> y.layer)), 0)))))
    """ % (_fields(groups, "at"), _fields(groups, "vals")))
    return groups.select("k", "n_rows", with_layer.alias("reps"))


def _fields(groups: DataFrame, name: str) -> str:
    inner = groups.schema["sorted"].dataType.elementType[name].dataType
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in inner.fields)


def _filled(i: int) -> Column:
    """The struct that gives field i: least layer, then policy order."""
    has = F.filter("reps", lambda r: r["mask"].bitwiseAND(F.lit(1 << i)) != 0)
    first = F.array_min(F.transform(has, lambda r: r["layer"]))
    return F.get(F.filter(has, lambda r: r["layer"] == first), F.lit(0))


def field_sources(sky: DataFrame, fields: list[str], row_no: str) -> DataFrame:
    """(k, field_name, seq): which row gives each field of the survivor."""
    picks = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field_name"), _filled(i)["at"][row_no].alias("seq")) for i, f in enumerate(fields)]),
        lambda p: p["seq"].isNotNull(),
    )
    return sky.select("k", F.explode(picks).alias("p")).select("k", "p.field_name", "p.seq")


def survivors(sky: DataFrame, fields: list[str]) -> DataFrame:
    """One built record per group: its key, number of rows, and filled fields."""
    return sky.select("k", "n_rows", *[_filled(i)["vals"][f"v{i}"].alias(f) for i, f in enumerate(fields)])


def records(df: DataFrame, key: str, trust: Column, recency: list[str], whole: list[str] = (), least_rows: int = 1) -> DataFrame:
    """One built record per key, groups of one row included: the key, ``n_rows``
    and every other column, filled by a skyline for each block of MAX_FIELDS.

    Columns in ``whole`` (flags, counters, times) lack a value only where they
    are NULL; in all others '' and 0 are missing too and come out as NULL.
    """
    fields = [c for c in df.columns if c != key]
    out = None
    for i in range(0, len(fields), MAX_FIELDS):
        block = fields[i : i + MAX_FIELDS]
        part = survivors(skyline(df, key, trust, recency, block, whole=whole, least_rows=least_rows), block)
        # the blocks are partitioned by the key already
        out = part if out is None else out.join(part.drop("n_rows"), "k")
    return out.withColumnRenamed("k", key)

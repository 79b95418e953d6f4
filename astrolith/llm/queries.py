"""Queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.llm import bpe, langid, leakage, residue, secrets, survivors
from astrolith.runtime import read

P5_TABLES = {
    "src_functions": ["qualified_name", "return_type", "file_id"],
    "src_classes": ["qualified_name", "kind", "file_id"],
}

#: columns where '' and 0 are missing, and those where only NULL is
P5_RECORDS = {
    "src_functions": (
        ["id", "name", "qualified_name", "return_type", "file_id", "line", "col_no", "end_line", "end_column"],
        ["is_definition", "is_inline", "is_variadic", "is_static", "is_system", "tu_ord", "seq", "loaded_at"],
    ),
    "src_classes": (
        ["id", "name", "qualified_name", "kind", "file_id", "line", "namespace_id"],
        ["is_definition", "is_abstract", "is_system", "tu_ord", "seq", "loaded_at"],
    ),
}


def _sky(spark: SparkSession, d: str, table: str) -> DataFrame:
    return survivors.skyline(
        read(spark, d, table), "usr", F.col("is_definition") == 1, ["loaded_at", "seq"], P5_TABLES[table]
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Which row gives each field of the surviving record of every USR."""
    parts = [
        survivors.field_sources(_sky(spark, d, t), fields, "r1")
        .select(F.lit(t).alias("table_name"), F.col("k").alias("usr"), "field_name", "seq")
        for t, fields in P5_TABLES.items()
    ]
    return parts[0].unionByName(parts[1])


def p5_functions(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every function with several rows."""
    return survivors.survivors(_sky(spark, d, "src_functions"), P5_TABLES["src_functions"]).withColumnRenamed("k", "usr")


def _records(spark: SparkSession, d: str, table: str) -> DataFrame:
    return survivors.records(
        read(spark, d, table), "usr", F.col("is_definition") == 1, ["loaded_at", "seq"], P5_RECORDS[table][1]
    ).select("usr", "n_rows", *P5_RECORDS[table][0], *P5_RECORDS[table][1])


def p5_function_records(spark: SparkSession, d: str) -> DataFrame:
    """One built record of every function with a USR, with all columns."""
    return _records(spark, d, "src_functions")


def p5_class_records(spark: SparkSession, d: str) -> DataFrame:
    """One built record of every class with a USR, with all columns."""
    return _records(spark, d, "src_classes")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_column(read(spark, d, "documents"))


def _p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return secrets.score(read(spark, d, "src_string_literals"), read(spark, d, "src_files"), least=secrets.THRESHOLD).where(
        F.col("score") >= secrets.THRESHOLD
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Literals that hold an actual secret value."""
    return _p2_scores(spark, d).select("id").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The literals of p2_found with the secret taken out of their spelling."""
    return secrets.redacted(read(spark, d, "src_string_literals"), _p2_scores(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Literals that hold a sentence of a human language, with that language."""
    return langid.identify(read(spark, d, "src_string_literals")).select("id", "lang")


def p4_file_share(spark: SparkSession, d: str) -> DataFrame:
    """Per file: share of natural-language characters in all literal characters."""
    t = read(spark, d, "src_string_literals")
    # two partial sums a file and task: a file that holds most rows stays cheap
    found = langid.measure(t, keep=("file_id",))
    # files of blank literals only have no text to share
    blank = t.where(~F.coalesce(F.length(F.trim("content")) > 0, F.lit(False))).select("file_id", F.lit(0).cast("long").alias("n_natural"), F.lit(0).cast("long").alias("n_chars"))
    return found.select("file_id", "n_natural", "n_chars").unionByName(blank).groupBy("file_id").agg(
        F.sum("n_chars").alias("n_chars"), F.sum("n_natural").alias("n_natural")
    ).select("file_id", "n_chars", "n_natural", F.when(F.col("n_chars") > 0, F.col("n_natural") / F.col("n_chars")).otherwise(0.0).alias("share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that repeat at least 15 consecutive words of an evaluation item."""
    return leakage.find(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaking pages per evaluation item."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which template residue or a viewer message stands."""
    return residue.find(read(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of near-duplicate residue segments and their pages."""
    return residue.classes(read(spark, d, "documents"))


def _p5_sql(table: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS table_name, usr, '{f}' AS field_name,
  arg_max(seq, {{'d': CASE WHEN is_definition = 1 THEN 1 ELSE 0 END, 't': loaded_at, 's': seq}}) AS seq
FROM {table} WHERE usr <> '' AND usr IN (SELECT usr FROM {table} GROUP BY usr HAVING COUNT(*) > 1)
  AND {f} IS NOT NULL AND CAST({f} AS VARCHAR) NOT IN ('', '0') GROUP BY usr"""
        for f in P5_TABLES[table]
    )


def _p5_records_sql(table: str) -> str:
    some, whole = P5_RECORDS[table]
    null_only = [_p5_value(f).replace(f"CAST({f} AS VARCHAR) NOT IN ('', '0')", f"{f} IS NOT NULL") for f in whole]
    return "SELECT usr, COUNT(*) AS n_rows, " + ", ".join([*map(_p5_value, some), *null_only]) + f" FROM {table} WHERE usr <> '' GROUP BY usr"


def _p5_value(f: str) -> str:
    return f"""arg_max({f}, {{'d': CASE WHEN is_definition = 1 THEN 1 ELSE 0 END, 't': loaded_at, 's': seq}})
  FILTER (WHERE CAST({f} AS VARCHAR) NOT IN ('', '0')) AS {f}"""


QUERIES = {
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p4_found": p4_found,
    "p4_file_share": p4_file_share,
    "p5_found": p5_found,
    "p5_functions": p5_functions,
    "p5_function_records": p5_function_records,
    "p5_class_records": p5_class_records,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
}

SQL = {
    "p5_found": _p5_sql("src_functions") + "\nUNION ALL\n" + _p5_sql("src_classes"),
    "p5_functions": "SELECT usr, COUNT(*) AS n_rows, " + ", ".join(map(_p5_value, P5_TABLES["src_functions"]))
    + " FROM src_functions WHERE usr <> '' GROUP BY usr HAVING COUNT(*) > 1",
    "p5_function_records": _p5_records_sql("src_functions"),
    "p5_class_records": _p5_records_sql("src_classes"),
}

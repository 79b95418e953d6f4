"""C and C++ sources as a Spark data source.

``cpp_facts`` has one partition per file; its reader walks a unit once and
yields tagged rows (table, tu_ord, seq, row as JSON).  The twelve tables are
projections of that one staging frame, which is written once, split by table,
so that reading one table reads only its rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from astrolith.runtime import Scratch, workers_can_import
from astrolith.schemas import TABLES, staged as staged_schema

STAGING_SCHEMA = "table_name string, tu_ord int, tu_path string, seq bigint, payload string"


class _File(InputPartition):
    def __init__(self, order: int, path: str, args: list[str]):
        self.order, self.path, self.args = order, path, args


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])

    def partitions(self):
        return [_File(i, f["path"], f["args"]) for i, f in enumerate(self.files)]

    def read(self, partition):
        from astrolith.sources import lite

        try:
            rows = lite.extract(partition.path, partition.args)
        except (OSError, UnicodeError, IndexError, RecursionError) as e:
            yield ("parse_status", partition.order, partition.path, 0, json.dumps({"status": "failed", "error": str(e)[:200]}))
            return
        for seq, (table, row) in enumerate(rows):
            yield (table, partition.order, partition.path, seq, json.dumps(row, ensure_ascii=False))
        yield ("parse_status", partition.order, partition.path, len(rows), json.dumps({"status": "ok", "error": ""}))


class CppFacts(DataSource):
    """``spark.read.format('cpp_facts').option('files', json)``."""

    @classmethod
    def name(cls):
        return "cpp_facts"

    def schema(self):
        return STAGING_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def staging(spark: SparkSession, files: list[str], args: list[str] = (), per_file: dict[str, list[str]] | None = None) -> DataFrame:
    workers_can_import(spark)
    spark.dataSource.register(CppFacts)
    listed = [{"path": f, "args": list((per_file or {}).get(f, args))} for f in files]
    return spark.read.format("cpp_facts").option("files", json.dumps(listed)).load()


def extract(spark: SparkSession, files: list[str], args: list[str] = (), staged: bool = False, per_file=None) -> dict[str, DataFrame]:
    """The twelve tables of the files; with ``staged`` also tu_ord and seq."""
    rows = Scratch(spark, "cpp").put(staging(spark, files, args, per_file), "staging")
    out = {}
    for name, table in TABLES.items():
        schema = table.schema
        df = rows.where(F.col("table_name") == name).select(F.from_json("payload", schema).alias("r"), "tu_ord", "seq")
        df = df.select("r.*", "tu_ord", "seq")
        out[name] = df.select(*staged_schema(table).names) if staged else df.select(*schema.names)
    return out


def parse_status(spark: SparkSession, files: list[str], args: list[str] = ()) -> DataFrame:
    """path, status (ok or failed) and error of each file."""
    rows = staging(spark, files, args).where(F.col("table_name") == "parse_status")
    return rows.select(F.col("tu_path").alias("path"), F.from_json("payload", "status string, error string").alias("r")).select("path", "r.*")

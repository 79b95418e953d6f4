"""Facts that follow their sources: a file stream over changed sources.

The stream lists source files by path and modification time; each micro-batch
replaces the facts of the changed units in the fact table (a Parquet folder
partitioned by unit), so a query always sees one version of each unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def changed_files(spark: SparkSession, folder: str, glob: str = "*.cpp") -> DataFrame:
    """A stream of (path, modificationTime) of new or rewritten files."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .load(folder).select("path", "modificationTime")
    )


def latest_versions(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """The newest version of each file, late listings up to the watermark."""
    return files.withWatermark("modificationTime", late).groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))


def stale(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose modification is newer than the facts made of them, or that have none."""
    made = facts.groupBy("path").agg(F.max("parsed_at").alias("parsed_at"))
    return files.join(made, "path", "left").where(F.col("parsed_at").isNull() | (F.col("modificationTime") > F.col("parsed_at"))).select("path")


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, args: list[str] = (), glob: str = "*.cpp") -> StreamingQuery:
    """Keep ``target`` (partitioned by unit) up to date with ``folder``."""
    from astrolith.sources import cpp

    def batch(df: DataFrame, _: int) -> None:
        # one row a changed file: the unit of planning, not data
        paths = [r["path"].removeprefix("file:").replace("///", "/") for r in df.select("path").distinct().collect()]
        if not paths:
            return
        rows = cpp.staging(spark, paths, list(args)).withColumn("unit", F.sha2("tu_path", 256).substr(1, 16))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(target)

    return (
        changed_files(spark, folder, glob).writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and tumbling window; rows beyond the watermark are late
    and are not counted.  Works on streams and on tables."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
    )

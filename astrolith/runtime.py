"""Session-level helpers: shared storage for cut lineage, worker import path.

Iterative operators cut their lineage by writing a Parquet table into the
folder that the session names in ``spark.checkpoint.dir``.  A written table
survives the loss of any executor, is compressed and column-pruned, and is
the reason no operator in this package keeps state in executor memory only.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    ``spark.checkpoint.dir`` decides.  Only when it is unset (tests, a single
    machine) a folder of our own is made and set for the context.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="astrolith-")
        atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def workers_can_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if _PACKAGE_ROOT not in (known + ":" + os.environ.get("PYTHONPATH", "")).split(":"):
        sc.environment["PYTHONPATH"] = ":".join(x for x in (known, _PACKAGE_ROOT) if x)


class Scratch:
    """Written tables of one operator run, under the shared folder.

    ``put`` writes a frame and returns the frame that reads it back.  ``drop``
    removes tables that a loop has left behind.  What is still there when the
    driver's JVM ends is removed then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/astrolith/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        fs, p = self._at(self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._astrolith_path = path
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_astrolith_path", None)
            if path:
                self._delete(path)

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def present(column: str):
    """True where a text or number refers to something: not NULL, '' or 0."""
    c = F.col(column)
    text = c.cast("string")
    # the type is known when the query is planned, so one branch remains
    return c.isNotNull() & F.when(F.typeof(c) == "string", text != "").otherwise(text != "0")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

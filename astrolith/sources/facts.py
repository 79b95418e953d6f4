"""Facts as Parquet: reading, writing, and a cache checked by mtimes."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession

from astrolith.schemas import TABLES

#: seconds by which modification times may differ
TOLERANCE = 2.0
VERSION = 1


def read(spark: SparkSession, folder: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    """The fact tables that the folder holds."""
    return {n: spark.read.schema(TABLES[n].schema).parquet(f"{folder}/{n}.parquet") for n in names if os.path.exists(f"{folder}/{n}.parquet") or "://" in folder}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder a table, split by ``is_system`` so that the usual
    ``is_system = 0`` reads only its own files."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("is_system") if "is_system" in df.columns else w).parquet(f"{folder}/{name}.parquet")


class FactCache:
    """Facts of single files, valid while no source or include has changed."""

    def __init__(self, spark: SparkSession, folder: str, verbose: bool = False):
        self.spark, self.folder, self.verbose = spark, folder, verbose
        self.hits = self.misses = 0

    def key(self, path: str, args: list[str]) -> str:
        h = lambda x: hashlib.sha256(json.dumps(x).encode()).hexdigest()[:16]
        return f"{h(os.path.abspath(path))}_{h(list(args))}"

    def _at(self, path: str, args: list[str]) -> str:
        return os.path.join(self.folder, self.key(path, args))

    def is_valid(self, path: str, args: list[str]) -> bool:
        try:
            with open(os.path.join(self._at(path, args), "meta.json"), encoding="utf-8") as f:
                meta = json.load(f)
            return meta["version"] == VERSION and all(
                os.path.exists(p) and abs(os.path.getmtime(p) - m) <= TOLERANCE for p, m in [[path, meta["mtime"]], *meta["includes"]])
        except (OSError, ValueError, KeyError):
            return False

    def load(self, path: str, args: list[str]) -> dict[str, DataFrame] | None:
        ok = self.is_valid(path, args)
        self.hits += ok
        self.misses += not ok
        if self.verbose:
            print(f"cache {'hit' if ok else 'miss'}: {path}", file=sys.stderr)
        if not ok:
            return None
        return {n: df.select(*TABLES[n].column_names) for n, df in read(self.spark, self._at(path, args)).items()}

    def save(self, path: str, args: list[str], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        from astrolith.sources import lite

        at = self._at(path, args)
        write(tables, at)
        includes = [[p, os.path.getmtime(p)] for p in lite.inclusions(path, list(args))]
        meta = {"version": VERSION, "source": path, "mtime": os.path.getmtime(path), "args": list(args), "includes": includes}
        with open(os.path.join(at, "meta.json"), "w", encoding="utf-8") as f:
            json.dump(meta, f)
        return {n: df.select(*TABLES[n].column_names) for n, df in read(self.spark, at).items()}

    def clear(self, path: str | None = None, args: list[str] = ()) -> int:
        """Remove one entry or all; returns how many."""
        names = [self.key(path, list(args))] if path else (os.listdir(self.folder) if os.path.isdir(self.folder) else [])
        gone = [n for n in names if os.path.isfile(os.path.join(self.folder, n, "meta.json"))]
        for n in gone:
            shutil.rmtree(os.path.join(self.folder, n))
        return len(gone)

    def stats(self) -> dict[str, int]:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        size = sum(os.path.getsize(os.path.join(d, f)) for n in names for d, _, fs in os.walk(os.path.join(self.folder, n)) for f in fs)
        return {"entries": len(names), "bytes": size, "hits": self.hits, "misses": self.misses}

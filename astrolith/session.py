"""Sessions: attached fact schemas as views, queries in two dialects.

``FactSession`` holds a SparkSession and a dictionary of attached schemas.
A schema's tables are temporary views named ``<prefix>_<table>`` (no prefix
for a single attachment or a project).  ``query`` takes Spark SQL or, with
``dialect='compat'``, the embedded engine's SQL.
"""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from astrolith.plans import dialect
from astrolith.plans.merge import merge
from astrolith.runtime import Scratch
from astrolith.schemas import TABLES
from astrolith.sources import compile_db, cpp, discovery, facts

_IDENTIFIER = re.compile(r"[A-Za-z_]\w*\Z")
INTEGER_COLUMNS = frozenset(f.name.lower() for t in TABLES.values() for f in t.schema if f.dataType.typeName() in ("long", "integer"))


#: rows that ``exec`` brings to the driver at most
MOST_ROWS = 200_000


class SessionError(RuntimeError):
    pass


@dataclass
class Attached:
    """One attached schema: where it came from and which views it owns."""

    schema: str
    path: str
    args: list[str] = field(default_factory=list)
    parsed_at: float = 0.0
    views: list[str] = field(default_factory=list)


class FactSession:
    """Attach sources or facts, then query them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.schemas: dict[str, Attached] = {}
        self.default_args: list[str] = []
        self.compile_db: list[compile_db.Command] | None = None
        self._commands: dict[str, compile_db.Command] = {}
        self.cache: facts.FactCache | None = None
        self.last_error = ""
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "100000")
        self._catalog_views()

    # -- arguments, compile database, cache ---------------------------------

    def set_default_args(self, args: list[str]) -> None:
        self.default_args = list(args)

    def add_default_arg(self, arg: str) -> None:
        self.default_args.append(arg)

    def clear_default_args(self) -> None:
        self.default_args = []

    def load_compile_commands(self, path: str) -> bool:
        self.compile_db = compile_db.load(path)
        self._commands = compile_db.by_path(self.compile_db or [])
        return self.compile_db is not None

    def enable_cache(self, folder: str, verbose: bool = False) -> None:
        self.cache = facts.FactCache(self.spark, folder, verbose)

    def disable_cache(self) -> None:
        self.cache = None

    def clear_cache(self) -> int:
        return self.cache.clear() if self.cache else 0

    def arguments(self, path: str, args: list[str]) -> list[str]:
        """Compile database first, then defaults, then per-attachment."""
        found = self._commands.get(os.path.realpath(path))
        return [*(compile_db.extract_flags(found) if found else []), *self.default_args, *args]

    # -- attaching -----------------------------------------------------------

    def attach(self, path: str, schema: str | None = None, args: list[str] = (), prefix: bool = True) -> Attached:
        """Parse one source file (or read its cached facts) and register it."""
        schema = schema or discovery.schema_from_path(path)
        self._free(schema)
        if not os.path.isfile(path):
            raise SessionError(f"cannot parse {path}")
        args = self.arguments(path, list(args))
        tables = self.cache.load(path, args) if self.cache else None
        if tables is None:
            tables = cpp.extract(self.spark, [path], args)
            if self.cache:
                tables = self.cache.save(path, args, tables)
        return self._register(schema, path, args, tables, prefix)

    def attach_project(self, config: discovery.ProjectConfig, schema: str = "", prefer_definition: bool = False) -> Attached:
        """Parse a directory's files in parallel and register the merged tables."""
        self._free(schema)
        files = discovery.project_files(config)
        if not files:
            raise SessionError("no source files")
        staged = cpp.extract(self.spark, files, [*config.flags(), *self.default_args], staged=True,
                             per_file={f: self.arguments(f, config.flags()) for f in files} if self.compile_db else None)
        scratch = Scratch(self.spark, "project")
        merged = {n: scratch.put(df, n) for n, df in merge(staged, prefer_definition).items()}
        return self._register(schema, config.root_path, [], merged, bool(schema))

    def attach_facts(self, tables: dict[str, DataFrame], schema: str = "", path: str = "") -> Attached:
        """Register ready fact tables, whatever made them."""
        self._free(schema)
        return self._register(schema, path, [], tables, bool(schema))

    def attach_parquet(self, folder: str, schema: str = "") -> Attached:
        """Register a folder of ``<table>.parquet`` facts."""
        self._free(schema)
        return self._register(schema, folder, [], facts.read(self.spark, folder), bool(schema))

    def detach(self, schema: str) -> bool:
        a = self.schemas.pop(schema, None)
        if a is None:
            return False
        for v in a.views:
            self.spark.catalog.dropTempView(v)
        self._catalog_views()
        return True

    def is_attached(self, schema: str) -> bool:
        return schema in self.schemas

    def attached_schemas(self) -> list[str]:
        return sorted(self.schemas)

    def is_stale(self, schema: str) -> bool:
        """The source file has changed since it was parsed."""
        a = self.schemas[schema]
        return os.path.exists(a.path) and os.path.getmtime(a.path) > a.parsed_at

    def reload(self, schema: str) -> Attached:
        a = self.schemas[schema]
        prefix = any(v.startswith(f"{schema}_") for v in a.views)
        self.detach(schema)
        return self.attach(a.path, schema, a.args, prefix)

    def _free(self, schema: str) -> None:
        if schema in self.schemas:
            raise SessionError(f"schema '{schema}' is already attached")
        if schema and not _IDENTIFIER.match(schema):
            raise SessionError(f"'{schema}' is no schema name")

    def _register(self, schema, path, args, tables: dict[str, DataFrame], prefix: bool) -> Attached:
        a = Attached(schema, path, list(args), time.time())
        for name, df in tables.items():
            view = f"{schema}_{name}" if prefix and schema else name
            df.createOrReplaceTempView(view)
            a.views.append(view)
        self.schemas[schema] = a
        self._catalog_views()
        return a

    def _catalog_views(self) -> None:
        rows = [("table", v) for a in self.schemas.values() for v in a.views]
        self.spark.createDataFrame(rows, "type string, name string").createOrReplaceTempView("sqlite_master")
        dbs = [(i, s or "main", a.path) for i, (s, a) in enumerate(self.schemas.items())]
        self.spark.createDataFrame(dbs, "seq int, name string, file string").createOrReplaceTempView("pragma_database_list")

    # -- queries -------------------------------------------------------------

    def tables(self) -> list[str]:
        return sorted(v for a in self.schemas.values() for v in a.views)

    def describe(self, table: str) -> str:
        """The table as a CREATE TABLE statement."""
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "string": "TEXT", "double": "REAL"}
        cols = ",\n".join(f"  {n} {kinds.get(k, k.upper())}" for n, k in self.spark.table(table).dtypes)
        return f"CREATE TABLE {table} (\n{cols}\n);"

    def query(self, sql: str, dialect_name: str = "spark") -> DataFrame:
        """The statement's result; raises ``SessionError`` with the reason."""
        try:
            if "sqlite_master" in sql or "pragma" in sql.lower():
                self._catalog_views()  # another session may have set them
            if dialect_name == "compat":
                return self._compat(sql)
            return self.spark.sql(dialect.check_statement(sql))
        except (AnalysisException, dialect.Refused, ValueError) as e:
            self.last_error = str(e).split("\n")[0]
            raise SessionError(self.last_error) from e

    def exec(self, sql: str, dialect_name: str = "compat", most: int = MOST_ROWS) -> tuple[list[str], list[list], str]:
        """(columns, rows, error) for the printers and servers.

        A result of more than ``most`` rows is an error, never a cut list: the
        driver takes no unbounded result.  ``query`` gives the whole frame.
        """
        try:
            df = self.query(sql, dialect_name)
            rows = [list(r) for r in df.limit(most + 1).collect()]
            if len(rows) > most:
                self.last_error = f"more than {most} rows; add a LIMIT or write the result of query()"
                return [], [], self.last_error
            return df.columns, rows, ""
        except SessionError as e:
            return [], [], str(e)
        except Exception as e:  # a failure at run time
            self.last_error = str(e).split("\n")[0]
            return [], [], self.last_error

    def _compat(self, sql: str) -> DataFrame:
        loop = dialect.set_recursion(sql)
        if loop:
            return self._loop(loop)
        text = dialect.rewrite(sql, INTEGER_COLUMNS)
        for _ in range(12):
            try:
                return self.spark.sql(text)
            except AnalysisException as e:
                if e.getCondition() not in ("MISSING_AGGREGATION", "MISSING_GROUP_BY"):
                    raise
                text = _wrap_bare_column(text, e.getMessageParameters())
        return self.spark.sql(text)

    def _loop(self, r: dialect.Recursion) -> DataFrame:
        """Set-semantic recursion: rounds over the last new rows until none is new."""
        scratch = Scratch(self.spark, "recursion")
        base = self.spark.sql(dialect.rewrite(r.base, INTEGER_COLUMNS)).distinct()
        if r.columns:
            base = base.toDF(*r.columns)
        types = base.schema
        seen = scratch.put(base, "seen")
        new = seen
        step = dialect.rewrite(r.step, INTEGER_COLUMNS)
        while True:
            new.createOrReplaceTempView(r.name)
            found = self.spark.sql(step).toDF(*types.names)
            found = found.select(*[found[f.name].cast(f.dataType) for f in types.fields])
            new = scratch.put(found.subtract(seen), "new")
            if not new.limit(1).count():
                break
            seen = scratch.put(seen.unionByName(new), "seen")
        seen.createOrReplaceTempView(r.name)
        out = self.spark.sql(dialect.rewrite(r.rest, INTEGER_COLUMNS))
        return out


_AGGREGATES = {"count", "sum", "min", "max", "avg", "total", "group_concat", "any_value", "min_by", "max_by", "collect_list", "first"}


def _wrap_bare_column(sql: str, why: dict[str, str]) -> str:
    """Wrap the column that the analyser names: any row's value, except that a
    lone min() or max() of the same select list decides the row."""
    name = why.get("expression", "").strip('"').split(".")[-1].strip("`").lower()
    ts = dialect.tokens(sql)
    for start, end in _select_lists(ts):
        items = _items(ts, start, end)
        calls = [c for a, b in items for c in _calls(ts, a, b)]
        if not any(f in _AGGREGATES for f, _ in calls):
            continue
        lone = [(f, x) for f, x in calls if f in ("min", "max")]
        for a, b in items:
            at = _bare(ts, a, b, name)
            if at is None:
                continue
            first, last = at
            column = "".join(v for _, v in ts[first : last + 1])
            call = f"{lone[0][0]}_by({column}, {lone[0][1]})" if len(lone) == 1 else f"any_value({column})"
            alone = all(k == "space" for k, _ in [*ts[a:first], *ts[last + 1 : b]])
            label = f" AS `{ts[last][1].strip('`')}`" if alone else ""
            return "".join(v for _, v in [*ts[:first], ("expr", call + label), *ts[last + 1 :]])
    raise ValueError(f"column {name or 'list'} is neither grouped nor aggregated")


def _select_lists(ts):
    """(first, end) token positions of every select list, outer ones first."""
    out = []
    for i, (k, v) in enumerate(ts):
        if k == "word" and v.upper() == "SELECT":
            depth, j = 0, i + 1
            while j < len(ts) and not (depth == 0 and (ts[j][1] == ")" or ts[j][0] == "word" and ts[j][1].upper() == "FROM")):
                depth += (ts[j][1] == "(") - (ts[j][1] == ")")
                j += 1
            out.append((i + 1, j))
    return out


def _items(ts, start, end):
    out, depth, a = [], 0, start
    for i in range(start, end):
        depth += (ts[i][1] == "(") - (ts[i][1] == ")")
        if ts[i][1] == "," and depth == 0:
            out.append((a, i))
            a = i + 1
    return [*out, (a, end)]


def _calls(ts, a, b):
    """(function, argument text) of the calls that stand outermost in an item."""
    out, i = [], a
    while i < b:
        if ts[i][0] == "word" and i + 1 < b and ts[i + 1][1] == "(":
            end = dialect._close(ts, i + 1)
            out.append((ts[i][1].lower(), "".join(v for _, v in ts[i + 2 : end]).strip()))
            i = end
        i += 1
    return out


def _bare(ts, a, b, name):
    """Token range of a column outside of calls, of that name or, without a name, any."""
    depth = 0
    for i in range(a, b):
        k, v = ts[i]
        depth += (v == "(") - (v == ")")
        if depth or k not in ("word", "quoted") or v.upper() in ("AS", "DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "NULL", "IS"):
            continue
        before = next((ts[j] for j in range(i - 1, a - 1, -1) if ts[j][0] != "space"), ("", ""))
        after = next((ts[j][1] for j in range(i + 1, b) if ts[j][0] != "space"), "")
        if before[1].upper() == "AS" or after in (".", "(") or before[0] in ("word", "quoted", "number", "string", "expr") and before[1].upper() not in (
                "DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "AND", "OR", "NOT"):
            continue
        if not name or v.strip("`").lower() == name:
            first = i - 2 if before[1] == "." else i
            return first, i
    return None

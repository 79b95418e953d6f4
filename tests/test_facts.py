"""Extraction, merge, sessions and the dialect over a small C++ project."""

import os
import random

import pytest

from astrolith.plans.merge import merge
from astrolith.schemas import TABLES, staged
from astrolith.session import FactSession, SessionError
from astrolith.sources import compile_db, cpp, discovery, lite

SHOP = os.path.join(os.path.dirname(__file__), "fixtures", "shop")
BOOK = os.path.join(SHOP, "book.cpp")


@pytest.fixture(scope="module")
def rows():
    out = {}
    for table, row in lite.extract(BOOK):
        out.setdefault(table, []).append(row)
    return out


def test_rows_fit_the_schemas(rows):
    for table, found in rows.items():
        for r in found:
            assert set(r) == set(TABLES[table].column_names)


def test_functions_and_quirks(rows):
    f = [(r["name"], r["is_definition"], r["is_variadic"]) for r in rows["functions"]]
    assert f == [("add", 0, 0), ("trace", 0, 1), ("add", 1, 0), ("main", 1, 0)]  # twice<T> is not emitted
    assert rows["functions"][0]["id"] == rows["functions"][2]["id"]  # declaration and definition share an id
    add = rows["functions"][2]
    assert (add["line"], add["end_line"]) == (18, 22)


def test_classes_methods_fields(rows):
    assert [(c["name"], c["kind"], c["is_abstract"]) for c in rows["classes"]] == [("Price", "struct", 0), ("Item", "class", 1), ("Book", "class", 0)]
    m = {r["qualified_name"]: r for r in rows["methods"]}
    assert m["shop::Item::weight"]["is_pure_virtual"] == 1 and m["shop::Item::make"]["is_static"] == 1
    assert m["shop::Item::~Item"]["return_type"] == "" and m["shop::Book::Book"]["access"] == "public"
    assert "shop::Book::operator==" in m and len(rows["methods"]) == 7
    assert [(f["name"], f["access"], f["bit_width"]) for f in rows["fields"]] == [
        ("cents", "public", -1), ("rate", "public", -1), ("seen", "public", 3), ("price_", "protected", -1), ("on_sale_", "private", -1), ("pages_", "private", -1)]


def test_other_tables(rows):
    assert [(e["name"], e["is_scoped"]) for e in rows["enums"]] == [("Status", 1), ("Level", 0)]
    assert [(v["name"], v["value"]) for v in rows["enum_values"]] == [("Open", 0), ("Paid", 5), ("Closed", 6), ("LOW", 0), ("HIGH", 16)]
    v = {r["name"]: (r["scope_kind"], r["storage_class"]) for r in rows["variables"]}
    assert v["g_opened"] == ("global", "static") and v["calls"] == ("static_local", "static") and v["total"] == ("local", "none")
    assert [(i["derived_name"], i["base_name"], i["access"]) for i in rows["inheritance"]] == [("Book", "Item", "public")]
    assert rows["inheritance"][0]["base_usr"] == "class:shop::Item"
    assert [s["content"] for s in rows["string_literals"]] == ["item", "shop", 'total %d \\"quoted\\"\\n', "wide"]
    assert [s["is_wide"] for s in rows["string_literals"]] == [0, 0, 0, 1]
    p = [r for r in rows["parameters"] if r["name"] == "size"]
    assert p[0]["has_default"] == 1 and p[0]["index_"] == 1
    calls = {(c["caller_usr"].split(":")[1][:4], c["callee_name"], c["is_virtual"]) for c in rows["calls"]}
    assert ("main", "add", 0) in calls and ("main", "label", 1) in calls and ("main", "trace", 0) in calls
    assert sum(c["callee_name"] == "add" for c in rows["calls"]) == 1  # the comment is no call


@pytest.fixture(scope="module")
def project(spark):
    s = FactSession(spark)
    s.attach_project(discovery.ProjectConfig(SHOP, exclude=[]))
    yield s
    for schema in list(s.schemas):
        s.detach(schema)


def ask(s, sql):
    return [tuple(r) for r in s.query(sql, "compat").collect()]


def test_merged_project(project):
    # the declaration of the header is seen first and hides the definition
    assert ask(project, "SELECT name, is_definition FROM functions WHERE name = 'add'") == [("add", 0)]
    for table in ("fields", "calls", "string_literals", "parameters", "enum_values", "inheritance", "variables"):
        ids = [r[0] for r in ask(project, f"SELECT id FROM {table} ORDER BY id")]
        assert ids == list(range(1, len(ids) + 1)), table
    assert ask(project, "SELECT COUNT(*) FROM methods m LEFT JOIN classes c ON m.class_id = c.id WHERE c.id IS NULL") == [(0,)]
    assert ask(project, "SELECT COUNT(*), COUNT(DISTINCT usr) FROM classes")[0] == (4, 4)
    # header fields repeat once per including unit
    assert ask(project, "SELECT COUNT(*) FROM fields WHERE name = 'cents'") == [(2,)]


def test_prefer_definition(spark):
    s = FactSession(spark)
    s.attach_project(discovery.ProjectConfig(SHOP, exclude=[]), schema="pd", prefer_definition=True)
    assert ask(s, "SELECT is_definition FROM pd_functions WHERE name = 'add'") == [(1,)]
    s.detach("pd")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pd_")]


@pytest.mark.parametrize("sql,want", [
    ("SELECT name FROM classes WHERE name LIKE 'BO%';", [("Book",)]),
    ("SELECT name FROM methods WHERE is_static AND NOT is_const", [("make",)]),
    ("SELECT name, CASE WHEN is_pure_virtual THEN 'pure' WHEN is_virtual THEN 'virtual' END AS v FROM methods WHERE name = 'weight' AND is_pure_virtual", [("weight", "pure")]),
    ("SELECT c.name, COUNT(m.id) AS n FROM classes c LEFT JOIN methods m ON m.class_id = c.id GROUP BY c.id ORDER BY n DESC, c.id LIMIT 2", [("Item", 4), ("Book", 3)]),
    ('SELECT "name" FROM enums ORDER BY "name"', [("Level",), ("Status",)]),
    ("SELECT 7 / 2, 1 / 0, -7 / 2", [(3, None, -3)]),
    ("SELECT iif(1 = 1, 'a', 'b'), max(3, NULL), min(3, 2), trim('xxaxx', 'x'), ifnull(NULL, 4)", [("a", None, 2, "a", 4)]),
    ("SELECT group_concat(name) FROM enums", [("Level,Status",)]),
    ("SELECT total(value) FROM enum_values WHERE value > 99", [(0.0,)]),
    ("SELECT name FROM enums WHERE name GLOB 'S*'", [("Status",)]),
    ("SELECT name FROM enum_values WHERE value BETWEEN 1 AND 5 AND id", [("Paid",), ("Paid",)]),
    ("WITH RECURSIVE n(x) AS (SELECT 1 UNION SELECT x % 3 + 1 FROM n) SELECT x FROM n ORDER BY x", [(1,), (2,), (3,)]),
    ("SELECT name, MIN(line) FROM enums", [("Status", 25)]),
    ("SELECT name FROM sqlite_master WHERE name = 'calls'", [("calls",)]),
    ("SELECT 'it''s; LIKE' AS s", [("it's; LIKE",)]),
    ("SELECT substr('hello', 0, 2), ltrim('xa', 'x'), char(72, 105), typeof(1), typeof('a'), typeof(NULL), quote('o''k')", [("h", "a", "Hi", "integer", "text", "null", "'o''k'")]),
    ("SELECT date('2024-02-28', '+2 days'), strftime('%Y/%m', '2024-02-03 04:05:06'), datetime(0, 'unixepoch'), unixepoch('1970-01-02')",
     [("2024-03-01", "2024/02", "1970-01-01 00:00:00", 86400)]),
    ("SELECT date('2024-02-28', 'start of month'), julianday('2000-01-01 12:00:00'), json_extract('{\"a\": {\"b\": 3}}', '$.a.b')", [("2024-02-01", 2451545.0, "3")]),
])
def test_dialect(project, sql, want):
    assert ask(project, sql) == want


@pytest.mark.parametrize("sql", ["DELETE FROM functions", "SELECT 1; SELECT 2", "", "DROP VIEW calls", "CREATE TABLE x AS SELECT 1", "SELECT nope FROM functions"])
def test_refused(project, sql):
    with pytest.raises(SessionError):
        project.query(sql, "compat")
    assert project.last_error


def test_attach_prefix_duplicate_and_reload(spark, tmp_path):
    src = tmp_path / "my-file.v2.cpp"
    src.write_text("int one() { return 1; }\n")
    s = FactSession(spark)
    a = s.attach(str(src))
    assert a.schema == "my_file_v2" and s.is_attached("my_file_v2")
    with pytest.raises(SessionError):
        s.attach(str(src))
    with pytest.raises(SessionError):
        s.attach(str(src), "1bad name")
    assert ask(s, "SELECT name FROM my_file_v2_functions") == [("one",)]
    src.write_text("int one() { return 1; }\nint two() { return one(); }\n")
    os.utime(src, (a.parsed_at + 50, a.parsed_at + 50))
    assert s.is_stale("my_file_v2")
    s.reload("my_file_v2")
    assert len(ask(s, "SELECT name FROM my_file_v2_functions")) == 2
    assert s.describe("my_file_v2_enums").startswith("CREATE TABLE my_file_v2_enums (\n  id INTEGER")


def test_cache(spark, tmp_path):
    src, inc = tmp_path / "a.cpp", tmp_path / "a.h"
    inc.write_text("int h();\n")
    src.write_text('#include "a.h"\nint f() { return h(); }\n')
    s = FactSession(spark)
    s.enable_cache(str(tmp_path / "cache"))
    for n in range(2):
        s.attach(str(src), f"c{n}")
    assert (s.cache.hits, s.cache.misses) == (1, 1)
    assert ask(s, "SELECT callee_name FROM c1_calls") == [("h",)]
    os.utime(inc, (1, 1))  # an include has changed
    s.attach(str(src), "c2")
    assert s.cache.misses == 2
    assert not s.cache.is_valid(str(src), ["-DX"])
    assert s.clear_cache() == 1


def test_merge_does_not_depend_on_partitioning(spark):
    rng = random.Random(1)
    cols = staged(TABLES["functions"])
    f = [(rng.randrange(1, 6), rng.choice(["u1", "u2", "u3", ""]), "n", "q", "r", 1, 1, 1, 1, 1, rng.randrange(2), 0, 0, 0, 0, tu, seq)
         for tu in range(4) for seq in range(6)]
    files = [(1, f"/f{tu % 2}", 1, 0, 0, 0, tu, 0) for tu in range(4)]
    results = []
    for n in (1, 5):
        tables = {k: spark.createDataFrame([], staged(t)) for k, t in TABLES.items()}
        tables["functions"] = spark.createDataFrame(rng.sample(f, len(f)), cols).repartition(n)
        tables["files"] = spark.createDataFrame(files, staged(TABLES["files"])).repartition(n)
        m = merge(tables)
        results.append(sorted(map(tuple, m["functions"].collect())))
        assert sorted(r.id for r in m["files"].collect()) == [1, 2]
        assert m["calls"].count() == 0
    assert results[0] == results[1]
    assert sorted(r[0] for r in results[0]) == list(range(1, len(results[0]) + 1))
    assert all(r[5] in (1, 2) for r in results[0])


def test_missing_file_is_reported_not_fatal(spark):
    got = {r.path: r.status for r in cpp.parse_status(spark, [BOOK, "/nowhere.cpp"]).collect()}
    assert got == {BOOK: "ok", "/nowhere.cpp": "failed"}


# -- sources ------------------------------------------------------------------

def test_file_specs():
    assert discovery.parse_file_spec("a/b.cpp:lib") == ("a/b.cpp", "lib")
    assert discovery.parse_file_spec("C:\\x\\b.cpp") == ("C:\\x\\b.cpp", None)
    assert discovery.is_source_file("b.hpp:x") and not discovery.is_source_file("b.txt")
    assert discovery.schema_from_path("/x/my-lib.core.cpp") == "my_lib_core"


def test_globs_and_scans(tmp_path):
    for p in ("a.cpp", "x/b.CPP", "x/y/c.cpp", "build/d.cpp", "x/e.h"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    rel = lambda ps: [os.path.relpath(p, tmp_path) for p in ps]
    assert rel(discovery.expand_glob(f"{tmp_path}/**/*.cpp")) == ["a.cpp", "build/d.cpp", "x/b.CPP", "x/y/c.cpp"]
    assert rel(discovery.expand_glob(f"{tmp_path}/*.cpp")) == ["a.cpp"]
    assert rel(discovery.project_files(discovery.ProjectConfig(str(tmp_path)))) == ["a.cpp", "x/b.CPP", "x/y/c.cpp"]
    assert discovery.excluded("/home/build/x.cpp", ["build"]) and not discovery.excluded("/Build/x", ["build"])
    assert discovery.matches_filters("/a/TEST/x.cpp", [], ["test"]) is False
    assert discovery.matches_filters("/a/x.cpp", ["X.*"], []) is True


def test_compile_commands(spark, tmp_path):
    db = tmp_path / "compile_commands.json"
    db.write_text('[{"directory": "%s", "file": "a.cpp", "command": "cc -I inc -DX=1 \\"-Dq r\\" -O2 -std=c++17 -isystem /s -o a.o a.cpp"},'
                  '{"directory": "/d", "file": "/d/b.cpp", "arguments": ["cl", "/Iinc", "/DY", "/std:c++20", "/Fob.obj"]}]' % tmp_path)
    commands = compile_db.load(str(tmp_path))
    assert compile_db.extract_flags(compile_db.find(commands, str(tmp_path / "a.cpp"))) == ["-Iinc", "-DX=1", "-Dq r", "-std=c++17", "-isystem", "/s"]
    assert compile_db.extract_flags(commands[1]) == ["-Iinc", "-DY", "-std=c++20"]
    assert compile_db.find(commands, "/none.cpp") is None
    assert [r.path for r in compile_db.as_frame(spark, str(db)).collect()] == [f"{tmp_path}/a.cpp", "/d/b.cpp"]
    db.write_text("{}")
    assert compile_db.load(str(db)) is None and compile_db.load("/none") is None

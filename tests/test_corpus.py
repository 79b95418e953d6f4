"""Published questions over two small units, and rewriting of the dialect."""

import pytest

from astrolith.operators.hierarchy import Forest, range_depths
from astrolith.plans import dialect, units
from astrolith.session import INTEGER_COLUMNS, SessionError, _wrap_bare_column
from astrolith.sources.compile_db import split_command


@pytest.fixture(scope="module")
def asked(spark):
    return units.session(spark)


@pytest.mark.parametrize("name", sorted(units.STATEMENTS))
def test_units(asked, name):
    statement, columns, rows = units.STATEMENTS[name]
    got = asked.query(statement, "compat")
    assert got.columns == columns.split(", ")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


@pytest.mark.parametrize("ask,want", [
    ("SELECT (end_line - line) / 2 FROM f", "div"), ("SELECT COUNT(*) / 2 FROM f", "div"), ("SELECT line / 2 / 2 FROM f", "div 2 END div 2"),
    ("SELECT line * 3 / 2 FROM f", "(line * 3) div (2)"), ("SELECT line / 2.0 FROM f", "line / 2.0"), ("SELECT x / 2 FROM f", "x / 2"),
    ("SELECT n / 2 FROM (SELECT COUNT(*) AS n FROM f)", "n div 2"), ("SELECT SUM(x) / 2 FROM f", "SUM(x) / 2"),
    ("SELECT 1 FROM f WHERE kind IS NOT 'class'", "IS DISTINCT FROM 'class'"), ("SELECT 1 FROM f WHERE a IS NOT NULL", "IS NOT NULL"),
    ("SELECT 1 FROM f WHERE a = 'x' COLLATE NOCASE", "UTF8_LCASE"), ("SELECT p ->> '$.k' FROM f", "get_json_object(p, '$.k')"),
])
def test_rewriting(ask, want):
    assert want in dialect.rewrite(ask, INTEGER_COLUMNS)


def test_bare_columns_by_tokens():
    why = {"expression": '"name"'}
    assert _wrap_bare_column("SELECT 'taken from b' AS k, c.name, COUNT(*) FROM c GROUP BY c.id", why).startswith("SELECT 'taken from b' AS k, any_value(c.name) AS `name`")
    # a minimum outside of the list does not choose the row
    assert "any_value(name)" in _wrap_bare_column("SELECT name, COUNT(*) FROM c GROUP BY id HAVING MIN(line) > 2", why)
    assert "max_by(name, line)" in _wrap_bare_column("SELECT name, MAX(line) FROM c GROUP BY id", why)
    with pytest.raises(ValueError):
        _wrap_bare_column("SELECT COUNT(*) FROM c", why)


def test_exec_refuses_more_rows_than_it_may_bring(asked):
    assert asked.exec("SELECT name FROM util_functions ORDER BY name", most=2)[1] == [["clamp"], ["note"]]
    columns, rows, error = asked.exec("SELECT name FROM app_classes", most=2)
    assert (columns, rows) == ([], []) and "more than 2 rows" in error
    with pytest.raises(SessionError):
        asked.query("SELECT nothing FROM app_classes", "compat")


def test_split_command():
    assert split_command("cc  -I 'a b' -D\"q r\"=1\t-c x.c ''") == ["cc", "-I", "a b", "-Dq r=1", "-c", "x.c"]
    assert split_command("cc 'open end") == ["cc", "open end"] and split_command("") == []


def test_depths_from_ranges_alone(spark):
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 60)]
    tree = [(f"t{i}", f"t{i // 3}") for i in range(1, 90)]
    forest = Forest(spark.createDataFrame(chain + tree, "child string, parent string"))
    got = {r.node_key: r.depth for r in range_depths(forest.nested()).collect()}
    want = {"c0": 0, "t0": 0, **{f"c{i}": i for i in range(1, 60)}}
    for i in range(1, 90):
        want[f"t{i}"] = want[f"t{i // 3}"] + 1
    assert got == want

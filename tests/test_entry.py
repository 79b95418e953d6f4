"""The driver contract."""

import importlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_every_sql_has_its_query(entry):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    assert {"p1_found", "p3_found", "p6_found"} <= set(q)


def test_nothing_outside_imports_the_llm_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "astrolith"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "astrolith.llm" not in p.read_text(), p


def test_entry_runs(entry, spark):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    assert entry.entry(spark).columns == ["caller", "callee", "n_calls"]
    assert entry.entry(spark).count() > 0

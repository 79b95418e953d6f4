"""Published questions about code, asked in the source dialect.

Each runs through a session's compatibility dialect over the ``src_`` tables,
so that it checks the views, the rewriting and the plan at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from astrolith.runtime import read

_TABLES = ("files", "functions", "classes", "methods", "inheritance", "calls", "string_literals", "namespaces")

#: Statements as published, where the questions are; name -> (statement in the
#: source dialect, the same for the SQL check or None)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "q_user_functions": ("SELECT name, return_type FROM src_functions WHERE is_system = 0;", None),
    "q_definitions": ("SELECT name FROM src_functions WHERE is_definition = 1 AND is_system = 0", None),
    "q_project_files": ("SELECT path FROM src_files WHERE is_system = 0", None),
    "q_functions_with_path": ("SELECT f.name, fi.path FROM src_functions f JOIN src_files fi ON f.file_id = fi.id WHERE f.is_system = 0", None),
    "q_who_calls_what": ("SELECT f.name as caller, c.callee_name FROM src_calls c JOIN src_functions f ON c.caller_usr = f.usr WHERE c.is_system = 0 AND f.usr <> ''", None),
    "q_virtual_kind": (
        "SELECT qualified_name, access, CASE WHEN is_pure_virtual THEN 'pure' WHEN is_virtual THEN 'virtual' END as virt FROM src_methods WHERE is_virtual = 1 AND is_system = 0",
        "SELECT qualified_name, access, CASE WHEN is_pure_virtual <> 0 THEN 'pure' WHEN is_virtual <> 0 THEN 'virtual' END AS virt FROM src_methods WHERE is_virtual = 1 AND is_system = 0"),
    "q_longest_functions": (
        "SELECT name, seq, end_line - line + 1 as lines FROM src_functions WHERE is_definition = 1 AND is_system = 0 ORDER BY lines DESC, seq LIMIT 10",
        "SELECT name, seq, end_line - line + 1 AS lines FROM src_functions WHERE is_definition = 1 AND is_system = 0 ORDER BY lines DESC NULLS LAST, seq LIMIT 10"),
    "q_calls_per_file": (
        "SELECT fi.path, c.callee_name, COUNT(*) as call_count FROM src_calls c JOIN src_files fi ON c.file_id = fi.id WHERE c.is_system = 0 GROUP BY fi.path, c.callee_name", None),
    "q_common_literals": (
        "SELECT content, COUNT(*) as n FROM src_string_literals WHERE is_system = 0 GROUP BY content ORDER BY n DESC, content LIMIT 20",
        "SELECT content, COUNT(*) AS n FROM src_string_literals WHERE is_system = 0 GROUP BY content ORDER BY n DESC, content NULLS FIRST LIMIT 20"),
    "q_functions_per_file": (
        "SELECT fi.id, MIN(fi.path) AS path, COUNT(fu.id) as func_count FROM src_files fi LEFT JOIN src_functions fu ON fu.file_id = fi.id WHERE fi.is_system = 0 GROUP BY fi.id", None),
    "q_literals_of_function": ("SELECT content FROM src_string_literals WHERE func_id = 42", None),
    "q_literals_of_method": ("SELECT content FROM src_string_literals WHERE method_id = 7", None),
    "q_function_most_literals": (
        "SELECT s.func_id, f.name, COUNT(*) as n FROM src_string_literals s JOIN (SELECT id, MIN(name) AS name FROM src_functions GROUP BY id) f ON s.func_id = f.id "
        "WHERE s.is_system = 0 GROUP BY s.func_id ORDER BY n DESC, s.func_id LIMIT 10",
        "SELECT s.func_id, ANY_VALUE(f.name) AS name, COUNT(*) AS n FROM src_string_literals s JOIN (SELECT id, MIN(name) AS name FROM src_functions GROUP BY id) f ON s.func_id = f.id "
        "WHERE s.is_system = 0 GROUP BY s.func_id ORDER BY n DESC, s.func_id LIMIT 10"),
    "q_method_most_literals": (
        "SELECT s.method_id, m.qualified_name, COUNT(*) as n FROM src_string_literals s JOIN (SELECT id, MIN(qualified_name) AS qualified_name FROM src_methods GROUP BY id) m "
        "ON s.method_id = m.id WHERE s.is_system = 0 GROUP BY s.method_id ORDER BY n DESC, s.method_id LIMIT 10",
        "SELECT s.method_id, ANY_VALUE(m.qualified_name) AS qualified_name, COUNT(*) AS n FROM src_string_literals s JOIN (SELECT id, MIN(qualified_name) AS qualified_name FROM src_methods GROUP BY id) m "
        "ON s.method_id = m.id WHERE s.is_system = 0 GROUP BY s.method_id ORDER BY n DESC, s.method_id LIMIT 10"),
    "q_password_callables": (
        "SELECT 'function' AS kind, f.name FROM src_string_literals s JOIN src_functions f ON s.func_id = f.id WHERE s.content LIKE '%PASSWORD%' AND s.is_system = 0 "
        "UNION ALL SELECT 'method' AS kind, m.qualified_name FROM src_string_literals s JOIN src_methods m ON s.method_id = m.id WHERE s.content LIKE '%password%' AND s.is_system = 0",
        "SELECT 'function' AS kind, f.name FROM src_string_literals s JOIN src_functions f ON s.func_id = f.id WHERE s.content ILIKE '%PASSWORD%' AND s.is_system = 0 "
        "UNION ALL SELECT 'method' AS kind, m.qualified_name FROM src_string_literals s JOIN src_methods m ON s.method_id = m.id WHERE s.content ILIKE '%password%' AND s.is_system = 0"),
    "q_global_literals": ("SELECT content FROM src_string_literals WHERE func_id = 0 AND method_id = 0 AND is_system = 0", None),
    "q_methods_per_class": (
        "SELECT c.id, MIN(c.name) AS name, COUNT(DISTINCT m.seq) as methods FROM src_classes c LEFT JOIN src_methods m ON m.class_id = c.id WHERE c.is_system = 0 GROUP BY c.id", None),
    "q_virtual_methods": ("SELECT c.name AS class_name, m.name FROM src_methods m JOIN src_classes c ON m.class_id = c.id WHERE m.is_virtual = 1 AND m.is_system = 0", None),
    "q_most_called": ("SELECT callee_name, COUNT(*) as calls FROM src_calls WHERE is_system = 0 GROUP BY callee_name ORDER BY calls DESC, callee_name LIMIT 10", None),
    "q_callers_of": ("SELECT DISTINCT f.name FROM src_functions f JOIN src_calls c ON c.caller_usr = f.usr WHERE c.callee_name = 'push_entry' AND f.usr <> ''", None),
    "q_leaf_functions": (
        "SELECT f.name, f.seq FROM src_functions f LEFT JOIN src_calls c ON c.caller_usr = f.usr WHERE c.id IS NULL AND f.is_system = 0 AND f.is_definition = 1", None),
    "q_root_classes": ("SELECT c.name, c.seq FROM src_classes c LEFT JOIN src_inheritance i ON i.derived_usr = c.usr WHERE i.id IS NULL AND c.is_system = 0", None),
    "q_inheritance": ("SELECT derived_name, base_name, access FROM src_inheritance WHERE is_system = 0", None),
    "q_inheritance_infix": (
        "SELECT derived_name, base_name FROM src_inheritance WHERE base_name LIKE '%DRIFT%'", "SELECT derived_name, base_name FROM src_inheritance WHERE base_name ILIKE '%DRIFT%'"),
    "q_abstract_classes": ("SELECT name FROM src_classes WHERE is_abstract = 1 AND is_system = 0", None),
    "q_public_api": ("SELECT c.name AS class_name, m.name, m.return_type FROM src_methods m JOIN src_classes c ON m.class_id = c.id WHERE m.access = 'public' AND c.is_system = 0", None),
    "q_private_methods": ("SELECT c.name AS class_name, m.name FROM src_methods m JOIN src_classes c ON m.class_id = c.id WHERE m.access = 'private' AND c.is_system = 0", None),
    "q_const_methods": ("SELECT c.name AS class_name, m.name FROM src_methods m JOIN src_classes c ON m.class_id = c.id WHERE m.is_const = 1 AND c.is_system = 0", None),
    "q_return_types": ("SELECT return_type, COUNT(*) as n FROM src_functions WHERE is_system = 0 GROUP BY return_type ORDER BY n DESC, return_type LIMIT 10",
                       "SELECT return_type, COUNT(*) AS n FROM src_functions WHERE is_system = 0 GROUP BY return_type ORDER BY n DESC, return_type NULLS FIRST LIMIT 10"),
    "q_could_be_const": (
        "SELECT c.name AS class_name, m.name FROM src_methods m JOIN src_classes c ON m.class_id = c.id WHERE m.is_const = 0 AND m.is_static = 0 "
        "AND m.name NOT LIKE 'set%' AND m.name NOT LIKE 'operator%' AND c.is_system = 0",
        "SELECT c.name AS class_name, m.name FROM src_methods m JOIN src_classes c ON m.class_id = c.id WHERE m.is_const = 0 AND m.is_static = 0 "
        "AND m.name NOT ILIKE 'set%' AND m.name NOT ILIKE 'operator%' AND c.is_system = 0"),
    "q_same_name_twice": (
        "SELECT f1.seq AS a, f2.seq AS b FROM src_functions f1 JOIN src_functions f2 ON f1.name = f2.name WHERE f1.is_definition = 1 AND f2.is_definition = 1 "
        "AND f1.file_id < f2.file_id AND f1.usr = f2.usr AND f1.name <> ''", None),
    "q_cross_file_calls": (
        "SELECT f1.name as caller, c.callee_name, c.seq FROM src_calls c JOIN src_functions f1 ON c.caller_usr = f1.usr JOIN src_functions f2 ON c.callee_usr = f2.usr "
        "WHERE f1.file_id != f2.file_id AND f1.usr <> '' AND f2.usr <> ''", None),
    "q_total_callables": ("SELECT COUNT(*) as total FROM (SELECT name FROM src_functions WHERE is_system = 0 UNION ALL SELECT name FROM src_methods WHERE is_system = 0)", None),
    "q_prefix_search": ("SELECT name, seq FROM src_functions WHERE name LIKE 'PUSH%' ORDER BY seq LIMIT 10", "SELECT name, seq FROM src_functions WHERE name ILIKE 'PUSH%' ORDER BY seq LIMIT 10"),
    "q_extents": (
        "SELECT c.name AS class_name, m.name, m.line, m.end_line FROM src_classes c JOIN src_methods m ON m.class_id = c.id WHERE m.is_virtual AND c.kind = 'class'",
        "SELECT c.name AS class_name, m.name, m.line, m.end_line FROM src_classes c JOIN src_methods m ON m.class_id = c.id WHERE m.is_virtual <> 0 AND c.kind = 'class'"),
    "q_half_lines": ("SELECT seq, end_line / 2 AS half FROM src_functions WHERE is_inline OR is_static",
                     "SELECT seq, end_line // 2 AS half FROM src_functions WHERE is_inline <> 0 OR is_static <> 0"),
    "q_half_span": ("SELECT seq, (end_line - line) / 2 AS half FROM src_functions", "SELECT seq, (end_line - line) // 2 AS half FROM src_functions"),
    "q_quarter_lines": ("SELECT seq, end_line / 2 / 2 AS quarter, line * 3 / 2 AS more FROM src_functions",
                        "SELECT seq, end_line // 2 // 2 AS quarter, line * 3 // 2 AS more FROM src_functions"),
    "q_half_count": ("SELECT kind, COUNT(*) / 2 AS half FROM src_classes GROUP BY kind", "SELECT kind, COUNT(*) // 2 AS half FROM src_classes GROUP BY kind"),
    "q_not_a_class": ("SELECT seq FROM src_classes WHERE kind IS NOT 'class'", "SELECT seq FROM src_classes WHERE kind IS DISTINCT FROM 'class'"),
    "q_nocase": ("SELECT seq FROM src_functions WHERE name = 'PUSH_ENTRY' COLLATE NOCASE", "SELECT seq FROM src_functions WHERE lower(name) = 'push_entry'"),
    "q_prefix_cast": (
        "SELECT seq, CAST(name AS INTEGER) AS n, CAST(usr AS INTEGER) AS m FROM src_functions",
        "SELECT seq, CASE WHEN name IS NOT NULL THEN COALESCE(TRY_CAST(regexp_extract(name, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) END AS n, "
        "CASE WHEN usr IS NOT NULL THEN COALESCE(TRY_CAST(regexp_extract(usr, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) END AS m FROM src_functions"),
    "q_glob_function": ("SELECT seq FROM src_functions WHERE glob('p*', name)", "SELECT seq FROM src_functions WHERE name LIKE 'p%'"),
    "q_text_before": ("SELECT seq, substr(name, 5, -2) AS part FROM src_functions", "SELECT seq, substr(name, 3, 2) AS part FROM src_functions"),
    "q_json_text": ("""SELECT seq, ('{"k": ' || line || '}') ->> '$.k' AS k FROM src_functions""", "SELECT seq, CAST(line AS VARCHAR) AS k FROM src_functions"),
    "q_literal_with_from": (
        "SELECT 'taken from b' AS k, c.kind, COUNT(*) AS n FROM src_classes c GROUP BY c.kind || ''",
        "SELECT 'taken from b' AS k, ANY_VALUE(c.kind) AS kind, COUNT(*) AS n FROM src_classes c GROUP BY c.kind || ''"),
    "q_call_reach_three": (
        "WITH RECURSIVE r AS (SELECT callee_usr AS usr, 1 AS depth FROM src_calls WHERE callee_usr <> '' AND caller_usr = (SELECT MIN(caller_usr) FROM src_calls WHERE caller_usr <> '') "
        "UNION SELECT c.callee_usr, r.depth + 1 FROM r JOIN src_calls c ON c.caller_usr = r.usr WHERE r.depth < 3 AND c.callee_usr <> '') SELECT usr, MIN(depth) AS min_depth FROM r GROUP BY usr", None),
    "q_namespace_depth": (
        "WITH RECURSIVE t AS (SELECT id, 0 AS depth FROM src_namespaces WHERE parent_id = 0 UNION SELECT n.id, t.depth + 1 FROM src_namespaces n JOIN t ON n.parent_id = t.id) SELECT id, depth FROM t",
        "WITH RECURSIVE t AS (SELECT id, 0 AS depth FROM src_namespaces WHERE parent_id = 0 UNION SELECT n.id, t.depth + 1 FROM src_namespaces n JOIN t ON n.parent_id = t.id) SELECT id, depth FROM t"),
    "q_tables": ("SELECT name FROM sqlite_master WHERE type = 'table' AND name LIKE 'src_%s'",
                 "SELECT 'src_' || unnest(['files', 'functions', 'classes', 'methods', 'calls', 'string_literals', 'namespaces']) AS name"),
}


def session(spark: SparkSession, d: str):
    from astrolith.session import FactSession

    s = FactSession(spark)
    s.attach_facts({t: read(spark, d, f"src_{t}") for t in _TABLES}, "src", d)
    return s


def _ask(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return session(spark, d).query(STATEMENTS[name][0], "compat")

    run.__name__ = name
    return run


def caller_callee_top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent pairs of caller and callee names."""
    return session(spark, d).query("""
        SELECT f.name AS caller, c.callee_name AS callee, COUNT(*) AS n_calls
        FROM src_calls c JOIN (SELECT usr, MIN(name) AS name FROM src_functions WHERE usr <> '' GROUP BY usr) f ON c.caller_usr = f.usr
        WHERE c.is_system = 0 GROUP BY f.name, c.callee_name ORDER BY n_calls DESC, caller, callee LIMIT 20""")


QUERIES = {"caller_callee_top": caller_callee_top, **{n: _ask(n) for n in STATEMENTS}}
SQL = {n: (check or ask.rstrip(";")) for n, (ask, check) in STATEMENTS.items()}
SQL["caller_callee_top"] = """
SELECT f.name AS caller, c.callee_name AS callee, COUNT(*) AS n_calls
FROM src_calls c JOIN (SELECT usr, MIN(name) AS name FROM src_functions WHERE usr <> '' GROUP BY usr) f ON c.caller_usr = f.usr
WHERE c.is_system = 0 GROUP BY f.name, c.callee_name ORDER BY n_calls DESC, caller NULLS FIRST, callee NULLS FIRST LIMIT 20
"""

"""Published questions over fields, parameters, variables, enums and two attached schemas.

The given tables hold none of these, so two small units of our own are read by
the extractor and attached as ``app`` and ``util``; the SQL of each query lists
the rows that follow from the sources below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from astrolith.schemas import TABLES
from astrolith.sources import lite

UTIL = """namespace util {
class Shape {
public:
    virtual double area() const = 0;
    virtual void move(int dx, int dy);
protected:
    int x_;
    int y_;
};
enum class Color { Red, Green = 4, Blue };
enum Mode { OFF, ON };
static int g_uses = 0;
int g_limit = 9;
int clamp(int value, int low, int high) {
    g_uses++;
    return value < low ? low : value;
}
void note(const char* text, int) {
}
}
"""

APP = """namespace util {
class Shape {
public:
    virtual double area() const = 0;
};
int clamp(int value, int low, int high);
}
class Circle : public util::Shape {
public:
    double area() const override { return 3.14 * r_; }
    void scale(double, int times) {}
private:
    double r_;
};
class Ring : public Circle {
    int hole_;
};
int run(int count) {
    return util::clamp(count, 0, 9);
}
int main(int argc, char** argv) {
    run(argc);
    return util::clamp(argc, 1, 2);
}
"""

#: name -> (statement in the source dialect, column names, rows)
STATEMENTS: dict[str, tuple[str, str, list[tuple]]] = {
    "u_field_layout": (
        "SELECT name, type, offset_bits FROM util_fields WHERE is_system = 0 ORDER BY offset_bits, id",
        "name, type, offset_bits", [("x_", "int", -1), ("y_", "int", -1)]),
    "u_fields_of_classes": (
        "SELECT c.name AS class_name, f.name AS field_name, f.type FROM app_fields f JOIN app_classes c ON f.class_id = c.id WHERE c.is_system = 0 ORDER BY c.name, f.id",
        "class_name, field_name, type", [("Circle", "r_", "double"), ("Ring", "hole_", "int")]),
    "u_parameters_of_functions": (
        "SELECT f.name, COUNT(p.id) AS param_count FROM util_functions f LEFT JOIN util_parameters p ON p.function_id = f.id WHERE f.is_system = 0 "
        "GROUP BY f.id ORDER BY param_count DESC LIMIT 20",
        "name, param_count", [("clamp", 3), ("note", 2)]),
    "u_parameters_of_methods": (
        "SELECT m.qualified_name, COUNT(p.id) AS param_count FROM util_methods m LEFT JOIN util_parameters p ON p.method_id = m.id WHERE m.is_system = 0 "
        "GROUP BY m.id ORDER BY param_count DESC LIMIT 20",
        "qualified_name, param_count", [("util::Shape::move", 2), ("util::Shape::area", 0)]),
    "u_fields_per_class": (
        "SELECT c.name, COUNT(f.id) AS field_count FROM app_classes c LEFT JOIN app_fields f ON f.class_id = c.id WHERE c.is_system = 0 GROUP BY c.id ORDER BY field_count DESC",
        "name, field_count", [("Circle", 1), ("Ring", 1), ("Shape", 0)]),
    "u_functions_per_file": (
        "SELECT fi.path, COUNT(fu.id) AS func_count FROM util_files fi LEFT JOIN util_functions fu ON fu.file_id = fi.id WHERE fi.is_system = 0 GROUP BY fi.id ORDER BY func_count DESC",
        "path, func_count", [("util.cpp", 2)]),
    "u_unnamed_of_functions": (
        "SELECT f.name AS function, p.type AS param_type FROM util_parameters p JOIN util_functions f ON p.function_id = f.id WHERE (p.name = '' OR p.name IS NULL) AND f.is_system = 0",
        "function, param_type", [("note", "int")]),
    "u_unnamed_of_methods": (
        "SELECT m.qualified_name AS method, p.type AS param_type FROM app_parameters p JOIN app_methods m ON p.method_id = m.id WHERE (p.name = '' OR p.name IS NULL) AND m.is_system = 0",
        "method, param_type", [("Circle::scale", "double")]),
    "u_static_variables": (
        "SELECT name, type, scope_kind FROM util_variables WHERE storage_class = 'static' AND is_system = 0", "name, type, scope_kind", [("g_uses", "int", "global")]),
    "u_large_enums": (
        "SELECT e.name, COUNT(ev.id) AS value_count FROM util_enums e JOIN util_enum_values ev ON ev.enum_id = e.id WHERE e.is_system = 0 GROUP BY e.id ORDER BY value_count DESC",
        "name, value_count", [("Color", 3), ("Mode", 2)]),
    "u_classes_of_two": (
        "SELECT name, 'app' AS unit FROM app_classes UNION ALL SELECT name, 'util' FROM util_classes",
        "name, unit", [("Shape", "app"), ("Circle", "app"), ("Ring", "app"), ("Shape", "util")]),
    "u_called_across": (
        "SELECT DISTINCT u.name FROM app_calls c JOIN util_functions u ON c.callee_usr = u.usr", "name", [("clamp",)]),
    "u_functions_over_two": (
        "SELECT unit, COUNT(*) AS n FROM (SELECT name, 'app' AS unit FROM app_functions WHERE is_definition UNION ALL SELECT name, 'util' FROM util_functions WHERE is_definition) GROUP BY unit",
        "unit, n", [("app", 2), ("util", 2)]),
    "u_inheritance_across": (
        "SELECT i.derived_name, b.qualified_name FROM app_inheritance i JOIN util_classes b ON i.base_usr = b.usr", "derived_name, qualified_name", [("Circle", "util::Shape")]),
    "u_subclass_tree": (
        "WITH RECURSIVE tree AS (SELECT usr, name, 0 AS depth FROM app_classes WHERE name = 'Shape' UNION ALL SELECT c.usr, c.name, t.depth + 1 FROM tree t "
        "JOIN app_inheritance i ON i.base_usr = t.usr JOIN app_classes c ON c.usr = i.derived_usr) SELECT name, depth FROM tree ORDER BY depth",
        "name, depth", [("Shape", 0), ("Circle", 1), ("Ring", 2)]),
    "u_attached": ("SELECT name FROM pragma_database_list ORDER BY name", "name", [("app",), ("util",)]),
    "u_sample_rows": ("SELECT name, line FROM util_functions ORDER BY name LIMIT 5", "name, line", [("clamp", 14), ("note", 18)]),
}


def session(spark: SparkSession):
    from astrolith.session import FactSession

    s = FactSession(spark)
    for schema, text in (("app", APP), ("util", UTIL)):
        rows: dict[str, list[tuple]] = {n: [] for n in TABLES}
        for table, row in lite.extract(f"{schema}.cpp", text=text):
            if table in rows:
                rows[table].append(tuple(row[c] for c in TABLES[table].column_names))
        s.attach_facts({n: spark.createDataFrame(r, TABLES[n].schema) for n, r in rows.items()}, schema, f"{schema}.cpp")
    return s


def _ask(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return session(spark).query(STATEMENTS[name][0], "compat")

    run.__name__ = name
    return run


def _listed(columns: str, rows: list[tuple]) -> str:
    value = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS t({columns})"


QUERIES = {n: _ask(n) for n in STATEMENTS}
SQL = {n: _listed(columns, rows) for n, (_, columns, rows) in STATEMENTS.items()}

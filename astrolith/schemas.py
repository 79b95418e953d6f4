"""The twelve fact tables: columns, keys, references and merge policy.

All columns are NOT NULL by convention: 0 is no reference, '' no text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"L": LongType(), "I": IntegerType(), "S": StringType()}


@dataclass(frozen=True)
class Table:
    """One fact table.

    ``key``: natural key of the merge (empty: all rows are kept).
    ``keep_empty``: rows with an empty key are all kept.
    ``refs``: foreign key column -> table it points to.
    ``dense``: ids are renumbered 1..n in emission order.
    """

    name: str
    columns: str
    key: tuple[str, ...] = ()
    keep_empty: bool = False
    refs: dict[str, str] = field(default_factory=dict)
    dense: bool = False

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, _KINDS[k], False) for n, k in (c.rsplit(" ", 1) for c in self.columns.split(", "))])

    @property
    def column_names(self) -> list[str]:
        return self.schema.names


_POS = "line I, column I, end_line I, end_column I"

TABLES = {t.name: t for t in [
    Table("files", "id L, path S, is_main_file I, mtime L, is_header I, is_system I", ("path",)),
    Table("functions", f"id L, usr S, name S, qualified_name S, return_type S, file_id L, {_POS}, is_definition I, is_inline I, is_variadic I, is_static I, is_system I",
          ("usr",), True, {"file_id": "files"}),
    Table("classes", "id L, usr S, name S, qualified_name S, kind S, file_id L, line I, is_definition I, is_abstract I, namespace_id L, is_system I",
          ("usr",), True, {"file_id": "files"}),
    Table("methods", "id L, usr S, class_id L, name S, qualified_name S, return_type S, access S, is_virtual I, is_pure_virtual I, is_static I, is_const I, "
          f"is_override I, is_final I, {_POS}, is_system I", ("usr",), False, {"class_id": "classes"}),
    Table("fields", "id L, class_id L, name S, type S, access S, is_static I, is_mutable I, bit_width I, offset_bits L, is_system I",
          refs={"class_id": "classes"}, dense=True),
    Table("variables", "id L, usr S, name S, type S, file_id L, line I, function_id L, method_id L, namespace_id L, scope_kind S, storage_class S, is_const I, "
          "is_inline I, is_system I", ("usr",), True, {"file_id": "files", "function_id": "functions", "method_id": "methods"}, True),
    Table("parameters", "id L, function_id L, method_id L, name S, type S, index_ I, has_default I, is_system I",
          refs={"function_id": "functions", "method_id": "methods"}, dense=True),
    Table("enums", "id L, usr S, name S, underlying_type S, is_scoped I, file_id L, line I, is_system I", ("usr",), True, {"file_id": "files"}),
    Table("enum_values", "id L, enum_id L, name S, value L, is_system I", refs={"enum_id": "enums"}, dense=True),
    Table("calls", "id L, caller_usr S, callee_usr S, callee_name S, file_id L, line I, column I, is_virtual I, is_system I", refs={"file_id": "files"}, dense=True),
    Table("inheritance", "id L, derived_usr S, derived_name S, base_usr S, base_name S, access S, file_id L, is_virtual I, is_system I",
          ("derived_usr", "base_usr"), False, {"file_id": "files"}, True),
    Table("string_literals", "id L, content S, file_id L, line I, column I, function_usr S, func_id L, method_id L, is_wide I, is_system I",
          refs={"file_id": "files", "func_id": "functions", "method_id": "methods"}, dense=True),
]}

#: staging columns that extraction adds: order of translation units and visits
STAGING = ("tu_ord", "seq")


def staged(table: Table) -> StructType:
    return StructType([*table.schema.fields, StructField("tu_ord", IntegerType(), False), StructField("seq", LongType(), False)])

"""Scalar functions and aggregates of the source dialect as column expressions.

All stay on the JVM side.  Columns may be given by name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def glob_to_regex(pattern: str, anywhere: bool = False) -> str:
    """Path globs: ``**/`` spans directories (also none), ``*`` and ``?`` stay
    inside one name; ``anywhere`` lets ``*`` cross separators (SQL GLOB)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if not anywhere and pattern.startswith("**", i):
            i += 2
            if i < len(pattern) and pattern[i] in "/\\":
                out += r"(?:.*[/\\])?"
                i += 1
            else:
                out += ".*"
            continue
        if c == "*":
            out += ".*" if anywhere else r"[^/\\]*"
        elif c == "?":
            out += "." if anywhere else r"[^/\\]"
        elif c == "[" and anywhere and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", r"\\") + "]"
            i = end
        elif c in "/\\" and not anywhere:
            out += r"[/\\]"
        else:
            out += re.escape(c)
        i += 1
    return out


def glob(pattern: str, column) -> Column:
    """SQL GLOB: case-sensitive, the whole value."""
    return _c(column).rlike(f"^(?s:{glob_to_regex(pattern, anywhere=True)})$")


def matches_globs(path, patterns: list[str]) -> Column:
    """A path matches one of the globs, whatever the case."""
    if not patterns:
        return F.lit(True)
    return _c(path).rlike("(?i)^(?:" + "|".join(glob_to_regex(p) for p in patterns) + ")$")


def has_component(path, names: list[str], ignore_case: bool = False) -> Column:
    """One of the path's components is one of the names."""
    p = F.translate(_c(path), "\\", "/")
    if ignore_case:
        p, names = F.lower(p), [n.lower() for n in names]
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def schema_from_path(path) -> Column:
    """Base name without its last extension, other signs than letters and digits as _."""
    base = F.regexp_replace(_c(path), r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(base, r"[.][^.]*$", ""), "[^A-Za-z0-9]", "_")


#: fixed values: path parts that mark system headers
SYSTEM_PATHS = ["/usr/include", "/usr/lib", "/usr/local/include", "Program Files", "Windows Kits", "Microsoft Visual Studio"]


def is_system_path(path) -> Column:
    out = F.lit(False)
    for part in SYSTEM_PATHS:
        out = out | _c(path).contains(part)
    return out.cast("int")


def is_header(path) -> Column:
    """The path contains ``.h`` anywhere."""
    return _c(path).contains(".h").cast("int")


def qualified_name(*scopes) -> Column:
    """Scopes joined by ``::``; unnamed ones are skipped."""
    return F.array_join(F.filter(F.array(*[_c(s) for s in scopes]), lambda x: x != ""), "::")


def literal_content(spelling) -> Column:
    """Raw text between the first and the last quote of a literal's spelling."""
    return F.regexp_extract(_c(spelling), r'(?s)"(.*)"', 1)


def is_wide_literal(spelling) -> Column:
    return _c(spelling).startswith("L").cast("int")


def access_name(kind) -> Column:
    """public, protected, private, or unknown."""
    c = F.lower(_c(kind))
    return F.when(c.isin("public", "protected", "private"), c).otherwise("unknown")


# -- functions of the embedded engine whose meaning differs --------------------

def int_div(a, b) -> Column:
    """Integer division that truncates and gives NULL for a zero divisor."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, F.try_divide(a - F.try_mod(a, b), b).cast("bigint"))


def substr(s, start: int, length: int) -> Column:
    """Position 0 stands before the first character and uses up length."""
    if start == 0:
        return F.substring(_c(s), 1, max(0, length - 1))
    return F.substring(_c(s), start, length)


def trim_chars(s, chars: str) -> Column:
    return F.trim(_c(s), F.lit(chars))


def scalar_max(*cols) -> Column:
    """Greatest value; NULL if any is NULL."""
    cs = [_c(c) for c in cols]
    out = F.greatest(*cs)
    for c in cs:
        out = F.when(c.isNotNull(), out)
    return out


def scalar_min(*cols) -> Column:
    cs = [_c(c) for c in cols]
    out = F.least(*cs)
    for c in cs:
        out = F.when(c.isNotNull(), out)
    return out


def iif(condition, a, b) -> Column:
    return F.when(_c(condition), _c(a)).otherwise(_c(b))


def cast_integer(s) -> Column:
    """Leading integer of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(_c(s), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def total(x) -> Column:
    """Sum as double, 0.0 for no rows."""
    return F.coalesce(F.sum(_c(x).cast("double")), F.lit(0.0))


def group_concat(x, separator: str = ",") -> Column:
    """Values joined in their own order."""
    return F.array_join(F.sort_array(F.collect_list(_c(x).cast("string"))), separator)

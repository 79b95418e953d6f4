"""Results as text tables and JSON envelopes."""

from __future__ import annotations

import json


def cell(v) -> str:
    """One value as the printers show it; NULL is empty text."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def text_table(columns: list[str], rows: list[list]) -> str:
    """Aligned columns, a rule, and the number of rows."""
    if not columns:
        return "(no rows)\n"
    shown = [[cell(v) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in shown)]) for i, c in enumerate(columns)]
    line = lambda values: " | ".join(v.ljust(w) for v, w in zip(values, widths)).rstrip()
    out = [line(columns), "-+-".join("-" * w for w in widths), *(line(r) for r in shown)]
    count = "(no rows)" if not rows else "(1 row)" if len(rows) == 1 else f"({len(rows)} rows)"
    return "\n".join([*out, count]) + "\n"


def json_envelope(columns: list[str], rows: list[list], error: str = "") -> str:
    """``{success, columns, rows, row_count}`` with every cell a string, or
    ``{success: false, error}``."""
    if error:
        return json.dumps({"success": False, "error": error}, ensure_ascii=False)
    return json.dumps(
        {"success": True, "columns": columns, "rows": [[cell(v) for v in r] for r in rows], "row_count": len(rows)}, ensure_ascii=False
    )

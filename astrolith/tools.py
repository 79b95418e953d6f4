"""The session as tools for language-model clients: JSON-RPC over HTTP.

Two tools: ``query`` runs one statement; ``ask`` takes free text, runs it when
it is a statement, and otherwise says that no language provider is connected
(``answer`` may be given to connect one).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from astrolith import __version__
from astrolith.plans.dialect import looks_like_sql
from astrolith.render import text_table
from astrolith.session import FactSession

PROTOCOL = "2024-11-05"
_TEXT = {"type": "object", "properties": {"text": {"type": "string"}}, "required": ["text"]}
TOOLS = [
    {"name": "query", "description": "Run one SQL statement over the attached facts.",
     "inputSchema": {"type": "object", "properties": {"sql": {"type": "string"}}, "required": ["sql"]}},
    {"name": "ask", "description": "Ask about the code; SQL is run as it is.", "inputSchema": _TEXT},
]


def handle(session: FactSession, message: str, answer: Callable[[str], str] | None = None) -> str | None:
    """The reply to one JSON-RPC message; None for notifications."""
    try:
        m = json.loads(message)
        method, params = m["method"], m.get("params") or {}
    except (ValueError, KeyError, TypeError, AttributeError):
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
    if "id" not in m:
        return None
    reply = {"jsonrpc": "2.0", "id": m["id"]}
    if method == "initialize":
        reply["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "astrolith", "version": __version__}}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": TOOLS}
    elif method == "tools/call":
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in ("query", "ask"):
            reply["error"] = {"code": -32602, "message": f"no tool {name}"}
        else:
            text, failed = _call(session, name, args, answer)
            reply["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        reply["error"] = {"code": -32601, "message": f"no method {method}"}
    return json.dumps(reply, ensure_ascii=False)


def _call(session: FactSession, name: str, args: dict, answer) -> tuple[str, bool]:
    text = str(args.get("sql" if name == "query" else "text") or "")
    if name == "ask" and not looks_like_sql(text):
        return (answer(text), False) if answer else ("no language provider is connected; give a statement", True)
    columns, rows, error = session.exec(text)
    return (error, True) if error else (text_table(columns, rows), False)

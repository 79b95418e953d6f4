"""HTTP over a session: /, /help, /status, /query, /tools, /shutdown.

A Spark session takes concurrent queries, so requests are not queued.  With a
token set, every request but /help must carry it.
"""

from __future__ import annotations

import hmac
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from astrolith import tools
from astrolith.render import json_envelope
from astrolith.session import FactSession

#: bytes of a statement that are accepted
MAX_BODY = 1_000_000

HELP = """GET /help      this text
GET /status    attached schemas and tables
POST /query    one SQL statement as the body; JSON comes back
POST /tools    one JSON-RPC message of a language-model client
POST /shutdown stop the server
"""


def make_server(session: FactSession, host: str = "127.0.0.1", port: int = 8080, token: str = "") -> ThreadingHTTPServer:
    """A server that is not yet serving; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _allowed(self) -> bool:
            if not token:
                return True
            given = self.headers.get("Authorization", "").removeprefix("Bearer ").strip() or self.headers.get("X-Token", "")
            if hmac.compare_digest(given.encode(), token.encode()):
                return True
            self._send(401, json_envelope([], [], "unauthorized"))
            return False

        def do_GET(self) -> None:
            if self.path in ("/", "/help"):
                self._send(200, HELP, "text/plain")
            elif self.path == "/status":
                if self._allowed():
                    self._send(200, json.dumps({"success": True, "schemas": session.attached_schemas(), "tables": session.tables()}))
            else:
                self._send(404, json_envelope([], [], "not found"))

        def do_POST(self) -> None:
            if not self._allowed():
                return
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                self._send(413, json_envelope([], [], "statement too long"))
                return
            body = self.rfile.read(size).decode("utf-8", "replace")
            if self.path == "/query":
                columns, rows, error = session.exec(body)
                self._send(400 if error else 200, json_envelope(columns, rows, error))
            elif self.path == "/tools":
                reply = tools.handle(session, body)
                self._send(200 if reply else 202, reply or "")
            elif self.path == "/shutdown":
                self._send(200, json.dumps({"success": True}))
                threading.Thread(target=self.server.shutdown, daemon=True).start()
            else:
                self._send(404, json_envelope([], [], "not found"))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

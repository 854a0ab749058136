"""A thin HTTP daemon: POST /search with a JSON request gives the JSON response."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, HTTPServer

from mathloom.plans.engine import Engine

PORT = 8921
MAX_BODY = 1 << 20


def server(engine: Engine, host: str = "127.0.0.1", port: int = PORT) -> HTTPServer:
    """Call ``serve_forever`` of it; one request at a time, as a query uses the whole cluster."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/search" or not 0 < size <= MAX_BODY:
                self.send_error(404 if self.path != "/search" else 400)
                return
            body = engine.request(self.rfile.read(size).decode("utf-8", "replace")).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            return None

    return HTTPServer((host, port), Handler)

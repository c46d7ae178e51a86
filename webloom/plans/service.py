"""A small HTTP service: GET /add?url=... crawls the urls and answers with the items."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

#: urls to items
Answer = Callable[[list[str]], list[dict]]


class Service:
    """Runs in a thread; one query at a time, each a crawl of its own."""

    def __init__(self, answer: Answer, port: int = 8079, address: str = "127.0.0.1") -> None:
        lock = threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                parts = urlparse(self.path)
                urls = parse_qs(parts.query).get("url", [])
                if parts.path != "/add":
                    return self.reply(404, {"error": "not found"})
                if not urls:
                    return self.reply(400, {"error": "no url"})
                with lock:
                    try:
                        items = answer(urls)
                    except Exception as e:  # noqa: BLE001  the service goes on
                        return self.reply(500, {"error": str(e)[:300]})
                return self.reply(200, {"items": items}) if items else self.reply(400, {"error": "nothing was produced"})

            def reply(self, status: int, content: dict) -> None:
                body = json.dumps(content, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_: object) -> None:
                pass

        self.server = ThreadingHTTPServer((address, port), Handler)
        self.port = self.server.server_address[1]

    def start(self) -> Service:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()

"""The request function over HTTP: ``GET /healthz``, ``GET /info`` and ``POST /chunk``.

One document a request, for interactive use; collections go through the DataFrame
functions. Requests that can't be chunked get 422 with ``detail``. One request is chunked at
a time, others wait; the probes don't.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..functions.embed import embedder, release
from .service import BadRequest, chunk_request

#: Bytes of a request at most.
MOST = 64_000_000


def _handler(version: str, model_dir: str | None, release_after: bool) -> type[BaseHTTPRequestHandler]:
    one = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/healthz":
                self.answer(200, {"status": "ok"})
            elif self.path == "/info":
                self.answer(200, {"version": version, "embeddings_available": embedder(model_dir).available})
            else:
                self.answer(*((405, {"detail": "POST"}) if self.path == "/chunk" else (404, {"detail": "not found"})))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/chunk":
                self.answer(*((405, {"detail": "GET"}) if self.path in ("/healthz", "/info") else (404, {"detail": "not found"})))
                return
            if size > MOST:
                self.answer(413, {"detail": f"a request has {MOST} bytes at most"})
                return
            try:
                body = json.loads(self.rfile.read(size))
                with one:
                    got = chunk_request(body, model_dir)
                    if release_after:
                        release()
            except (BadRequest, ValueError) as e:
                self.answer(422, {"detail": str(e)})
                return
            self.answer(200, got)

        def log_message(self, *args) -> None:
            pass

    return Handler


@contextmanager
def serving(host: str = "127.0.0.1", port: int = 8000, model_dir: str | None = None, release_after: bool = False) -> Iterator[str]:
    """A server in a thread of its own, for as long as the context lasts; gives its address.
    Port 0 takes any that is free."""
    from .. import __version__

    server = ThreadingHTTPServer((host, port), _handler(__version__, model_dir, release_after))
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield f"http://{host}:{server.server_address[1]}"
    finally:
        server.shutdown()
        server.server_close()
        thread.join()


def serve(host: str = "0.0.0.0", port: int = 8000, model_dir: str | None = None, release_after: bool = False) -> None:
    """Serve until interrupted."""
    with serving(host, port, model_dir, release_after) as address:
        print(f"chunkloom: {address}")
        try:
            threading.Event().wait()
        except KeyboardInterrupt:
            pass

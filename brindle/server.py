"""The HTTP interface on the standard library: JSON in, JSON out; file contents as base64."""

from __future__ import annotations

import base64
import json
from dataclasses import asdict
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from brindle.app import KnowledgeBase
from brindle.functions.filters import FilterError
from brindle.model import SearchRequest
from brindle.operators.embed import EmbeddingError


def handle(kb: KnowledgeBase, method: str, url: str, body: Any = None) -> tuple[int, Any]:
    """(status, result) of a request."""
    at = urlparse(url)
    path = [p for p in at.path.split("/") if p]
    given = {k: v[-1] for k, v in parse_qs(at.query).items()}
    try:
        if (method, path) == ("GET", ["health"]):
            return 200, {"status": "ok", "schema": kb.store.revision}
        if (method, path) == ("POST", ["query"]):
            return 200, asdict(kb.search(SearchRequest(**body)))
        if (method, path) == ("POST", ["documents"]):
            days = ("valid_from", "valid_until", "review_by")
            return 200, kb.upload_all([{k: base64.b64decode(v) if k == "content" else date.fromisoformat(v) if k in days and v else v for k, v in f.items()} for f in body])
        if (method, path) == ("GET", ["documents"]):
            limit, offset = int(given.get("limit", 100)), int(given.get("offset", 0))
            if not 1 <= limit <= 1000 or offset < 0:
                return 400, {"detail": "limit is 1 to 1000, offset at least 0"}
            return 200, kb.documents(limit, offset, given.get("include_history", "false").lower() == "true")
        if path[:1] == ["documents"] and len(path) in (2, 3):
            if method == "DELETE" and len(path) == 2:
                return (200, {"deleted": path[1]}) if kb.delete(path[1]) else (404, {"detail": "no such document"})
            if method == "GET" and path[2:] in ([], ["versions"]):
                found = kb.document_versions(path[1]) if path[2:] else kb.document(path[1])
                return (200, found) if found is not None else (404, {"detail": "no such document"})
    except EmbeddingError as e:
        return 502, {"detail": str(e)}
    except (FilterError, ValueError, TypeError) as e:
        return 400, {"detail": str(e)}
    return 404, {"detail": "no such path"}


def serve(kb: KnowledgeBase, host: str = "127.0.0.1", port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else None
                status, result = handle(kb, self.command, self.path, body)
            except json.JSONDecodeError as e:
                status, result = 400, {"detail": f"invalid JSON: {e}"}
            data = json.dumps(result, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

    ThreadingHTTPServer((host, port), Handler).serve_forever()

"""The engine over HTTP, with the standard library's server.

    GET /healthz    GET /collections    POST /ingest (multipart form)    POST /query (JSON)

Requests are handled by ``respond``, a plain function, so that any other server can be put in front of it.
"""

from __future__ import annotations

import json
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import NamedTuple

from pyspark.errors import PySparkException

from .operators import access
from .operators.chunk import ChunkingOptions
from .plans.engine import BadQuestion, Engine, UploadTooLarge
from .providers import ProviderError

VERSION = "1.0"
KEY_HEADER = "X-API-Key"
ERROR_STATUS = {"UnsupportedFileType": 415, "DocumentParseError": 422}


class HttpError(Exception):
    def __init__(self, status: int, detail: str, headers: dict[str, str] | None = None):
        super().__init__(detail)
        self.status, self.detail, self.headers = status, detail, headers or {}


class Response(NamedTuple):
    status: int
    body: dict
    headers: dict[str, str]


def _flag(said: str) -> bool:
    if said.lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
        raise HttpError(422, f"{said!r} is neither true nor false")
    return said.lower() in ("true", "1", "yes", "on")


def form(content_type: str, body: bytes) -> tuple[dict[str, str], list[tuple[str, bytes]]]:
    """Fields and (name, bytes) of the files of a multipart form."""
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode("latin-1") + b"\r\n\r\n" + body)
    if not message.is_multipart():
        raise HttpError(422, "a multipart form is needed")
    fields, found = {}, []
    for part in message.iter_parts():
        data = part.get_payload(decode=True) or b""
        if part.get_filename() is not None:
            found.append((part.get_filename() or "document", data))
        else:
            fields[str(part.get_param("name", "", "content-disposition"))] = data.decode("utf-8", "replace")
    return fields, found


def _ingest(engine: Engine, principal: access.Principal, content_type: str, body: bytes) -> dict:
    fields, found = form(content_type, body)
    if "collection" not in fields or not found:
        raise HttpError(422, "a collection and files are needed")
    collection = access.check_collection_name(fields["collection"])
    access.require(principal, collection)
    s = engine.settings
    try:
        options = ChunkingOptions(
            int(fields.get("chunk_size", s.chunk_size)), int(fields.get("chunk_overlap", s.chunk_overlap)), _flag(fields["heading_aware"]) if "heading_aware" in fields else s.heading_aware
        )
    except ValueError as e:
        raise HttpError(422, str(e)) from e
    for name, data in found:
        if len(data) > s.max_upload_mb << 20:
            raise UploadTooLarge(f"{name} has more than {s.max_upload_mb} MB")
    rows = engine.spark.createDataFrame([(f"{i:09d}", n, bytearray(d)) for i, (n, d) in enumerate(found)], "path string, name string, content binary")
    report = engine.ingest_files(collection, rows, options, strict=False).collect()
    for r in report:  # what could be read is stored by now
        if r.error is not None:
            raise HttpError(ERROR_STATUS.get(r.error_kind, 422), r.error)
    return {"collection": collection, "documents": [{"document": r.document, "doc_id": r.doc_id, "chunks": r.chunks, "pages": r.pages} for r in report]}


def _query(engine: Engine, principal: access.Principal, body: bytes) -> dict:
    try:
        asked = json.loads(body)
        collection, question, top_k, rerank = asked["collection"], asked["question"], asked.get("top_k"), asked.get("rerank", True)
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise HttpError(422, "a JSON object with collection and question is needed") from e
    if not isinstance(collection, str) or not isinstance(question, str) or not isinstance(rerank, bool) or not (top_k is None or type(top_k) is int and 1 <= top_k <= 50):
        raise HttpError(422, "collection and question are strings, top_k is from 1 to 50, rerank is true or false")
    access.check_collection_name(collection)
    access.require(principal, collection)
    r = engine.answer(engine.questions(collection, question), top_k, rerank=rerank).first()
    return {"answer": r.answer, "citations": [c.asDict() for c in r.citations], "retrieved": [c.asDict() for c in r.retrieved]}


def respond(engine: Engine, method: str, path: str, headers: dict[str, str], body: bytes = b"") -> Response:
    """What the server says to a request."""
    said = {k.lower(): v for k, v in headers.items()}
    origin = said.get("origin")
    extra = {"Access-Control-Allow-Origin": origin} if origin and origin in engine.settings.cors_origins else {}
    try:
        return Response(200, _route(engine, method, path.partition("?")[0], said, body), extra)
    except HttpError as e:
        return Response(e.status, {"detail": e.detail}, extra | e.headers)
    except access.Unauthorised as e:
        return Response(401, {"detail": str(e)}, extra | {"WWW-Authenticate": KEY_HEADER})
    except access.Forbidden as e:
        return Response(403, {"detail": str(e)}, extra)
    except UploadTooLarge as e:
        return Response(413, {"detail": str(e)}, extra)
    except (access.InvalidName, BadQuestion) as e:
        return Response(422, {"detail": str(e)}, extra)
    except (ProviderError, PySparkException) as e:
        if isinstance(e, PySparkException) and "ProviderError" not in str(e):
            raise
        return Response(502, {"detail": "the model provider failed"}, extra)


def _route(engine: Engine, method: str, path: str, headers: dict[str, str], body: bytes) -> dict:
    s = engine.settings
    if (method, path) == ("GET", "/healthz"):
        return engine.health() | {"version": VERSION, "auth_enabled": bool(s.api_keys)}
    if (method, path) not in (("GET", "/collections"), ("POST", "/ingest"), ("POST", "/query")):
        known = path in ("/healthz", "/collections", "/ingest", "/query")
        raise HttpError(405 if known else 404, "method not allowed" if known else "not found")
    principal = access.resolve_principal(s.api_keys, headers.get(KEY_HEADER.lower()))
    if principal is None:
        raise access.Unauthorised("missing or invalid API key")
    if path == "/collections":
        return {"collections": [r.asDict() for r in engine.collections(principal).collect()]}
    return _ingest(engine, principal, headers.get("content-type", ""), body) if path == "/ingest" else _query(engine, principal, body)


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't running yet; port 0 takes a free one. Bodies above the upload limit (and a form) aren't read."""
    most = (engine.settings.max_upload_mb + 1) << 20

    class Handler(BaseHTTPRequestHandler):
        def _handle(self) -> None:
            size = int(self.headers.get("content-length") or 0)
            if size > most:
                out = Response(413, {"detail": f"more than {engine.settings.max_upload_mb} MB"}, {"Connection": "close"})
            else:
                out = respond(engine, self.command, self.path, dict(self.headers.items()), self.rfile.read(size))
            data = json.dumps(out.body, ensure_ascii=False).encode()
            self.send_response(out.status)
            for k, v in ({"Content-Type": "application/json", "Content-Length": str(len(data))} | out.headers).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _handle

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

"""The HTTP interface: as a function, and once over a socket."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from docengine.config import Settings
from docengine.plans.engine import Engine
from docengine.providers import Client, HttpChat, HttpReply
from docengine.server import respond, server

from . import fixtures

KEYS = {"demo-key": ["demo"], "hr-key": ["hr"], "admin-key": ["*"]}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, Settings(store_path=str(tmp_path_factory.mktemp("s")), chunk_size=500, chunk_overlap=80, api_keys=KEYS, cors_origins=["http://a"]))


def upload(engine, files, collection="demo", key="demo-key", **fields):
    parts = b"".join(b'--B\r\nContent-Disposition: form-data; name="%s"\r\n\r\n%s\r\n' % (k.encode(), str(v).encode()) for k, v in {"collection": collection, **fields}.items())
    parts += b"".join(b'--B\r\nContent-Disposition: form-data; name="files"; filename="%s"\r\nContent-Type: application/octet-stream\r\n\r\n%s\r\n' % (n.encode(), d) for n, d in files.items())
    return respond(engine, "POST", "/ingest", {"Content-Type": "multipart/form-data; boundary=B", "X-API-Key": key}, parts + b"--B--\r\n")


def query(engine, key="demo-key", **body):
    return respond(engine, "POST", "/query", {"X-API-Key": key}, json.dumps(body).encode())


def test_u2_u9_ingest_and_query(engine):
    got = upload(engine, fixtures.FILES)
    assert got.status == 200 and [d["document"] for d in got.body["documents"]] == sorted(fixtures.FILES)
    assert next(d for d in got.body["documents"] if d["document"] == "rules.pdf")["pages"] == 2
    got = query(engine, collection="demo", question="How many characters must passwords have?", top_k=3)
    assert got.status == 200 and "16 characters" in got.body["answer"]
    assert got.body["citations"][0]["document"] == "rules.pdf" and got.body["citations"][0]["page"] == 1 and len(got.body["retrieved"]) == 3
    assert respond(engine, "GET", "/collections", {"x-api-key": "demo-key"}).body["collections"] == [{"name": "demo", "documents": 4, "chunks": got_chunks(engine)}]
    assert respond(engine, "GET", "/collections", {"x-api-key": "hr-key"}).body == {"collections": []}
    health = respond(engine, "GET", "/healthz", {"Origin": "http://a"})
    assert health.status == 200 and health.body["auth_enabled"] and health.headers["Access-Control-Allow-Origin"] == "http://a"


def got_chunks(engine):
    return engine.store.chunks("demo").count()


def test_u3_u4_p13_errors(engine):
    ask = {"collection": "demo", "question": "x?"}
    assert respond(engine, "GET", "/collections", {}).status == 401 and query(engine, key="wrong", **ask).status == 401
    assert query(engine, key="hr-key", **ask).status == 403 and upload(engine, {"a.txt": b"x"}, key="hr-key").status == 403
    assert upload(engine, {"a.xyz": b"x"}).status == 415 and upload(engine, {"a.pdf": b"x"}).status == 422
    for body in ({"collection": "demo"}, {**ask, "question": ""}, {**ask, "question": "x" * 4001}, {**ask, "top_k": 0}, {**ask, "top_k": 51}, {**ask, "collection": "no name"}, {**ask, "rerank": 3}):
        assert query(engine, **body).status == 422
    for fields in ({"chunk_size": 10}, {"chunk_size": "many"}, {"chunk_overlap": 900}, {"heading_aware": "maybe"}):
        assert upload(engine, {"a.txt": b"x"}, **fields).status == 422
    assert upload(engine, {}).status == 422 and upload(engine, {"a.txt": b"x"}, collection="-").status == 422
    assert upload(engine, {"a.txt": b"x" * ((25 << 20) + 1)}).status == 413
    assert respond(engine, "GET", "/nothing", {}).status == 404 and respond(engine, "GET", "/query", {}).status == 405
    assert query(engine, key="admin-key", collection="empty", question="x?").body["citations"] == []


def refused(url, headers, body, timeout):
    return HttpReply(400, {}, b"no")


def test_u4_provider_failures(engine):
    upload(engine, {"a.txt": b"some words about dogs"})
    engine.llm = HttpChat(Client("http://x", transport=refused))
    try:
        assert query(engine, collection="demo", question="dogs?").status == 502
    finally:
        engine.llm = None


def test_over_a_socket(engine):
    s = server(engine, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{s.server_port}"
        with urllib.request.urlopen(f"{url}/healthz", timeout=30) as r:
            assert json.loads(r.read())["status"] == "ok"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"{url}/query", b"{}", method="POST"), timeout=30)
        assert e.value.code == 401
    finally:
        s.shutdown()
        s.server_close()

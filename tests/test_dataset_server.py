import io
import json

import pytest

from tarnwell.server import Server
from tarnwell.sources import dataset as D


def span(path, a, b):
    return {"path": path, "content_sha256": "h", "qualified_symbol": "s", "start_byte": a, "end_byte": b}


def case(ident, **kw):
    base = {"id": ident, "text": "q", "language": "go", "cohorts": ["x"], "answer_mode": "single", "required_groups": [{"id": "g1", "alternatives": [{"spans": [span("a", 2, 5), span("b", 0, 9)]}, {"spans": [span("c", 1, 2)]}]}, {"id": "g2", "alternatives": [{"spans": [span("d", 0, 1)]}]}], "hard_negatives": [{"span": span("e", 0, 1), "reason": "r"}], "judgments": [{"span": span("a", 2, 5), "grade": 2, "rationale": ""}]}
    return base | kw


def test_dataset(spark, tmp_path):
    text = D.to_text([case("1"), case("2", text=" "), case("3", judgments=[{"span": span("a", 5, 5), "grade": 7, "rationale": ""}], required_groups=[]), case("4", answer_mode="abstainable", required_groups=[])])
    D.check_text(text)
    (tmp_path / "d.json").write_text(text)
    cases = D.load_cases(spark, str(tmp_path / "d.json"))
    assert {(r.id, r.violation) for r in D.violations(cases).collect()} == {("2", "empty text"), ("3", "no required group"), ("3", "grade")}
    hits = spark.createDataFrame([("1", "a", "h", "s", 0, 9, 1), ("1", "b", "h", "s", 0, 9, 4), ("1", "d", "h", "s", 5, 9, 2), ("1", "d", "other", "s", 0, 9, 3)], "id string, path string, content_sha256 string, qualified_symbol string, hit_start int, hit_end int, rank int")
    found = D.contained(hits, D.spans(cases.where("id = '1'")))
    got = {k: D.requirement_coverage(found, k).first() for k in (3, 5)}
    assert (got[3].coverage, got[5].coverage, got[5].complete) == (0.0, 0.5, False)
    assert D.judgments(cases.where("id = '1'")).count() == 2
    for bad in (text + " x", '{"cases": [], "more": 1}', "[]", '{"version": "1", "version": "2"}'):
        with pytest.raises(ValueError):
            D.check_text(bad)


class Stub:
    def status(self):
        return {"files": 3}

    def search(self, query, k, budget, mode):
        if query == "boom":
            raise RuntimeError("x")
        return {"q": query, "k": k, "budget": budget, "mode": mode}


def test_server():
    out = io.StringIO()
    ask = lambda i, m, **p: json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p})
    lines = [ask(1, "status"), ask("s", "search", query="x", max_inline_bytes=5), ask(3, "search", query="x"), ask(4, "none"), ask(5, "status", extra=1), "{", "[]", json.dumps({"jsonrpc": "2.0", "id": 1.5, "method": "status"}), ask(6, "search", query="boom", max_inline_bytes=0), ask(7, "search", query="x", max_inline_bytes=True), '{"jsonrpc":"2.0","jsonrpc":"2.0"}', "", json.dumps({"jsonrpc": "2.0", "method": "status"})]
    Server(Stub(), out).serve(io.StringIO("\n".join(lines)))
    answers = [json.loads(line) for line in out.getvalue().splitlines()]
    by_id = {a["id"]: a for a in answers if a["id"] is not None}
    assert by_id[1]["result"] == {"files": 3} and by_id["s"]["result"] == {"q": "x", "k": None, "budget": 5, "mode": "fts"}
    assert [by_id[i]["error"]["code"] for i in (3, 4, 5, 6, 7)] == [-32602, -32601, -32602, -32603, -32602]
    assert sorted(a["error"]["code"] for a in answers if a["id"] is None) == [-32700, -32700, -32600, -32600]


def test_server_calls_off_and_refuses(monkeypatch):
    import threading

    import tarnwell.server as module

    begun, go = threading.Event(), threading.Event()

    class Slow(Stub):
        def status(self):
            begun.set()
            go.wait(10)
            return {}

    ask = lambda i, m, **p: json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) + "\n"

    class Lines:
        def __init__(self, lines):
            self.lines = iter(lines)

        def readline(self, most):
            line = next(self.lines, "")
            return line() if callable(line) else line

    def after_first():
        begun.wait(10)
        return ask(1, "status")

    def let_go():
        go.set()
        return ask(3, "search", query="x", max_inline_bytes=1)

    out = io.StringIO()
    Server(Slow(), out).serve(Lines([ask(1, "status"), after_first, ask("1", "search", query="x", max_inline_bytes=1), json.dumps({"jsonrpc": "2.0", "method": "notifications/cancelled", "params": {"requestId": 1}}) + "\n", let_go]))
    answers = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [a for a in answers if a["id"] == 1] == [{"jsonrpc": "2.0", "id": 1, "error": {"code": -32600, "message": "the id is in use"}}]
    assert {a["id"] for a in answers} == {1, "1", 3}
    monkeypatch.setattr(module, "MAX_FRAME", 50)
    found = list(module.frames(io.StringIO("short\n" + "x" * 500 + "\nlast")))
    assert found == ["short\n", None, "last"]


def test_http_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tarnwell.sources.embedding import Retryable, call
    from tarnwell.sources.http_embedding import HttpClient, retry_after

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body))
            text = body["input"][0]
            status = {"busy": 429, "wrong": 400}.get(text, 200)
            rows = [{"index": i, "embedding": [1.0, float(i)]} for i in range(len(body["input"]))][::-1]
            data = json.dumps({"data": "none" if text == "shape" else rows, "model": body["model"]}).encode()
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "7")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpClient(f"http://127.0.0.1:{server.server_port}/", "secret", "m", 2, timeout=5)
    assert call(client, ["a", "b"], 2, ()) == [[1.0, 0.0], [1.0, 1.0]]
    assert seen[0][0] == "Bearer secret" and seen[0][1]["output_dimension"] == 2 and "secret" not in repr(client)
    assert client.as_query().input_type == "query"
    with pytest.raises(Retryable) as e:
        client.embed(["busy"])
    assert e.value.after == 7
    for text in ("wrong", "shape", ""):
        with pytest.raises(ValueError):
            client.embed([text])
    server.shutdown()
    server.server_close()
    with pytest.raises(Retryable):
        client.embed(["a"])
    assert retry_after("Thu, 01 Jan 1970 00:01:40 GMT", 40.0) == 60.0 and retry_after("soon") is None

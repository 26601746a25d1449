"""Line-delimited JSON-RPC over two text streams: status, search, read_span, reindex."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, TextIO

from tarnwell.operators.query import QueryError
from tarnwell.service import Index
from tarnwell.sources.config import ConfigError, strict_json

MAX_FRAME = 16 << 20
WORKERS, QUEUE = 8, 8

# JSON-RPC 2.0 error codes.
PARSE, INVALID, NO_METHOD, BAD_PARAMS, BUSY, FAILED = -32700, -32600, -32601, -32602, -32000, -32603

PARAMETERS: dict[str, dict[str, type]] = {
    "status": {},
    "search": {"query": str, "max_inline_bytes": int, "k": int, "mode": str},
    "read_span": {"path": str, "start_line": int, "end_line": int, "expected_sha256": str},
    "reindex": {"dry_run": bool},
}
REQUIRED = {"search": {"query", "max_inline_bytes"}, "read_span": {"path", "start_line", "end_line"}}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def arguments(method: str, params: Any) -> dict:
    """Checked arguments: an object of known names and exact types, all required ones present."""
    if method not in PARAMETERS:
        raise RpcError(NO_METHOD, f"no method {method}")
    params = {} if params is None else params
    if not isinstance(params, dict):
        raise RpcError(BAD_PARAMS, "an object is expected")
    known = PARAMETERS[method]
    for k, v in params.items():
        if k not in known or type(v) is not known[k]:
            raise RpcError(BAD_PARAMS, f"parameter {k}")
    if missing := REQUIRED.get(method, set()) - set(params):
        raise RpcError(BAD_PARAMS, f"missing {sorted(missing)}")
    return params


def frames(lines: TextIO) -> Iterator[str | None]:
    """Lines up to MAX_FRAME characters; None for a longer one, which is never held whole."""
    while line := lines.readline(MAX_FRAME + 1):
        if len(line) <= MAX_FRAME or line.endswith("\n"):
            yield line
            continue
        while (rest := lines.readline(1 << 20)) and not rest.endswith("\n"):
            pass
        yield None


def canonical_id(ident: Any) -> tuple[str, str]:
    """What tells requests apart: 1 and "1" are two ids."""
    return type(ident).__name__, str(ident)


class Server:
    def __init__(self, index: Index, out: TextIO):
        self.index, self.out, self.lock = index, out, threading.Lock()
        self.room = threading.Semaphore(WORKERS + QUEUE)
        #: Requests that were not answered yet, each with its group of Spark jobs and whether it was called off.
        self.active: dict[tuple[str, str], dict] = {}

    def call(self, method: str, params: Any) -> Any:
        a = arguments(method, params)
        if method == "status":
            return self.index.status()
        if method == "reindex":
            return self.index.reindex(a.get("dry_run", False)).__dict__
        if method == "read_span":
            return self.index.read_span(a["path"], a["start_line"], a["end_line"], a.get("expected_sha256"))
        return self.index.search(a["query"], a.get("k"), a["max_inline_bytes"], a.get("mode", "fts"))

    def _send(self, answer: dict) -> None:
        with self.lock:
            self.out.write(json.dumps({"jsonrpc": "2.0", **answer}, ensure_ascii=False, default=str) + "\n")
            self.out.flush()

    def _context(self):
        spark = getattr(self.index, "spark", None)
        return spark.sparkContext if spark is not None else None

    def _answer(self, ident: Any, method: str, params: Any) -> None:
        state = self.active.get(canonical_id(ident), {}) if ident is not None else {}
        context = self._context()
        try:
            if state.get("off"):
                return
            if context is not None:
                context.setJobGroup(state.get("group", f"notice-{uuid.uuid4().hex}"), method, interruptOnCancel=True)
            answer: dict = {"result": self.call(method, params)}
        except RpcError as e:
            answer = {"error": {"code": e.code, "message": str(e)}}
        except (QueryError, ValueError, OSError) as e:
            answer = {"error": {"code": BAD_PARAMS, "message": str(e)}}
        except Exception as e:
            answer = {"error": {"code": FAILED, "message": type(e).__name__}}
        finally:
            with self.lock:
                self.active.pop(canonical_id(ident), None)
            self.room.release()
        # A request that was called off gets no answer.
        if ident is not None and not state.get("off"):
            self._send({"id": ident, **answer})

    def _cancel(self, params: Any) -> None:
        """Call off a request: one that waits is skipped, the Spark jobs of one that runs are cancelled."""
        ident = params.get("requestId") if isinstance(params, dict) else None
        with self.lock:
            state = self.active.get(canonical_id(ident))
            if state is not None:
                state["off"] = True
        context = self._context()
        if state is not None and context is not None:
            context.cancelJobGroup(state["group"])

    def serve(self, lines: TextIO) -> None:
        """Answer requests until the input ends; one over the queue's length is told that the server is busy."""
        with ThreadPoolExecutor(WORKERS) as pool:
            for line in frames(lines):
                if line is None:
                    self._send({"id": None, "error": {"code": INVALID, "message": "frame too large"}})
                    continue
                if not line.strip():
                    continue
                try:
                    request = strict_json(line)
                except ConfigError as e:
                    self._send({"id": None, "error": {"code": PARSE, "message": str(e)}})
                    continue
                ident = request.get("id") if isinstance(request, dict) else None
                if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str) or isinstance(ident, (float, bool, dict, list)):
                    self._send({"id": None, "error": {"code": INVALID, "message": "not a request"}})
                    continue
                if request["method"] == "notifications/cancelled":
                    self._cancel(request.get("params"))
                    continue
                if ident is not None:
                    with self.lock:
                        known = canonical_id(ident) in self.active
                        if not known:
                            self.active[canonical_id(ident)] = {"group": f"request-{uuid.uuid4().hex}", "off": False}
                    if known:
                        self._send({"id": ident, "error": {"code": INVALID, "message": "the id is in use"}})
                        continue
                if not self.room.acquire(blocking=False):
                    with self.lock:
                        self.active.pop(canonical_id(ident), None)
                    self._send({"id": ident, "error": {"code": BUSY, "message": "busy"}})
                    continue
                pool.submit(self._answer, ident, request["method"], request.get("params"))

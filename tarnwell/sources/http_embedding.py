"""An embedding provider over HTTP: one JSON request for a group of texts."""

from __future__ import annotations

import email.utils
import json
import time
import urllib.error
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass, field

from tarnwell.sources.config import strict_json
from tarnwell.sources.embedding import Retryable

#: Bytes of an answer that are read at most.
MOST_BYTES = 64 << 20


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds that a Retry-After header asks for: a number of seconds or a date."""
    value = (value or "").strip()
    if not value:
        return None
    if value.isascii() and value.isdigit():
        return float(value)
    try:
        at = email.utils.parsedate_to_datetime(value).timestamp()
    except (TypeError, ValueError):
        return None
    return max(0.0, at - (time.time() if now is None else now))


@dataclass(frozen=True)
class HttpClient:
    """Client of a provider that takes ``input``, ``model``, ``input_type`` and ``output_dimension``.

    The key is sent as a bearer token and never shown. Timeouts, dropped connections and
    the statuses 408, 429 and 5xx may go away; any other status or an answer of another
    shape is an error for good. ``embedding.checked`` judges indices and vectors.
    """

    url: str
    key: str = field(repr=False)
    model: str
    dimensions: int
    input_type: str = "document"
    timeout: float = 60.0

    def as_query(self) -> HttpClient:
        return HttpClient(self.url, self.key, self.model, self.dimensions, "query", self.timeout)

    def embed(self, texts: Sequence[str]) -> list[tuple[int, list[float]]]:
        if not self.key:
            raise ValueError("no API key")
        if not texts or any(not t for t in texts):
            raise ValueError("texts must not be empty")
        body = {"input": list(texts), "model": self.model, "input_type": self.input_type, "output_dimension": self.dimensions, "output_dtype": "float", "truncation": False}
        request = urllib.request.Request(self.url, json.dumps(body, ensure_ascii=False).encode("utf-8"), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                raw = answer.read(MOST_BYTES + 1)
        except urllib.error.HTTPError as e:
            wait = retry_after(e.headers.get("Retry-After"))
            e.close()
            if e.code in (408, 429) or e.code >= 500:
                raise Retryable(f"http_{e.code}", wait) from None
            raise ValueError(f"http_{e.code}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Retryable(f"transport: {type(e).__name__}") from None
        if len(raw) > MOST_BYTES:
            raise ValueError("the answer is too large")
        data = strict_json(raw.decode("utf-8"))
        rows = data.get("data") if isinstance(data, dict) else None
        if not isinstance(rows, list) or any(not isinstance(r, dict) or type(r.get("index")) is not int or not isinstance(r.get("embedding"), list) for r in rows):
            raise ValueError("the answer has another shape")
        return [(r["index"], [float(v) for v in r["embedding"]]) for r in rows]

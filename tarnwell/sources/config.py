"""Strict JSON configuration, defaults, validation, fingerprints and the impact of a change."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace

# Defaults and bounds of the policies.
BOUNDS = {
    "return_k": (1, 20),
    "candidate_k": (1, 200),
    "rrf_k": (1, 1000),
    "segment_target_bytes": (128, 65536),
    "source_cap_bytes": (1024, 1 << 24),
    "inline_cap_bytes": (0, 1 << 20),
    "query_max_bytes": (1, 1 << 16),
    "query_max_tokens": (1, 1024),
    "query_max_token_runes": (1, 1024),
    "request_inputs": (1, 1000),
    "request_bytes": (1024, 1 << 22),
    "workers": (1, 64),
}
DIMENSIONS = (512, 1024)


@dataclass(frozen=True)
class Config:
    schema_version: int = 5
    return_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    symbol_weight: float = 5.0
    body_weight: float = 1.0
    segment_target_bytes: int = 1024
    source_cap_bytes: int = 1 << 20
    inline_cap_bytes: int = 1 << 16
    query_max_bytes: int = 8192
    query_max_tokens: int = 64
    query_max_token_runes: int = 128
    request_inputs: int = 128
    request_bytes: int = 262144
    workers: int = 4
    dimensions: int = 1024
    allow_paid_query_embedding: bool = False
    embedding_model: str = "default"
    vector_codec: str = "int8"
    retry_seconds: tuple[int, ...] = (10, 20, 30)
    languages: tuple[str, ...] = ("go", "ts", "tsx")


class ConfigError(ValueError):
    pass


def strict_json(text: str) -> object:
    """JSON without duplicate keys, lone surrogates, constants beyond JSON, or trailing data."""

    def pairs(items):
        seen = {}
        for k, v in items:
            if k in seen:
                raise ConfigError(f"duplicate key {k!r}")
            seen[k] = v
        return seen

    def constant(name):
        raise ConfigError(f"{name} is not JSON")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
        json.dumps(value, ensure_ascii=False).encode("utf-8")
    except UnicodeEncodeError:
        raise ConfigError("lone surrogate") from None
    except json.JSONDecodeError as e:
        raise ConfigError(str(e)) from None
    return value


def resolve(text: str) -> Config:
    """Configuration of a JSON object: unknown fields, nulls and values out of bounds are refused."""
    raw = strict_json(text)
    if not isinstance(raw, dict):
        raise ConfigError("an object is expected")
    known = {f.name for f in fields(Config)}
    if extra := sorted(set(raw) - known):
        raise ConfigError(f"unknown fields: {extra}")
    if empty := sorted(k for k, v in raw.items() if v is None):
        raise ConfigError(f"null fields: {empty}")
    config = replace(Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    for name, (low, high) in BOUNDS.items():
        value = getattr(config, name)
        if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
            raise ConfigError(f"{name}: {value!r} is not within {low}..{high}")
    if not isinstance(config.allow_paid_query_embedding, bool):
        raise ConfigError("allow_paid_query_embedding must be true or false")
    for name in ("embedding_model", "vector_codec"):
        if not isinstance(getattr(config, name), str) or not getattr(config, name).strip():
            raise ConfigError(f"{name} must be a name")
    if config.dimensions not in DIMENSIONS:
        raise ConfigError(f"dimensions: {config.dimensions}")
    if config.return_k > config.candidate_k:
        raise ConfigError("return_k is above candidate_k")
    if any(w <= 0 for w in config.retry_seconds) or list(config.retry_seconds) != sorted(config.retry_seconds):
        raise ConfigError("retry_seconds must rise from above 0")
    return config


def canonical_json(value: object) -> str:
    """JSON with keys in UTF-16 order, no spaces, integers as such and the shortest floats."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


def fingerprint(domain: str, value: object) -> str:
    """SHA-256 of a domain, a zero byte and the canonical JSON."""
    return hashlib.sha256(domain.encode() + b"\0" + canonical_json(value).encode()).hexdigest()


#: Fields of each profile; a profile's fingerprint also holds those it builds on.
PROFILES = {
    "index": (("schema_version", "languages", "source_cap_bytes"), ()),
    "canonical": (("segment_target_bytes",), ("index",)),
    "source": (("embedding_model",), ("canonical",)),
    "space": (("dimensions",), ("source",)),
    "storage": (("vector_codec",), ("space",)),
    "policy": (("return_k", "candidate_k", "rrf_k", "symbol_weight", "body_weight", "inline_cap_bytes", "allow_paid_query_embedding"), ()),
}


def profiles(config: Config) -> dict[str, str]:
    """Fingerprint of each profile."""
    values, out = asdict(config), {}
    for name, (own, below) in PROFILES.items():
        out[name] = fingerprint(f"tarnwell.profile.{name}", {"fields": {k: values[k] for k in own}, "below": [out[b] for b in below]})
    return out


def impact(old: Config, new: Config) -> str:
    """What a change requires, the strongest first: schema, index, canonical, source, space, storage, policy or none."""
    if old.schema_version != new.schema_version:
        return "schema"
    a, b = profiles(old), profiles(new)
    return next((name for name in PROFILES if a[name] != b[name]), "none")

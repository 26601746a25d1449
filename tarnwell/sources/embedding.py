"""Embedding through an injected client: grouping, validation, retries, and an offline stand-in."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Client(Protocol):
    def embed(self, texts: Sequence[str]) -> list[tuple[int, list[float]]]:
        """(index, vector) of each text, in any order."""


class Retryable(RuntimeError):
    """A failure that may go away; ``after`` seconds if the provider says so."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


class HashClient:
    """Deterministic unit vectors from a digest of the text; for tests and dry runs."""

    def __init__(self, dimensions: int = 32):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[tuple[int, list[float]]]:
        out = []
        for i, t in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).normal(size=self.dimensions)
            out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
        return out


def request_groups(sizes: Sequence[int], most: int, budget: int) -> list[list[int]]:
    """Positions in next-fit groups of at most ``most`` inputs and ``budget`` bytes."""
    groups: list[list[int]] = []
    used = 0
    for i, size in enumerate(sizes):
        if not groups or len(groups[-1]) >= most or used + size > budget:
            groups.append([])
            used = 0
        groups[-1].append(i)
        used += size
    return groups


def checked(answer: list[tuple[int, list[float]]], n: int, dimensions: int) -> list[list[float]]:
    """Vectors in input order; raises unless each index comes once with a finite vector of the right size."""
    if sorted(i for i, _ in answer) != list(range(n)):
        raise ValueError("the answer's indices are not those of the request")
    vectors = [v for _, v in sorted(answer)]
    if any(len(v) != dimensions or not np.isfinite(v).all() or not np.any(v) for v in vectors):
        raise ValueError("a vector has the wrong size, is zero or not finite")
    return vectors


def call(client: Client, texts: Sequence[str], dimensions: int, waits: Sequence[float] = (10, 20, 30), sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One request with retries; the provider's own wait wins if it is longer."""
    for wait in [*waits, None]:
        try:
            return checked(client.embed(texts), len(texts), dimensions)
        except Retryable as e:
            if wait is None:
                raise
            sleep(max(wait, e.after or 0))
    raise AssertionError


def embed(inputs: DataFrame, make_client: Callable[[], Client], dimensions: int, most: int = 128, budget: int = 262_144, waits: Sequence[float] = (10, 20, 30)) -> DataFrame:
    """(hash, vector, error) of (hash, text), requests grouped within each batch of a partition.

    A group that fails for good gives its rows an error instead of a vector; other
    groups go on. Repartition the inputs to set how many requests run at once.
    """

    def run(batches):
        client = None
        for b in batches:
            client = client or make_client()
            texts = b["text"].tolist()
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for group in request_groups([len(t.encode()) for t in texts], most, budget):
                try:
                    for i, v in zip(group, call(client, [texts[i] for i in group], dimensions, waits)):
                        vectors[i] = v
                except (Retryable, ValueError) as e:
                    for i in group:
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"hash": b["hash"], "vector": vectors, "error": errors})

    return inputs.select("hash", "text").mapInPandas(run, "hash string, vector array<float>, error string")

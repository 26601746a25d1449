"""What runs here and what it can do: build information, the workspace's root, capabilities, reports."""

from __future__ import annotations

import hashlib
import os
import platform
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def repository_root(start: str) -> str | None:
    """The nearest folder from ``start`` up that holds a repository; None if there is none."""
    at = os.path.realpath(start)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above


def build_info() -> dict:
    """Digest of the package's source, the commit that it was taken from and whether that is clean (null if unknown), and versions."""
    package = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for f in sorted(package.rglob("*.py")):
        digest.update(f"{f.relative_to(package).as_posix()}\0{hashlib.sha256(f.read_bytes()).hexdigest()}\n".encode())
    root = repository_root(str(package))
    commit = clean = None
    if root:
        try:
            commit = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, check=True, text=True).stdout.strip()
            clean = not subprocess.run(["git", "-C", root, "status", "--porcelain", "--", str(package)], capture_output=True, check=True, text=True).stdout.strip()
        except (subprocess.CalledProcessError, FileNotFoundError):
            pass
    import pyspark

    return {"source_sha256": digest.hexdigest(), "commit": commit, "clean": clean, "python": platform.python_version(), "spark": pyspark.__version__}


def capabilities(spark: SparkSession, root: str, client=None) -> dict[str, bool]:
    """What can be done here, each tried: git, a repository, the shared folder from the driver and from executors, Arrow workers, a provider."""
    from tarnwell.sources.published import shared_dir, staged

    def tried(what) -> bool:
        try:
            return bool(what())
        except Exception:  # noqa: BLE001  a probe says no, whatever the reason
            return False

    def git() -> bool:
        return subprocess.run(["git", "--version"], capture_output=True, check=False).returncode == 0

    rows = spark.range(3).repartition(2)
    return {
        "git": tried(git),
        "repository": repository_root(root) is not None,
        "shared_folder": tried(lambda: shared_dir(spark)),
        "executors_share_it": tried(lambda: staged(rows, "probe").count() == 3),
        "arrow_workers": tried(lambda: rows.mapInPandas(lambda batches: batches, "id long").count() == 3),
        "embedding_provider": client is not None,
    }


def markdown(rows: DataFrame, title: str, most: int = 1000) -> bytes:
    """A report of a small result as a Markdown table, in the rows' order; more than ``most`` rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(map(cell, rows.columns)) + " |", "|" + "-|" * len(rows.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in found]
    return ("\n".join(lines) + "\n").encode()

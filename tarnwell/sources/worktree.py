"""Files of a git worktree: enumeration, exclusion, bounded reads."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import stat
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are never source.
BUILT_IN = ("node_modules", "vendor", "dist", "build", ".git", "testdata")
LANGUAGES = {".go": "go", ".ts": "ts", ".tsx": "tsx"}
MAX_BYTES = 1 << 20


@dataclass(frozen=True)
class Candidate:
    path: str
    excluded: str | None = None


def read_patterns(path: str) -> list[str]:
    """Patterns of an ignore file: one a line, ``#`` comments; none if it is missing."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip() and not line.lstrip().startswith("#")]


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether a pattern is a directory prefix of the path or a glob of it or of its name."""
    for p in patterns:
        p = p.lstrip("/")
        if p.endswith("/") and (path.startswith(p) or f"/{p}" in f"/{path}"):
            return True
        if fnmatch.fnmatch(path, p) or fnmatch.fnmatch(os.path.basename(path), p):
            return True
    return False


def listed(root: str) -> list[str]:
    """Tracked and untracked, not ignored paths; a plain walk where there is no repository."""
    try:
        raw = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
        return [p.decode("utf-8", "surrogateescape") for p in raw.split(b"\0") if p]
    except (subprocess.CalledProcessError, FileNotFoundError):
        return [os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names]


def enumerate_files(root: str, max_bytes: int = MAX_BYTES, ignore_file: str = ".searchignore") -> list[Candidate]:
    """Candidates in path order, each once, excluded ones with the reason."""
    patterns, out = read_patterns(os.path.join(root, ignore_file)), []
    for path in sorted({os.path.normpath(p).replace(os.sep, "/") for p in listed(root)}):
        why = None
        full = os.path.join(root, path)
        if path.startswith("../") or any(part in BUILT_IN for part in path.split("/")[:-1]):
            why = "built_in"
        elif ignored(path, patterns):
            why = "ignore_file"
        else:
            try:
                info = os.lstat(full)
                why = "symlink" if stat.S_ISLNK(info.st_mode) else "non_regular" if not stat.S_ISREG(info.st_mode) else "oversize" if info.st_size > max_bytes else None
            except FileNotFoundError:
                why = "missing"
        out.append(Candidate(path, why))
    return out


def read_bounded(root: str, path: str, max_bytes: int = MAX_BYTES) -> bytes:
    """A regular file inside the root, no link on its way, no larger than the cap, unchanged while read."""
    full = os.path.join(root, path)
    if os.path.realpath(full) != os.path.join(os.path.realpath(root), os.path.normpath(path)):
        raise ValueError(f"{path}: not a plain path inside the root")
    with open(full, "rb") as f:
        before = os.fstat(f.fileno())
        if not stat.S_ISREG(before.st_mode) or before.st_size > max_bytes:
            raise ValueError(f"{path}: not a regular file of at most {max_bytes} bytes")
        data = f.read(max_bytes + 1)
        after = os.lstat(full)
    if len(data) > max_bytes or (before.st_ino, before.st_size) != (after.st_ino, after.st_size):
        raise ValueError(f"{path}: changed while read")
    return data


def files_frame(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, sha, size, body) of the source files below a root that executors can read.

    Bodies are read by Spark's binary reader with its length filter pushed to the
    listing; only the list of admitted paths comes from the driver.
    """
    keep = [c.path for c in enumerate_files(root, max_bytes) if not c.excluded and os.path.splitext(c.path)[1] in LANGUAGES]
    base = os.path.realpath(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{base}").where(F.col("length") <= max_bytes)
    path = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(base) + 2})")
    rows = raw.select(path.alias("path"), "content").join(spark.createDataFrame([(p,) for p in keep], "path string"), "path", "left_semi")
    language = F.regexp_extract("path", r"\.(go|tsx|ts)$", 1)
    return rows.select("path", language.alias("language"), F.sha2("content", 256).alias("sha"), F.length("content").alias("size"), F.decode("content", "UTF-8").alias("body"))


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

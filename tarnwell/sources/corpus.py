"""Corpus manifests, their bindings to checkouts, and the proof that a checkout is what a manifest says."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.text import glob_to_regex
from tarnwell.operators.store import manifest_tree
from tarnwell.sources.config import strict_json

LANGUAGES = ("go", "typescript", "tsx", "mixed")
_EXTENSIONS = {"go": ".go", "typescript": ".ts", "tsx": ".tsx"}


class CorpusError(ValueError):
    """A manifest, a binding or a checkout that is not what it should be."""


@dataclass(frozen=True)
class Manifest:
    schema_version: int
    corpus_id: str
    upstream_url: str
    pinned_commit: str
    license_spdx: str
    license_evidence: str
    language_slices: tuple[str, ...]
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    expected_content_hash: str
    expected_tree_hash: str
    clean_tree_required: bool
    root_subdir: str = ""
    redistribution_notice: str = ""
    typescript_config: str = ""


def _inside(path: str) -> bool:
    return not os.path.isabs(path) and "\\" not in path and (not path or os.path.normpath(path) == path and not path.startswith(".."))


def load_manifest(text: str) -> Manifest:
    """A manifest of strict JSON: no field unknown, twice or missing, every value well formed."""
    value = strict_json(text)
    if not isinstance(value, dict):
        raise CorpusError("an object is expected")
    known = {f.name for f in fields(Manifest)}
    needed = {f.name for f in fields(Manifest) if f.default is f.default_factory}
    if set(value) - known or needed - set(value):
        raise CorpusError(f"unknown fields {sorted(set(value) - known)}, missing fields {sorted(needed - set(value))}")
    for name in ("language_slices", "include", "exclude"):
        if not isinstance(value[name], list) or not all(isinstance(x, str) and x for x in value[name]) or len(set(value[name])) != len(value[name]) or len(value[name]) > 256:
            raise CorpusError(f"{name} must be a list of different names")
        value[name] = tuple(value[name])
    m = Manifest(**value)
    checks = {
        "schema_version": m.schema_version == 1 and m.schema_version is not True,
        "corpus_id": re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,127}", str(m.corpus_id)),
        "upstream_url": re.fullmatch(r"https://[^\s?#]+|git@[^\s:]+:[^\s]+", str(m.upstream_url)),
        "pinned_commit": re.fullmatch(r"[0-9a-f]{40}", str(m.pinned_commit)),
        "license_spdx": re.fullmatch(r"[A-Za-z0-9.+-]{1,64}", str(m.license_spdx)),
        "license_evidence": m.license_evidence and _inside(m.license_evidence),
        "root_subdir": _inside(m.root_subdir),
        "typescript_config": _inside(m.typescript_config) and (not m.typescript_config or {"typescript", "tsx", "mixed"} & set(m.language_slices)),
        "language_slices": m.language_slices and set(m.language_slices) <= set(LANGUAGES),
        "include": m.include,
        "expected_content_hash": re.fullmatch(r"[0-9a-f]{64}", str(m.expected_content_hash)),
        "expected_tree_hash": re.fullmatch(r"[0-9a-f]{40}", str(m.expected_tree_hash)),
        "clean_tree_required": isinstance(m.clean_tree_required, bool),
    }
    if wrong := [name for name, fine in checks.items() if not fine]:
        raise CorpusError(f"invalid: {wrong}")
    return m


def load_bindings(text: str) -> dict[str, str]:
    """Checkout folders by corpus id, absolute paths each."""
    value = strict_json(text)
    if not isinstance(value, dict) or set(value) != {"schema_version", "bindings"} or value["schema_version"] != 1 or not isinstance(value["bindings"], dict):
        raise CorpusError("bindings need schema_version 1 and an object of folders")
    if bad := [k for k, v in value["bindings"].items() if not isinstance(v, str) or not os.path.isabs(v)]:
        raise CorpusError(f"not an absolute folder: {bad}")
    return value["bindings"]


def resolve_checkout(manifest: Manifest, bindings: dict[str, str], given: str | None = None) -> str:
    """The checkout that is given, else the bound one, links followed; an error if it is no folder."""
    where = given or bindings.get(manifest.corpus_id)
    if not where:
        raise CorpusError(f"{manifest.corpus_id} has no checkout")
    where = os.path.realpath(where)
    if not os.path.isdir(where):
        raise CorpusError("the checkout is not a folder")
    return where


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, text=True).stdout
    except (subprocess.CalledProcessError, FileNotFoundError) as e:
        raise CorpusError(f"git {args[0]} failed") from e


def _remote(url: str) -> str:
    """A remote's host and path, whatever scheme it is written with."""
    url = re.sub(r"^(?:https://|ssh://)?(?:[^@/]*@)?", "", url.strip())
    return re.sub(r"\.git/?$|/$", "", url.replace(":", "/", 1))


def selected(spark: SparkSession, root: str, manifest: Manifest) -> DataFrame:
    """(path, sha) of the tracked files that a manifest selects, read and hashed by the executors.

    Only the list of paths comes from the driver. A link, or a file that is missing, is an error.
    """
    tracked = [p for p in _git(root, "ls-files", "-z", "--cached").split("\0") if p]
    prefix = f"{manifest.root_subdir}/" if manifest.root_subdir else ""
    include, exclude = ([re.compile(glob_to_regex(p)) for p in ps] for ps in (manifest.include, manifest.exclude))
    inner = [(p, p[len(prefix) :]) for p in tracked if p.startswith(prefix)]
    keep = [p for p, own in inner if any(r.search(own) for r in include) and not any(r.search(own) for r in exclude)]
    if bad := [p for p in keep if not _inside(p) or os.path.islink(os.path.join(root, p)) or os.path.realpath(os.path.join(root, p)) != os.path.join(root, p)]:
        raise CorpusError(f"not plain files: {bad[:3]}")
    if not keep:
        raise CorpusError("the manifest selects no file")
    for language in set(manifest.language_slices) - {"mixed"}:
        if not any(p.endswith(_EXTENSIONS[language]) for p in keep):
            raise CorpusError(f"no {language} file is selected")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}")
    path = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root) + 2})")
    rows = raw.select(path.alias("path"), F.sha2("content", 256).alias("sha"))
    return rows.join(spark.createDataFrame([(p,) for p in keep], "path string"), "path", "left_semi")


def content_hash(files: DataFrame) -> str:
    return manifest_tree(files).first()["manifest"]


def verify_checkout(spark: SparkSession, manifest: Manifest, root: str) -> dict:
    """Prove that a checkout is the manifest's: origin, commit, clean tree, licence, tree and selected content.

    Nothing is fetched or changed. Returns the corpus, commit, content hash and whether
    the tree is clean; raises CorpusError at the first thing that differs.
    """
    root = os.path.realpath(root)
    if os.path.realpath(_git(root, "rev-parse", "--show-toplevel").strip()) != root:
        raise CorpusError("the checkout is not its worktree's root")
    if _remote(_git(root, "remote", "get-url", "origin")) != _remote(manifest.upstream_url):
        raise CorpusError("origin differs")
    if _git(root, "rev-parse", "HEAD").strip() != manifest.pinned_commit:
        raise CorpusError("commit differs")
    clean = not _git(root, "status", "--porcelain=v1", "--untracked-files=all").strip()
    if manifest.clean_tree_required and not clean:
        raise CorpusError("the tree is dirty")
    evidence = os.path.join(root, manifest.license_evidence)
    if os.path.islink(evidence) or not os.path.isfile(evidence) or not os.path.getsize(evidence):
        raise CorpusError("the licence is missing")
    if _git(root, "rev-parse", "HEAD^{tree}").strip() != manifest.expected_tree_hash:
        raise CorpusError("tree differs")
    files = selected(spark, root, manifest)
    digest = content_hash(files)
    if digest != manifest.expected_content_hash:
        raise CorpusError("selected content differs")
    return {"corpus_id": manifest.corpus_id, "pinned_commit": manifest.pinned_commit, "content_sha256": digest, "clean": clean}


def verify_indexed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, problem) where an index (path, sha) and the selected content (path, sha) do not agree."""
    i = indexed.select("path", F.col("sha").alias("indexed"))
    both = files.join(i, "path", "full")
    problem = F.when(F.col("indexed").isNull(), "not indexed").when(F.col("sha").isNull(), "outside the selection").when(F.col("sha") != F.col("indexed"), "differs")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")

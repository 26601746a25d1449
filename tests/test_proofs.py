"""Corpus manifests and checkouts, review stages and promotion: each refuses what is not proven."""

import glob
import json
import os
import shutil
import subprocess
from dataclasses import replace

import pytest

from tarnwell.sources import corpus as C
from tarnwell.sources import promotion as P
from tarnwell.sources import review as R


def git(root, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


@pytest.fixture()
def checkout(tmp_path):
    root = tmp_path / "c"
    for name, text in (("LICENSE", "free"), ("src/a.go", "package a\n"), ("src/b.ts", "export {};\n"), ("src/gen/x.go", "package g\n"), ("docs/n.md", "n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    git(root, "add", ".")
    git(root, "commit", "-qm", "one")
    git(root, "remote", "add", "origin", "git@host.example:team/thing.git")
    return root


def manifest_of(spark, root):
    value = {
        "schema_version": 1, "corpus_id": "thing", "upstream_url": "https://host.example/team/thing", "pinned_commit": git(root, "rev-parse", "HEAD"), "license_spdx": "MIT", "license_evidence": "LICENSE",
        "language_slices": ["go", "typescript"], "include": ["**/*.go", "**/*.ts"], "exclude": ["gen/**"], "root_subdir": "src", "expected_content_hash": "0" * 64, "expected_tree_hash": git(root, "rev-parse", "HEAD^{tree}"), "clean_tree_required": True,
    }
    m = C.load_manifest(json.dumps(value))
    return value, replace(m, expected_content_hash=C.content_hash(C.selected(spark, os.path.realpath(root), m)))


def test_checkout_is_proven(spark, checkout, tmp_path):
    value, m = manifest_of(spark, checkout)
    assert sorted(r.path for r in C.selected(spark, os.path.realpath(checkout), m).collect()) == ["src/a.go", "src/b.ts"]
    found = C.verify_checkout(spark, m, str(checkout))
    assert (found["corpus_id"], found["clean"], found["content_sha256"]) == ("thing", True, m.expected_content_hash)
    files = C.selected(spark, os.path.realpath(checkout), m)
    indexed = spark.createDataFrame([("src/a.go", "0"), ("src/gen/x.go", "1")], "path string, sha string")
    assert {(r.path, r.problem) for r in C.verify_indexed(files, indexed).collect()} == {("src/a.go", "differs"), ("src/b.ts", "not indexed"), ("src/gen/x.go", "outside the selection")}
    fails = lambda other, what: pytest.raises(C.CorpusError, match=what)
    for change, what in (({"upstream_url": "https://host.example/team/other"}, "origin"), ({"pinned_commit": "0" * 40}, "commit"), ({"license_evidence": "COPYING"}, "licence"), ({"expected_tree_hash": "0" * 40}, "tree differs"), ({"expected_content_hash": "0" * 64}, "content")):
        with fails(change, what):
            C.verify_checkout(spark, replace(m, **change), str(checkout))
    (checkout / "src" / "new.go").write_text("package a\n")
    with pytest.raises(C.CorpusError, match="dirty"):
        C.verify_checkout(spark, m, str(checkout))
    loose = replace(m, clean_tree_required=False)
    assert C.verify_checkout(spark, loose, str(checkout))["clean"] is False  # untracked files are not selected
    (checkout / "src" / "a.go").write_text("package b\n")
    with pytest.raises(C.CorpusError, match="content"):
        C.verify_checkout(spark, loose, str(checkout))
    with pytest.raises(C.CorpusError, match="root"):
        C.verify_checkout(spark, m, str(checkout / "src"))
    for name, bad in (("pinned_commit", "abc"), ("include", []), ("license_evidence", "../x"), ("language_slices", ["c"]), ("corpus_id", "A B"), ("clean_tree_required", 1), ("extra", 1)):
        with pytest.raises(C.CorpusError):
            C.load_manifest(json.dumps(value | {name: bad}))
    bindings = C.load_bindings(json.dumps({"schema_version": 1, "bindings": {"thing": str(checkout)}}))
    assert C.resolve_checkout(m, bindings) == os.path.realpath(checkout) == C.resolve_checkout(m, {}, str(checkout))
    for bad in ({"schema_version": 1, "bindings": {"thing": "rel"}}, {"schema_version": 2, "bindings": {}}):
        with pytest.raises(C.CorpusError):
            C.load_bindings(json.dumps(bad))
    with pytest.raises(C.CorpusError, match="no checkout"):
        C.resolve_checkout(m, {})


def test_review_stages_prove_each_other(spark, tmp_path):
    ddl = "qid long, item long, grade int, grp string"
    packets = spark.createDataFrame([(q, i, f"h{i}") for q in (1, 2) for i in range(4)], "qid long, item long, body_sha string")
    cells = spark.createDataFrame([(c, q, i) for c in ("B1", "C1") for q in (1, 2) for i in range(2 if c == "B1" else 4)], "cell string, qid long, item long")
    one = spark.createDataFrame([(q, i, i % 3, "g") for q in (1, 2) for i in range(4)], ddl)
    two = spark.createDataFrame([(q, i, 2 if (q, i) == (1, 0) else i % 3, "g") for q in (1, 2) for i in range(4)], ddl)
    prepared, frozen, out = (str(tmp_path / n) for n in ("prepared", "frozen", "out"))
    R.prepare(packets, cells, prepared)
    adopted = R.to_adopt(spark, prepared, one, two)
    with pytest.raises(R.Refused, match="not adopted"):
        R.freeze(spark, prepared, one, one, adopted, frozen)
    with pytest.raises(R.Refused, match="grade every packet"):
        R.freeze(spark, prepared, one.where("item > 0"), two, adopted, frozen)
    R.freeze(spark, prepared, one, two, adopted, frozen)
    R.select(spark, prepared, frozen, out)
    _, tables = R.open_stage(spark, out, "selected")
    assert {tuple(r) for r in tables["by_cell"].select("cell", "queries", "sent", "useful", "support", "noise", "unresolved").collect()} == {("B1", 2, 4, 0, 2, 1, 1), ("C1", 2, 8, 2, 2, 3, 1)}
    with pytest.raises(FileExistsError):
        R.select(spark, prepared, frozen, out)
    with pytest.raises(R.Refused):
        R.open_stage(spark, frozen, "selected")
    # A change of any table, or of the state, in any stage is refused.
    for stage, name in ((prepared, "packets"), (prepared, "cells"), (frozen, "labels"), (frozen, "pass_two"), (prepared, "stage.json"), (frozen, "stage.json")):
        copy = {s: str(tmp_path / f"copy-{os.path.basename(s)}") for s in (prepared, frozen)}
        for s, c in copy.items():
            shutil.rmtree(c, ignore_errors=True)
            shutil.copytree(s, c)
        where = os.path.join(copy[stage], name)
        if name == "stage.json":
            os.remove(os.path.join(copy[stage], ".stage.json.crc")) if os.path.exists(os.path.join(copy[stage], ".stage.json.crc")) else None
            text = open(where).read()
            open(where, "w").write(text.replace('"kind":"', '"Kind":"x","kind":"'))
        else:
            rows = spark.read.parquet(where).collect()
            frame = spark.createDataFrame([*rows[1:], rows[1]], spark.read.parquet(where).schema)
            shutil.rmtree(where)
            frame.write.parquet(where)
        with pytest.raises(R.Refused):
            R.select(spark, copy[prepared], copy[frozen], str(tmp_path / f"none-{os.path.basename(stage)}-{name}"))
    other = str(tmp_path / "other")
    R.prepare(packets, cells.where("cell = 'B1'"), other)
    with pytest.raises(R.Refused, match="follow"):
        R.select(spark, other, frozen, str(tmp_path / "none"))


def test_promotion_needs_fresh_evidence(spark, tmp_path):
    ranks = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, None)], "qid long, rank int, score double")
    none, some = ranks.where("rank > 9"), ranks.where("rank = 2")
    frozen = {"ranks": P.rows_digest(ranks)}
    assert P.rows_digest(ranks.repartition(3)) == frozen["ranks"] != P.rows_digest(ranks.unionAll(some))
    contract = {"gates": ["sorted", "unique"], "evidence": frozen}
    folder = str(tmp_path / "p")
    result = P.promote(contract, {"sorted": none, "unique": none}, {"ranks": ranks}, folder)
    assert result["status"] == P.READY and P.check_promotion(folder, {"sorted": none, "unique": none}, {"ranks": ranks})["passed"] == ["sorted", "unique"]
    bad = P.promote(contract, {"sorted": some, "unique": none}, {"ranks": ranks}, str(tmp_path / "q"))
    assert (bad["status"], bad["failed"]) == (P.REJECTED, ["sorted"])
    with pytest.raises(ValueError, match="gates"):
        P.promote(contract, {"sorted": none}, {"ranks": ranks}, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="froze"):
        P.promote(contract, {"sorted": none, "unique": none}, {"ranks": ranks.where("qid = 1")}, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="changed"):
        P.check_promotion(folder, {"sorted": none, "unique": none}, {"ranks": some})
    with pytest.raises(ValueError, match="another result"):
        P.check_promotion(folder, {"sorted": some, "unique": none}, {"ranks": ranks})
    name = glob.glob(f"{folder}/result.json")[0]
    open(name, "a").write(" ")
    with pytest.raises(ValueError, match="checksum"):
        P.check_promotion(folder, {"sorted": none, "unique": none}, {"ranks": ranks})


def test_runtime_says_what_it_is(spark, tmp_path):
    from tarnwell.sources import runtime
    from tarnwell.sources.generations import verify_artifact, write_artifact

    info = runtime.build_info()
    assert len(info["source_sha256"]) == 64 and info == runtime.build_info()
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "a" / ".git").mkdir()
    assert runtime.repository_root(str(deep)) == os.path.realpath(tmp_path / "a") and runtime.repository_root("/") is None
    found = runtime.capabilities(spark, str(deep))
    assert found["git"] and found["repository"] and found["executors_share_it"] and found["arrow_workers"] and not found["embedding_provider"]
    rows = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "n int, what string")
    report = runtime.markdown(rows.orderBy("n"), "Gates")
    assert report.decode() == "# Gates\n\n| n | what |\n|-|-|\n| 1 | a\\|b c |\n| 2 |  |\n"
    write_artifact(str(tmp_path / "r"), {"report.md": report})
    verify_artifact(str(tmp_path / "r"))
    with pytest.raises(ValueError):
        runtime.markdown(spark.range(5), "x", most=3)

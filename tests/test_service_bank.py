"""Bank, failures, delta generations and segments behind the service, with a client that counts its calls."""

import json
import os
import subprocess
from dataclasses import replace

import pytest

from tarnwell.service import Index
from tarnwell.sources import embedding as E
from tarnwell.sources import generations as G
from tarnwell.sources.config import Config


class Log:
    """A client's calls, which it makes in workers, by way of a file."""

    def __init__(self, path):
        self.path, self.bad = str(path), None

    def client(self, size):
        path, bad = self.path, self.bad

        class Counted(E.HashClient):
            def embed(self, texts):
                with open(path, "a", encoding="utf-8") as f:
                    f.writelines(json.dumps(t) + "\n" for t in texts)
                if bad and any(bad in t for t in texts):
                    raise ValueError("refused")
                return super().embed(texts)

        return Counted(size)

    def taken(self):
        """The texts since the last time."""
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            found = [json.loads(line) for line in f]
        os.remove(self.path)
        return found


@pytest.fixture()
def log(tmp_path):
    return Log(tmp_path / "calls")


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    for k in range(12):
        lines = "\n".join(f"\ttotal += step{k}({j})" for j in range(40 if k == 0 else 2))
        (root / f"f{k}.go").write_text(f"package p\n\nfunc F{k}(n int) int {{\n\ttotal := n\n{lines}\n\treturn total\n}}\n")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    return root


PAID = replace(Config(), allow_paid_query_embedding=True, dimensions=512, segment_target_bytes=256, retry_seconds=(), request_inputs=1)


def test_a_change_of_dimensions_or_codec_makes_no_call(spark, tree, tmp_path, log):
    folder = str(tmp_path / "index")
    index = Index(spark, str(tree), folder, PAID, log.client(1024))
    index.reindex()
    segments = index.store.read("segments")
    assert segments.where("number > 0").count() > 2 and segments.select("chunk_id").distinct().count() == 12
    done = index.embed_documents()
    asked = log.taken()
    assert done["requested"] == segments.select("hash").distinct().count() == len(asked)
    assert all(t.startswith("path: ") and "func F" in t for t in asked)
    for change in ({"dimensions": 1024}, {"vector_codec": "float32"}, {"dimensions": 1024, "vector_codec": "float32"}):
        other = Index(spark, str(tree), folder, replace(PAID, **change), log.client(1024))
        assert other.search("step", mode="hybrid")["fallback"] == "PROFILE_RECONCILIATION_REQUIRED"
        assert other.embed_documents()["requested"] == 0 and not log.taken()
        assert other.evaluation_session()["generation"] == other.rematerialize() - 1
        assert other.search("step3", mode="hybrid")["fallback"] is None and log.taken() == ["step3"]
    # Another source's vectors are none of this one's.
    other = Index(spark, str(tree), folder, replace(PAID, embedding_model="other"), log.client(1024))
    with pytest.raises(ValueError, match="the bank has 0 of"):
        other.rematerialize()
    assert other.embed_documents()["requested"] == done["requested"]


def test_vector_lane_takes_the_best_segment(spark, tree, tmp_path, log):
    index = Index(spark, str(tree), str(tmp_path / "index"), PAID, log.client(512))
    index.reindex()
    index.embed_documents()
    at = index.store.active()
    lane, why = index._vector_lane("anything", at)
    assert why is None
    plan = lane._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "source_body" not in plan  # no body is read
    got = [(r.chunk_id, r.rank, r.score) for r in lane.orderBy("rank").collect()]
    assert len({c for c, _, _ in got}) == 12 and [r for _, r, _ in got] == list(range(1, 13))
    assert [x for _, _, x in got] == sorted((x for _, _, x in got), reverse=True)


def test_terminal_failures_are_not_asked_again(spark, tree, tmp_path, log):
    log.bad = "func F3"
    index = Index(spark, str(tree), str(tmp_path / "index"), PAID, log.client(512))
    index.reindex()
    done = index.embed_documents()
    assert done["failed"] == 1
    assert [(r.classification, r.last_error) for r in index.store.read("embedding_failures").collect()] == [("terminal", "ValueError: refused")]
    log.taken()
    assert index.embed_documents()["requested"] == 0 and not log.taken()
    with pytest.raises(ValueError, match="the bank has"):
        index.rematerialize()
    log.bad = None
    index.client = log.client(512)
    assert index.embed_documents(retry_terminal=True)["requested"] == 1 and len(log.taken()) == 1
    assert index.rematerialize() > done["generation"]


def test_one_changed_file_writes_its_own_rows(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "MOST_PARTS", 4)
    folder = str(tmp_path / "index")
    index = Index(spark, str(tree), folder, PAID)
    index.reindex()
    for turn in range(4):  # past the number of parts at which a table is written anew
        (tree / "f5.go").write_text(f"package p\n\nfunc F5(n int) int {{\n\treturn turn{turn}(n)\n}}\n")
        if turn == 2:
            (tree / "f6.go").unlink()
        plan = index.reindex()
        assert (plan.changed, plan.deleted) == (1, int(turn == 2))
        at = index.store.active()
        parts = at["tables"]["chunks"]
        if len(parts) > 1:
            new = spark.read.parquet(parts[-1]["data"])
            assert new.count() == 1 and spark.read.parquet(at["tables"]["postings"][-1]["data"]).select("chunk_id").distinct().count() == 1
        chunks = index.store.read("chunks", at)
        assert chunks.count() == chunks.select("id").distinct().count() == (12 if turn < 2 else 11)
        assert index.search(f"turn{turn}")["hits"][0]["qualified"] == "p.F5"
    assert len(index.store.active()["tables"]["chunks"]) < 4
    stored = index.store.read("postings")
    from tarnwell.operators import lexical

    again = lexical.postings(index._tokens(index.store.read("chunks"))).select(*stored.columns)
    assert stored.exceptAll(again).isEmpty() and again.exceptAll(stored).isEmpty()
    kept = index.store.read("files").count()
    assert index.store.collect() > 0 and index.store.read("files").count() == kept == 11
    assert index.store.collect() == 0

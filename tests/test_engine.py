import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import text as X
from tarnwell.operators import chunking, graph, packing, scan_go, scan_ts, store
from tarnwell.operators.query import QueryError, effective_shape, normalize, plan_query
from tarnwell.sources import config as C
from tarnwell.sources import embedding as E
from tarnwell.sources import generations as G
from tarnwell.sources import worktree as W

NAMES = [("GetUserByID", "get user by id"), ("camelCase42", "camel case42"), ("snake_case", "snake case"), ("pkg/path-value", "pkg path value"), ("ÜberHTTPServer", "über http server"), ("", "")]


def test_normalize(spark):
    df = spark.createDataFrame(NAMES, "x string, y string").withColumn("z", X.normalize_identifier(F.col("x")))
    assert all(r.y == r.z == normalize(r.x) for r in df.collect())


def test_text_functions(spark):
    row = spark.range(1).select(
        X.byte_slice(F.lit("aé\nb"), F.lit(1), F.lit(3)).alias("s"), X.line_of_byte(F.lit("aé\nb"), F.lit(4)).alias("l"), X.escape_like(F.lit("a_b%c!")).alias("e"),
        F.lit("src/a/b/x_test.go").rlike(X.glob_to_regex("src/**/*_test.go")).alias("g"), F.lit("src/x.go").rlike(X.glob_to_regex("src/*/x.go")).alias("n"),
    ).first()
    assert (row.s, row.l, row.e, row.g, row.n) == ("é", 2, "a!_b!%c!!", True, False)


def test_query_planner():
    q = plan_query("GetUserByID")
    assert (q.shape, q.terms, [a.normalized for a in q.symbols], q.exact_symbol) == ("anchor", ["get", "user", "by", "id"], ["get user by id"], "get user by id")
    assert plan_query("how does routing choose a fallback").shape == "descriptive"
    assert plan_query("chain").shape == "anchor"
    q = plan_query("Router interface")
    assert q.shape == "descriptive" and [a.high for a in q.symbols] == [False] and effective_shape(q, 1, 0) == "mixed"
    assert plan_query("see internal/app/x.go please").paths[0].raw == "internal/app/x.go"
    for text, code in (("", "empty_query"), ("!? --", "empty_query"), ("x" * 9000, "invalid_query"), ("\ud800", "invalid_query"), ("a " * 65, "invalid_query"), ("b" * 129, "invalid_query")):
        with pytest.raises(QueryError) as e:
            plan_query(text)
        assert e.value.code == code


GO = '''package geo

import "fmt"

const Limit = 3

// Sum adds.
// It is short.
func Sum(a, b int) int {
	return a + b // }
}

type Receiver struct{ v map[string]interface{} }

func (r *Receiver) Scale(f func(int) int) (interface{}, error) {
	s := "}" + `{` + fmt.Sprint(Sum(1, 2))
	return s, nil
}

type (
	// API is one.
	API interface {
		Do()
	}
	Alias = Receiver
)

func Map[T any](xs []T) []T { return xs }
'''


def test_go_chunks():
    got = [(c["kind"], c["qualified"], c["start_line"], c["end_line"]) for c in scan_go.scan("geo.go", GO)]
    assert got == [("function", "geo.Sum", 7, 11), ("type", "geo.Receiver", 13, 13), ("method", "geo.Receiver.Scale", 15, 18), ("type", "geo.API", 21, 24), ("type", "geo.Alias", 25, 25), ("function", "geo.Map", 28, 28)]
    one = scan_go.scan("geo.go", GO)[0]
    assert one["signature"] == "func Sum(a, b int) int" and one["body"].startswith("// Sum adds.") and one["body"].endswith("}")
    assert GO.encode()[one["start_byte"] : one["end_byte"]].decode() == one["body"]
    assert [n for n, _ in scan_go.calls(scan_go.scan("geo.go", GO)[2]["body"]) if n == "Sum"] == ["Sum"]


TS = """import { x } from "y";

/** Adds. */
export function add(a: number): number;
export function add(a: number, b?: number): number {
  return a + (b ?? 0);
}

export const twice = (n: number): number => n * 2;
const limit = 3;

export abstract class Shape<T> extends Base {
  private size = 1;
  handler = async (e: Event) => { this.run(e); };
  constructor(readonly name: string) { super(); }
  get area(): number { return 1; }
  abstract draw(ctx: { w: number }): void;
  static of<T>(v: T): Shape<T> { if (v) { return null!; } return null!; }
}

interface Props { a: string; b(): void }
type Fn = (a: string) => { x: number };
enum Color { Red, Green }

namespace Outer.Inner {
  export function deep() { return /[/{]/.test("x"); }
}

export default function () { return `}${1}`; }
"""


def test_ts_chunks():
    got = [(c["kind"], c["qualified"]) for c in scan_ts.scan("lib/tool.ts", TS)]
    assert got == [
        ("function", "add"), ("function", "twice"), ("class", "Shape"), ("method", "Shape.handler"), ("method", "Shape.constructor"), ("method", "Shape.area"), ("method", "Shape.draw"), ("method", "Shape.of"),
        ("interface", "Props"), ("type", "Fn"), ("enum", "Color"), ("function", "Outer.Inner.deep"), ("function", "tool.default"),
    ]
    add = scan_ts.scan("lib/tool.ts", TS)[0]
    assert add["body"].startswith("/** Adds. */") and add["body"].endswith("}") and add["start_line"] == 3 and add["end_line"] == 7


def test_segments_cover_the_body(spark):
    body = "é" * 30 + "\nshort\n" + "x" * 200 + "\n\nend"
    rows = chunking.segments(spark.createDataFrame([(1, body), (2, "")], "chunk_id long, body string"), 64).orderBy("chunk_id", "number").collect()
    parts = [body.encode()[r.start_byte : r.end_byte].decode() for r in rows if r.chunk_id == 1]
    assert "".join(parts) == body and len(parts) == 4 and [r.end_byte for r in rows if r.chunk_id == 2] == [0]


def test_packers(spark):
    rows = spark.createDataFrame([(1, 1, 10, 50, None), (1, 2, 11, 80, 20), (1, 3, 12, 30, None), (1, 4, 13, 90, 40)], "qid long, rank long, id long, parent_bytes long, segment_bytes long")
    got = [(r.id, r.outcome, r.used_bytes) for r in packing.pack_bodies(rows, 100).orderBy("rank").collect()]
    assert got == [(10, "parent", 50), (11, "segment", 20), (12, "parent", 30), (13, "budget", 0)]
    assert E.request_groups([5, 5, 5, 20, 1], 2, 12) == [[0, 1], [2], [3], [4]]


def test_bridges_displace_and_abstain(spark):
    rows = [(1, "a", 10, 1, False), (1, "a", 11, 2, False), (1, "a", 99, 9, True), (1, "b", 99, 9, True), (1, "b", 12, 1, False), (1, "b", 13, 2, False), (2, "a", 1, 1, True), (2, "a", 2, 1, True), (2, "a", 3, 1, True)]
    got = graph.reserve_bridges(spark.createDataFrame(rows, "qid long, bucket string, id long, rank long, bridge boolean")).collect()
    assert {(r.bucket, r.id) for r in got if r.qid == 1} == {("a", 10), ("a", 11), ("b", 12), ("b", 99)}
    assert {r.abstained for r in got if r.qid == 1} == {False} and {r.abstained for r in got if r.qid == 2} == {True}


def test_state(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, sha string")
    assert {(r.path, r.status) for r in store.change_plan(new, old).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "added")}
    fresh, conflicts = store.insert_or_ignore(old, new, "path", "sha")
    assert [tuple(r) for r in fresh.collect()] == [("c", "4")] and [r.path for r in conflicts.collect()] == ["b"]
    assert {tuple(r) for r in store.upsert(old, new, ["path"]).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    with pytest.raises(ValueError):
        store.require_empty(conflicts, "conflicts")
    assert store.manifest_tree(old).first()["n"] == 2


def test_generations(spark, tmp_path):
    s = G.GenerationStore(spark, str(tmp_path / "g"))
    rows = lambda *p: spark.createDataFrame([(i, x, "go", "h", 0, 1) for i, x in enumerate(p)], s.read("files").schema)
    s.publish(0, {"files": rows("a")})
    pinned = s.active()
    s.publish(1, {"files": rows("a", "b")})
    assert s.read("files", pinned).count() == 1 and s.read("files").count() == 2
    with pytest.raises(G.Conflict):
        s.publish(1, {"files": rows("c")})
    with pytest.raises(Exception):
        s.publish(2, {"files": rows("x").withColumn("id", F.raise_error(F.lit("no")).cast("long"))})
    assert s.active()["generation"] == 2


def test_artifacts(tmp_path):
    where = str(tmp_path / "a")
    G.write_artifact(where, {"x.json": b"{}", "y.md": b"#"})
    G.verify_artifact(where)
    with pytest.raises(FileExistsError):
        G.write_artifact(where, {})
    (tmp_path / "a" / "x.json").write_bytes(b"[]")
    with pytest.raises(ValueError):
        G.verify_artifact(where)


def test_config():
    base = C.resolve("{}")
    for bad in ('{"a": 1}', '{"return_k": 0}', '{"return_k": null}', '{"return_k": 5, "return_k": 6}', '{"dimensions": 256}', "[]", "{} x", '{"retry_seconds": [3, 1]}', '{"workers": NaN}', '{"languages": ["\\ud800"]}'):
        with pytest.raises(C.ConfigError):
            C.resolve(bad)
    assert C.canonical_json({"b": 1.0, "a": [True, None, "é"], "\U0001f600": 1, "ﬀ": 2}) == '{"a":[true,null,"é"],"b":1,"😀":1,"ﬀ":2}'
    assert [C.impact(base, C.resolve(x)) for x in ("{}", '{"rrf_k": 61}', '{"dimensions": 512}', '{"segment_target_bytes": 2048}', '{"languages": ["go"]}')] == ["none", "policy", "space", "canonical", "index"]


def test_embedding(spark):
    class Flaky(E.HashClient):
        tries = 0

        def embed(self, texts):
            if "bad" in texts:
                raise E.Retryable("no", 1)
            return super().embed(texts)[::-1]

    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "bad")], "hash string, text string").coalesce(1)
    got = {r.hash: r for r in E.embed(rows, lambda: Flaky(8), 8, most=2, waits=()).collect()}
    assert got["1"].vector == pytest.approx(E.HashClient(8).embed(["a"])[0][1]) and got["3"].vector is None and got["3"].error.startswith("Retryable")
    waits = []
    with pytest.raises(E.Retryable):
        E.call(Flaky(8), ["bad"], 8, (10, 20), waits.append)
    assert waits == [10, 20]
    for answer in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [float("nan")])], [(0, [1.0]), (1, [0.0])]):
        with pytest.raises(ValueError):
            E.checked(answer, 2, 1)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "w"
    for name, body in (("geo/geo.go", GO), ("lib/tool.ts", TS), ("special_location.go", "package main\n\nfunc Place() {}\n"), ("vendor/v.go", "package v\n"), ("notes.txt", "x"), ("skip/a.go", "package a\n"), ("big.go", "package b\n" + "//" * 10_000)):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (root / ".searchignore").write_text("# none\nskip/\n")
    os.symlink("geo/geo.go", root / "link.go")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    return root


def test_worktree(tree):
    why = {c.path: c.excluded for c in W.enumerate_files(str(tree), 10_000)}
    assert (why["geo/geo.go"], why["vendor/v.go"], why["skip/a.go"], why["big.go"], why["link.go"]) == (None, "built_in", "ignore_file", "oversize", "symlink")
    with pytest.raises(ValueError):
        W.read_bounded(str(tree), "link.go")
    with pytest.raises(ValueError):
        W.read_bounded(str(tree), "../x")


def test_index_end_to_end(spark, tree, tmp_path):
    from tarnwell.service import Index

    index = Index(spark, str(tree), str(tmp_path / "index"), client=E.HashClient(16))
    assert index.reindex(dry_run=True).generation == 0
    assert index.reindex().added == 4 and not index.reindex().applied
    found = lambda q, **kw: index.search(q, **kw)["hits"][0]
    assert found("geo.Sum")["qualified"] == "geo.Sum"
    assert found("Scale")["qualified"] == "geo.Receiver.Scale"
    assert found("special_location.go")["path"] == "special_location.go"
    out = index.search("Sum adds", max_inline_bytes=2000)
    assert out["hits"][0]["inline"].startswith("// Sum adds.") and 0 < out["used_bytes"] <= 2000 and out["hits"][0]["freshness"] == "current"
    out = index.search("twice", mode="hybrid")
    assert out["hits"][0]["rank"] == 1 and out["fallback"] == "PAID_QUERY_DISABLED"
    (tree / "geo/geo.go").write_text(GO.replace("Sum", "Total"))
    (tree / "lib/tool.ts").unlink()
    status = index.status()
    assert (status["stale"], status["deleted"], status["generation"]) == (1, 1, 1)
    plan = index.reindex()
    assert (plan.changed, plan.deleted, plan.reused, plan.generation) == (1, 1, 2, 2)
    assert found("Total")["qualified"] == "geo.Total" and not [h for h in index.search("twice")["hits"] if h["symbol"] == "twice"]
    assert index.read_span("special_location.go", 3, 9)["text"] == "func Place() {}\n"
    with pytest.raises(ValueError):
        index.read_span("special_location.go", 1, 1, "0" * 64)


def test_hybrid_search_from_stored_vectors(spark, tree, tmp_path):
    from dataclasses import replace

    from tarnwell.service import Index
    from tarnwell.sources.config import Config

    class Counted(E.HashClient):
        texts: list = []
        fails = False

        def embed(self, texts):
            self.texts.extend(texts)
            if self.fails:
                raise E.Retryable("no")
            return super().embed(texts)

    paid = replace(Config(), allow_paid_query_embedding=True, dimensions=512, retry_seconds=())
    client, folder = Counted(512), str(tmp_path / "index")
    index = Index(spark, str(tree), folder, paid, client)
    index.reindex()
    why = lambda i: i.search("twice", mode="hybrid")["fallback"]
    assert why(index) == "PROFILE_RECONCILIATION_REQUIRED" and not client.texts
    done = index.embed_documents()
    assert done["requested"] > 0 and done["failed"] == 0
    assert index.embed_documents()["requested"] == 0
    client.texts.clear()
    out = index.search("twice", mode="hybrid")
    assert client.texts == ["twice"] and out["fallback"] is None
    assert any(h["vector_rank"] is not None for h in out["hits"])
    assert index.evaluation_session()["generation"] == index.store.active()["generation"]
    assert why(Index(spark, str(tree), folder, paid, None)) == "API_KEY_MISSING"
    assert why(Index(spark, str(tree), folder, replace(paid, dimensions=1024), client)) == "PROFILE_RECONCILIATION_REQUIRED"
    assert why(Index(spark, str(tree), folder, replace(paid, allow_paid_query_embedding=False), client)) == "PAID_QUERY_DISABLED"
    Counted.fails = True
    assert why(index) == "QUERY_EMBEDDING_FAILED"
    Counted.fails = False
    at = index.store.active()
    vectors = index.store.read("chunk_vectors", at)
    index.store.publish(at["generation"], {"chunk_vectors": vectors.selectExpr("hash", "dimensions", "codes", "CAST(0 AS FLOAT) AS scale", "norm")})
    assert why(index) == "VECTOR_SNAPSHOT_INVALID"
    index.store.publish(index.store.active()["generation"], {"chunk_vectors": vectors.limit(0)})
    assert why(index) == "NO_VALID_DOCUMENT_VECTORS"
    with pytest.raises(ValueError, match="0 of"):
        index.evaluation_session()


def test_postings_follow_the_files(spark, tree, tmp_path):
    from tarnwell.operators import lexical
    from tarnwell.service import Index

    index = Index(spark, str(tree), str(tmp_path / "index"))
    index.reindex()
    (tree / "geo/geo.go").write_text(GO.replace("Sum", "Total"))
    (tree / "lib/tool.ts").unlink()
    index.reindex()
    at = index.store.active()
    stored = index.store.read("postings", at)
    again = lexical.postings(index._tokens(index.store.read("chunks", at))).select(*stored.columns)
    assert stored.exceptAll(again).isEmpty() and again.exceptAll(stored).isEmpty()


def test_generation_after_a_crash(spark, tmp_path):
    s = G.GenerationStore(spark, str(tmp_path / "g"))
    row = spark.createDataFrame([(1, 2)], "chunk_id long, length long")
    assert s.publish(0, {"row_lengths": row})["generation"] == 1
    (tmp_path / "g" / "generation-000000002.json").write_text("half a sta")
    assert s.active()["generation"] == 1
    state = s.publish(1, {"row_lengths": row.unionAll(row)})
    assert state["generation"] == 3 and s.read("row_lengths").count() == 2
    with pytest.raises(G.Conflict):
        s.publish(1, {"row_lengths": row})


def test_stream_publishes_last_versions(spark, tmp_path):
    from tarnwell.streaming.files import deduplicated, publisher

    source, s = tmp_path / "in", G.GenerationStore(spark, str(tmp_path / "g"))
    ddl = "id long, path string, language string, indexed_sha256 string, observed_mtime_ns long, observed_size long, seen timestamp, sha string"
    rows = [(1, "a", "go", "h1", 0, 1, "2024-01-01 00:00:00", "h1"), (1, "a", "go", "h1", 0, 1, "2024-01-01 00:00:01", "h1"), (1, "a", "go", "h2", 0, 2, "2024-01-01 00:01:00", "h2"), (2, "b", "go", "h3", 0, 3, "2024-01-01 00:00:30", "h3")]
    spark.createDataFrame([json.dumps(dict(zip([c.split()[0] for c in ddl.split(", ")], r))) for r in rows], "string").write.text(str(source))
    stream = spark.readStream.schema(ddl).json(str(source))
    q = deduplicated(stream).drop("sha").writeStream.foreachBatch(publisher(s)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.path, r.indexed_sha256) for r in s.read("files").collect()} == {("a", "h2"), ("b", "h3")}

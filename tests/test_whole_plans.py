"""Plans that cover all edges, queries, parents and matches, held against their relations and their SQL."""

import os

import duckdb
import pytest

from tarnwell.plans.registry import ORACLES, QUERIES
from tarnwell.plans.relations import Data

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark, TABLES)


def same_as_sql(rows, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{TABLES}/{f}'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    return sorted((tuple(r[c] for c in names) for r in rows), key=str) == want


def test_direct_bridges_join_the_two_anchors(spark, data):
    """Every edge is held against the two anchors of every query; an edge with one anchor, or none, is no bridge."""
    got = QUERIES["J20_direct_bridge"](spark, TABLES).collect()
    anchors = {}
    for r in data.top_anchors.collect():
        anchors.setdefault(r.qid, set()).add(r.parent)
    edges = data.edges.collect()
    want = {(q, e.source, e.target, e.kind, e.tier, e.n) for q, pair in anchors.items() for e in edges if len(pair) == 2 and {e.source, e.target} == pair}
    assert {tuple(r) for r in got} == want and same_as_sql(got, "J20_direct_bridge")


def test_bridges_are_reserved_and_selected(spark):
    """A bridge that stronger edges leave out of its buckets displaces the last of them; policies choose or abstain."""
    from tarnwell.operators import graph

    rows = [(1, k, "CALL", "EXECUTABLE_DEPENDENCY", 9, f"b{k}", 1) for k in range(10, 13)] + [(k, 2, "CALL", "EXECUTABLE_DEPENDENCY", 9, f"c{k}", 1) for k in range(20, 23)]
    rows += [(1, 2, "CALL", "EXECUTABLE_DEPENDENCY", 1, "a1", 1), (3, 4, "TYPE_REF", "DECLARATION_CONTRACT", 1, "t1", 1), (3, 5, "TYPE_REF", "DECLARATION_CONTRACT", 5, "t2", 1), (7, 5, "TYPE_REF", "DECLARATION_CONTRACT", 1, "t3", 1)]
    edges = graph.statistics(spark.createDataFrame(rows, "source long, target long, kind string, tier string, n long, best_id string, roles long"))
    anchors = spark.createDataFrame([(0, 1, 1, "FORWARD"), (0, 2, 2, "FORWARD"), (5, 3, 1, "FORWARD"), (6, 99, 1, "FORWARD")], "qid long, node long, anchor int, wanted string")
    dense = spark.createDataFrame([(5, 4, 3)], "qid long, node long, rank int")
    final = graph.frontier(graph.views(edges, anchors, dense))
    found = {(r.qid, r.source, r.target): r for r in final.collect()}
    assert {k for k in found if k[0] == 0} == {(0, 1, 10), (0, 1, 2), (0, 20, 2), (0, 21, 2)} and found[0, 1, 2].bridge
    assert {k for k in found if k[0] == 5} == {(5, 3, 4), (5, 3, 5)}
    queries = spark.createDataFrame([(0,), (5,), (6,)], "qid long")
    chosen = {(r.qid, r.policy): (r.outcome, r.source, r.target) for r in graph.select_edge(final, queries).collect()}
    assert chosen[0, "cap_only"] == ("SELECTED", 1, 10) and chosen[0, "bridge"] == ("SELECTED", 1, 2) and chosen[0, "graph_only"] == ("DIRECT_BRIDGE", 1, 2)
    # One end of the two is in the dense ranks, so one edge is left.
    assert chosen[5, "graph_only"] == ("ONE_WINNER", 3, 5) and chosen[5, "bridge"] == ("NO_DIRECT_ANCHOR_BRIDGE", None, None)
    assert chosen[6, "cap_only"] == ("NO_FRONTIER_EDGE", None, None) and chosen[6, "graph_only"] == ("NO_CANDIDATE", None, None)


def test_replacement_of_all_parents(spark, data):
    got = QUERIES["S19_replacement_coverage"](spark, TABLES).collect()
    want = {r.vec_id for r in data.vectors.select("vec_id").collect()} - {r.vec_id for r in data.cache.select("vec_id").collect()}
    assert {(r.vec_id, r.problem) for r in got} == {(v, "missing") for v in want} and same_as_sql(got, "S19_replacement_coverage")


def test_all_matches(spark, data):
    scores = {(r.qid, r.chunk_id) for r in data.text_scores.select("qid", "chunk_id").collect()}
    got = QUERIES["A02_matched_terms"](spark, TABLES).collect()
    assert {(r.qid, r.chunk_id) for r in got} == scores and same_as_sql(got, "A02_matched_terms")
    got = QUERIES["J01_matches_chunks_files"](spark, TABLES).collect()
    assert {(r.qid, r.chunk_id) for r in got} == scores and {r.orphaned for r in got} == {True, False}
    assert same_as_sql(got, "J01_matches_chunks_files")


def test_gates_of_all_queries(spark):
    got = QUERIES["U07_disjoint_gates"](spark, TABLES).collect()
    assert same_as_sql(got, "U07_disjoint_gates") and "qid = 1" not in ORACLES["U07_disjoint_gates"]


def planted(tmp_path, **tables):
    """A folder of the smallest tables, some of them replaced by a query over the old ones; and rows of a plan's SQL on it."""
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        name = f[:-8]
        query = tables.get(name, "SELECT * FROM old").replace("old", f"'{TABLES}/{f}'")
        con.execute(f"COPY ({query}) TO '{tmp_path}/{f}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{f}'")
    return str(tmp_path), lambda sql: sorted((tuple(r) for r in con.execute(sql).fetchall()), key=str)


def test_projections_beyond_the_mark(spark, tmp_path):
    """Suppliers above 100 give spans beyond 1,000, which leave gaps like any other."""
    folder, sql = planted(tmp_path, lineitem="SELECT * REPLACE (CAST(CASE l_linenumber % 3 WHEN 0 THEN l_suppkey ELSE l_suppkey + 95 * l_linenumber END AS BIGINT) AS l_suppkey) FROM old")
    got = sorted((tuple(r) for r in QUERIES["C06_projections"](spark, folder).collect()), key=str)
    assert got == sql(ORACLES["C06_projections"]) and any(int(g.split("-")[-1]) > 1000 for _, g in got)


def test_tail_after_head_is_cut_after_both(spark, monkeypatch):
    """A head that the vector lane lacks pushes the tail down; the list still has 20 places."""
    head = spark.createDataFrame([(0, 100 + k, k) for k in range(1, 8)], "qid long, parent long, rank int")
    lane = spark.createDataFrame([(0, k, k) for k in range(1, 21)], "qid long, parent long, rank int")
    monkeypatch.setattr(Data, "__getattr__", lambda self, name: {"hybrid_fused": head, "vector_lane": lane}[name])
    rows = QUERIES["W12_tail_after_head"](spark, TABLES).collect()
    assert sorted((r["rank"], r["parent"]) for r in rows) == [(k, 100 + k if k <= 5 else k - 5) for k in range(1, 21)]


def test_vectors_of_one_split_are_scored_by_many_tasks(spark):
    """Tiles of vectors go to many tasks; nulls, other lengths and repeated ids stay as a sum over pairs has them."""
    from tarnwell.operators import vector

    kinds = "vec_id long, parent long, label int, codes array<int>, scale float, norm float"
    odd = [(1, 1, 0, [1, 2, 3], 0.5, 2.0), (2, 1, 1, None, 0.5, 1.0), (3, None, 1, [1, None, 3], 0.5, 1.0), (4, 2, None, [1, 2], 0.5, 1.0), (4, 2, None, [-127, 127, 5], 0.5, 1.0)]
    v = spark.createDataFrame(odd, kinds)
    # Where there is no product the clamp gives 1, as it did before.
    product = {(a[0], b[0], 1.0 if not a[3] or not b[3] or len(a[3]) != len(b[3]) or None in a[3] + b[3] else max(-1.0, min(1.0, round(sum(x * y for x, y in zip(a[3], b[3])) * a[4] * b[4] / (a[5] * b[5]), 6)))) for a in odd for b in odd}
    rows = vector.score_all(v, v, block=2).collect()
    assert len(rows) == 25 and {(r.qid, r.vec_id, r.score) for r in rows} == product
    many = spark.range(0, 400, 1, 1).selectExpr("id AS vec_id", "id AS parent", "1 AS label", "array(1, 2) AS codes", "float(1) AS scale", "float(1) AS norm")
    scored = vector.score_all(many.where("vec_id % 50 = 0"), many)
    assert scored.count() == 3200 and scored.rdd.getNumPartitions() >= 8

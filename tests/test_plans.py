"""Plans against the same SQL in another engine, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tarnwell.plans.catalog import PORTABLE
from tarnwell.plans.frames import FRAMES
from tarnwell.plans.registry import ORACLES, QUERIES
from tarnwell.plans.relations import Data

TABLES = "/root/testdata/sf0.001"
#: The driver holds every plan against its SQL on larger tables; here run the DataFrame plans and some of each family.
CHECKED = [n for n in FRAMES if n in ORACLES] + ["S17_publish_generation", "S21_insert_or_ignore", "J12_live_vs_indexed", "A09_status_counts", "A15_requirement_coverage", "A22_interval_union", "A27_edge_statistics", "W02_tie_ranks", "T10_edge_policies", "U04_difference", "R11_key_states"]


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


@pytest.fixture(scope="module")
def data(spark):
    """The relations of the smallest tables, those that many plans name made once."""
    d = Data(spark, TABLES)
    for name in ("vectors", "scores", "exact_scores", "vector_lane", "label_lane", "ranked", "exact_ranked", "judgments", "occurrences", "edges", "edge_stats", "top_anchors", "edge_views", "frontier", "query_terms", "postings", "text_lane", "symbol_lane", "path_lane", "lexical_fused", "hybrid_fused", "files", "chunks"):
        d.built[name] = getattr(d, name).cache()
    yield d
    for frame in d.built.values():
        frame.unpersist()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_plan_equals_sql(spark, other, data, name):
    df = FRAMES[name][0](data) if name in FRAMES else QUERIES[name](spark, TABLES)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    cursor = other.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert got == want


def test_registry():
    assert len(QUERIES) == len(PORTABLE) + len(FRAMES)
    assert all("{" not in sql or "'" in sql for sql in ORACLES.values())


def test_bm25_equals_an_independent_index(spark):
    import sqlite3

    from tarnwell.operators import lexical

    rows = [(1, ["ring", "small"], "a b c ring ring".split()), (2, ["bolt"], "ring bolt x y z z z".split()), (3, [], "a a a bolt".split()), (4, ["gear"], ["q"])] + [(k, ["pad"], ["fill"] * (k % 5 + 1)) for k in range(5, 20)]
    df = spark.createDataFrame(rows, "chunk_id long, symbol_tokens array<string>, body_tokens array<string>")
    terms = spark.createDataFrame([(0, "ring"), (0, "bolt"), (1, "a"), (1, "gear")], "qid long, term string")
    got = {(r.qid, r.chunk_id): r.score for r in lexical.bm25(lexical.postings(df, terms), lexical.corpus_size(lexical.row_lengths(df)), terms).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(symbols, body)")
    for i, s, b in rows:
        con.execute("INSERT INTO t(rowid, symbols, body) VALUES (?, ?, ?)", (i, " ".join(s), " ".join(b)))
    want = {}
    for q, match in ((0, '"ring" OR "bolt"'), (1, '"a" OR "gear"')):
        for i, s in con.execute("SELECT rowid, -bm25(t, 5.0, 1.0) FROM t WHERE t MATCH ?", (match,)):
            want[q, i] = round(s, 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)

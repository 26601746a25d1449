"""Plans whose memory or shuffles must not grow with the tables as they did."""

from tarnwell.operators import chunking, fusion, resolution, tiles, vector
from tarnwell.plans import shapes
from tarnwell.plans.registry import QUERIES
from tarnwell.plans.relations import Data


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_the_resolution_is_broadcast(spark, monkeypatch):
    plans, keep = [], resolution.staged

    def staged(df, name):
        plans.append(plan_of(df))
        return keep(df, name)

    monkeypatch.setattr(resolution, "staged", staged)
    files = shapes.files(spark.range(1, 41).withColumnRenamed("id", "p_partkey"))
    facts = resolution.facts(files)
    rows = resolution.occurrences(facts, resolution.resolve(facts), chunking.chunk_files(files))
    plans.append(plan_of(rows))
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not any("Broadcast" in p for p in plans)
    assert rows.count() == 3 * 191


WORDS = "chunk_id long, symbol_words string, body_words string, path_words string, length long"


def word_rows(spark):
    rows = [(k, "a b" if k % 3 else "", " ".join("abcd"[j % 4] for j in range(k % 5)), "", 2 * (k % 3 > 0) + k % 5) for k in range(1, 20)]
    return spark.createDataFrame([*rows, (None, "a", "c", "", 2), (30, None, None, "", 0), (31, "a", "", "", 1), (31, "", "a b", "", 2)], WORDS)


def test_all_scores_of_many_queries_by_tiles(spark):
    from collections import Counter
    from math import log

    docs = word_rows(spark)
    terms = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (2, "b", 1), (3, "nowhere", 1), (4, "a", 1), (4, "nowhere", 2)], "qid long, term string, rank long")
    asked = {1: "ac", 2: "b", 3: [], 4: "a"}
    rows = docs.where("chunk_id IS NULL OR chunk_id <> 31").collect()
    held = [(r.chunk_id, Counter((r.symbol_words or "").split()), Counter((r.body_words or "").split()), r.length) for r in rows]
    mean = sum(r[3] for r in held) / len(held)
    want = set()
    for q, own in asked.items():
        for c, s, b, length in held:
            score = 0.0
            for t in (t for t in own if s[t] + b[t]):
                n, tf = sum(1 for x in held if x[1][t] + x[2][t]), 5 * s[t] + b[t]
                idf = log((len(held) - n + 0.5) / (n + 0.5))
                score += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
            if any(s[t] + b[t] for t in own):
                want.add((q, c, round(score, 5), sum(1 for t in own if s[t] + b[t]), 2 if q in (1, 4) else 1))
    got = tiles.scores(docs.where("chunk_id IS NULL OR chunk_id <> 31"), terms, rows=5, block=2).collect()
    assert len(got) == len(want) and {(r.qid, r.chunk_id, round(r.score, 5), r.matched_terms, r.selected_terms) for r in got} == want


def test_no_match_of_a_query_is_shuffled(spark):
    """What leaves the tiles is the plan's rows: no exchange stands above them."""
    for name in ("A02_matched_terms", "A18_lexical_control"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Generate explode(found" in plan and plan.index("Generate explode(found") < plan.index("Exchange")


def test_all_matches_of_the_control_by_tiles(spark):
    docs = word_rows(spark).unionByName(spark.createDataFrame([(2, "", "", "a x", 0), (30, "", "", "c", 0)], WORDS))
    terms = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (2, "x", 1), (3, "nowhere", 1)], "qid long, term string, rank long")
    asked, want = {1: {"a", "c"}, 2: {"x"}}, {}
    for r in docs.collect():
        path = set(r.path_words.split())
        for q, own in asked.items():
            hit, in_path = want.get((q, r.chunk_id), (set(), False))
            hit = hit | (own & ({*(r.symbol_words or "").split(), *(r.body_words or "").split()} | path))
            want[q, r.chunk_id] = (hit, in_path or bool(own & path))
    want = {(*k, len(hit), p) for k, (hit, p) in want.items() if hit}
    got = tiles.matches(docs, terms, rows=4, block=1).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def few_vectors(spark, n=300):
    """Many equal vectors, so that ties reach over the cut, some null ones and some of another length."""
    import random

    rng = random.Random(5)
    some = [[rng.randint(-3, 3) or 1 for _ in range(4)] for _ in range(12)]
    rows = []
    for k in range(n):
        codes = None if k % 41 == 7 else [1, 2] if k % 67 == 3 else some[rng.randrange(12)]
        unit = None if codes is None else [c / 7 for c in codes]
        rows.append((k, k // 10, k % 4, codes, None if codes is None else 1.0, None if codes is None else 5.5, unit))
    return spark.createDataFrame(rows, "vec_id long, parent long, label int, codes array<int>, scale float, norm float, unit array<float>")


def test_first_of_a_tile_are_the_first_of_all(spark, monkeypatch):
    monkeypatch.setattr(vector, "WIDE", 64)
    monkeypatch.setattr(vector, "AT_ONCE", 3)
    v = few_vectors(spark)
    q = v.where("vec_id % 20 IN (0, 7)")
    for score, limit in ((vector.score_all, 20), (vector.score_exact, 20), (vector.score_all, 5), (vector.score_exact, 400)):
        every = score(q, v)
        key = lambda rows: sorted(map(str, rows.select("qid", "parent", "vec_id", "score", "rank").collect()))
        assert key(vector.first_segments(score, q, v, limit, 10)) == key(vector.segment_ranks(every).where(f"rank <= {limit}"))
        assert key(vector.first_parents(score, q, v, limit)) == key(vector.vector_lane(every, limit))
    ends = {r.qid: (r.least, r.most) for r in every_ends(vector.score_all(q, v)).collect()}
    assert {r.qid: (r.least, r.most) for r in vector.score_ends(q, v).collect()} == ends
    pairs = q.selectExpr("vec_id AS qid", "(vec_id + 3) % 30 AS parent")
    want = vector.score_all(q, v).join(pairs, ["qid", "parent"]).select("qid", "vec_id", "score")
    assert sorted(map(str, vector.score_pairs(pairs, q, v).select("qid", "vec_id", "score").collect())) == sorted(map(str, want.collect()))


def every_ends(scores):
    from pyspark.sql import functions as F

    return scores.groupBy("qid").agg(F.min("score").alias("least"), F.max("score").alias("most"))


def test_grades_and_label_lanes_score_no_vector(spark):
    d = Data(spark, "/root/testdata/sf0.001")
    for rows in (d.judgments, d.label_lane, d.spans):
        assert "MapInArrow" not in plan_of(rows)


def test_fused_lanes_cut_before_the_fusion_are_the_fusion_of_all(spark):
    d = Data(spark, "/root/testdata/sf0.01")
    same = d.scores.where("label = query_label").groupBy("qid", "parent").count()
    ranks = same.selectExpr("qid", "parent", "row_number() OVER (PARTITION BY qid ORDER BY count DESC, parent) AS rank")
    want = fusion.fuse([("lexical", ranks), ("vector", vector.vector_lane(d.scores))], "parent", 20, ["lexical", "vector"])
    assert sorted(map(str, d.hybrid_fused.collect())) == sorted(map(str, want.collect()))


def test_both_scores_of_all_pairs_need_no_join(spark):
    v = few_vectors(spark, 80)
    v = v.unionByName(v.where("vec_id IN (20, 33)"))
    q = v.where("vec_id % 20 = 0")
    want = vector.score_all(q, v).join(vector.score_exact(q, v).select("qid", "vec_id", "score").withColumnRenamed("score", "reference"), ["qid", "vec_id"])
    got = vector.score_both(q, v)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("qid", "vec_id", "score", "reference").collect()))
    top = plan_of(QUERIES["R02_reference_scores"](spark, "/root/testdata/sf0.001"))
    assert top.index("MapInArrow") < top.index("Exchange") and "SortMergeJoin" not in top[: top.index("MapInArrow")]


def test_best_scores_of_parents_leave_their_tile(spark):
    from pyspark.sql import functions as F

    v = few_vectors(spark)
    q = v.where("vec_id % 20 IN (0, 7)")
    for queries in (q, q.unionByName(q.where("vec_id = 40"))):
        want = vector.score_all(queries, v).groupBy("qid", "parent").agg(F.max("score").alias("score"))
        got = vector.best_scores(queries, v)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert plan_of(vector.best_scores(q, v)).index("MapInArrow") < plan_of(vector.best_scores(q, v)).index("Exchange")

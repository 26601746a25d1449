"""Relations of the lanes, of fusion, of the graph and of the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text as X
from tarnwell.operators import fusion, lexical, tiles, vector
from tarnwell.plans.relations import QUERY_STEP, SEGMENTS, Data, relation
from tarnwell.sources.published import published

_BM25 = """SELECT qid, chunk_id, round(sum(part), 6) AS score, count(*) AS matched_terms, any_value(selected_terms) AS selected_terms FROM (
  SELECT t.qid, p.chunk_id, s.selected_terms, w.idf * (5.0 * tf_symbols + tf_body) * 2.2 / ((5.0 * tf_symbols + tf_body) + 1.2 * (0.25 + 0.75 * z.length / c.mean_length)) AS part
  FROM {query_terms} t JOIN {postings} p ON p.term = t.term
  JOIN (SELECT term, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END AS idf
        FROM (SELECT term, count(*) AS n FROM {postings} GROUP BY term) CROSS JOIN (SELECT count(*) AS n_rows FROM {index_rows})) w ON w.term = t.term
  JOIN (SELECT chunk_id, len(symbol_tokens) + len(body_tokens) AS length FROM {index_rows}) z ON z.chunk_id = p.chunk_id
  CROSS JOIN (SELECT avg(len(symbol_tokens) + len(body_tokens)) AS mean_length FROM {index_rows}) c
  JOIN (SELECT qid, count(DISTINCT term) AS selected_terms FROM {query_terms} GROUP BY qid) s ON s.qid = t.qid)
GROUP BY qid, chunk_id"""


@relation("text_scores", _BM25)
def _text_scores(d: Data) -> DataFrame:
    return tiles.scores(d.words, d.query_terms)


@relation("exact_names", "SELECT DISTINCT a.qid, s.chunk_id FROM {anchors} a JOIN {symbols} s ON s.normalized_name = a.normalized JOIN {chunks} c ON c.chunk_id = s.chunk_id AND s.original_name = c.qualified WHERE a.lane = 'symbol'")
def _exact_names(d: Data) -> DataFrame:
    a = d.anchors.where("lane = 'symbol'").select("qid", "normalized")
    s = d.symbols.join(d.chunks.select("chunk_id", "qualified"), "chunk_id").where("original_name = qualified")
    return a.join(s, a["normalized"] == s["normalized_name"]).select("qid", "chunk_id").distinct()


@relation(
    "text_lane",
    """SELECT * FROM (SELECT s.qid, s.chunk_id, s.score, s.matched_terms, s.selected_terms, CASE WHEN e.chunk_id IS NULL THEN 0 ELSE 1 END AS exact_qualified, f.path, c.qualified,
    row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, CASE WHEN e.chunk_id IS NULL THEN 0 ELSE 1 END DESC, f.path, c.qualified, s.chunk_id) AS rank
    FROM {text_scores} s JOIN {chunks} c ON c.chunk_id = s.chunk_id JOIN {files} f ON f.file_id = c.file_id LEFT JOIN {exact_names} e ON e.qid = s.qid AND e.chunk_id = s.chunk_id) WHERE rank <= 20""",
)
def _text_lane(d: Data) -> DataFrame:
    docs = d.forward.withColumn("name", F.when(F.col("qualified") != "", X.normalize_identifier(F.col("qualified"))))
    return tiles.text_lane(docs, d.query_terms, d.anchors.where("lane = 'symbol'").select("qid", "normalized"))


def _anchored_sql(rows: str, order: str) -> str:
    return f"""SELECT qid, chunk_id, tier, normalized AS matched_anchor, path, qualified, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, ord, path, qualified, start_byte, chunk_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY tier, ord) AS kc FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, ord ORDER BY tier, {order}) AS ka FROM ({rows})) WHERE ka <= 20) WHERE kc = 1) WHERE rank <= 20"""


_SYMBOL_ROWS = """SELECT a.qid, a.ord, a.normalized, c.chunk_id, f.path, c.qualified, c.start_byte, CASE
    WHEN s.original_name = a.raw AND s.original_name = c.qualified THEN 1 WHEN s.original_name = a.raw AND s.original_name = c.symbol THEN 2
    WHEN s.normalized_name = a.normalized AND s.original_name = c.qualified THEN 3 WHEN s.normalized_name = a.normalized AND s.original_name = c.symbol THEN 4 ELSE 5 END AS tier
    FROM {anchors} a JOIN {symbols} s ON s.original_name = a.raw OR s.normalized_name = a.normalized JOIN {chunks} c ON c.chunk_id = s.chunk_id JOIN {files} f ON f.file_id = c.file_id
    WHERE a.lane = 'symbol'"""


@relation("symbol_lane", _anchored_sql(_SYMBOL_ROWS, "path, qualified, start_byte, chunk_id"))
def _symbol_lane(d: Data) -> DataFrame:
    return lexical.symbol_lane(d.anchors.where("lane = 'symbol'").drop("lane"), d.symbols, d.chunks, d.files)


_PATH_ROWS = """SELECT a.qid, a.ord, a.normalized, c.chunk_id, f.path, c.qualified, c.start_byte,
    CASE WHEN f.path = a.raw THEN 1 WHEN f.path ILIKE a.suffix ESCAPE '!' THEN 2 ELSE 3 END AS tier
    FROM (SELECT *, '%/' || replace(replace(replace(raw, '!', '!!'), '%', '!%'), '_', '!_') AS suffix, '%' || replace(normalized, ' ', '%') || '%' AS infix FROM {anchors} WHERE lane = 'path') a
    JOIN {files} f ON f.path = a.raw OR f.path ILIKE a.suffix ESCAPE '!' OR lower(f.path) LIKE a.infix ESCAPE '!' JOIN {chunks} c ON c.file_id = f.file_id"""


@relation("path_lane", _anchored_sql(_PATH_ROWS, "path, start_byte, qualified, chunk_id"))
def _path_lane(d: Data) -> DataFrame:
    return lexical.path_lane(d.anchors.where("lane = 'path'").drop("lane"), d.chunks, d.files)


def fuse_sql(lanes: list[tuple[str, str]], key: str, ties: list[str], limit: int | None) -> str:
    """SQL of ``fusion.fuse``; lanes are (name, relation)."""
    rows = " UNION ALL ".join(f"SELECT qid, {key}, '{n}' AS lane, rank FROM {{{r}}}" for n, r in lanes)
    ranks = ", ".join(f"min(rank) FILTER (WHERE lane = '{n}') AS {n}_rank" for n, _ in lanes)
    score = " + ".join(f"coalesce(CAST(1.0 AS DOUBLE) / (60 + {n}_rank), 0)" for n, _ in lanes)
    order = ", ".join(f"{t}_rank ASC NULLS LAST" for t in ties)
    names = ", ".join(f"{n}_rank" for n, _ in lanes)
    body = f"""SELECT qid, {key}, {names}, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {order}, {key}) AS rank FROM (
    SELECT *, round({score}, 12) AS score FROM (SELECT qid, {key}, {ranks} FROM ({rows}) GROUP BY qid, {key}))"""
    return f"SELECT * FROM ({body}) WHERE rank <= {limit}" if limit else body


LEXICAL = [("text", "text_lane"), ("symbol", "symbol_lane"), ("path", "path_lane")]


@relation("lexical_fused", fuse_sql(LEXICAL, "chunk_id", ["symbol", "path", "text"], 20))
def _lexical_fused(d: Data) -> DataFrame:
    return fusion.fuse([(n, getattr(d, r)) for n, r in LEXICAL], "chunk_id", 20, ["symbol", "path", "text"])


def _lane_sql(scores: str, limit: int | None = 20) -> str:
    body = f"""SELECT qid, parent, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent, vec_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY score DESC, vec_id) AS k FROM {{{scores}}}) WHERE k = 1"""
    return f"SELECT * FROM ({body}) WHERE rank <= {limit}" if limit else body


def _kept(d: Data, name: str, build) -> DataFrame:
    """Twenty rows a query, made once: all vectors are scored for them."""
    return published(d.spark, name, [f"{d.dir}/embeddings.parquet"], build)


def coded(d: Data) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors of ``scores``."""
    v = d.vectors.select("vec_id", "parent", "label", "codes", "scale", "norm")
    return v.where(F.col("vec_id") % QUERY_STEP == 0), v


def plain(d: Data) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors of ``exact_scores``."""
    v = d.vectors.select("vec_id", "parent", "label", "unit")
    return v.where(F.col("vec_id") % QUERY_STEP == 0), v


def asked_labels(d: Data) -> tuple[DataFrame, DataFrame]:
    """(qid, asked), the labels of each query's rows, one as a rule; and (asked, query_label) of each different one.

    What hangs on a query's label alone is made once for all queries that have it.
    """
    queries = d.embeddings.where(F.col("vec_id") % QUERY_STEP == 0).groupBy(F.col("vec_id").alias("qid")).agg(F.sort_array(F.collect_list("label")).alias("asked"))
    return queries, queries.select("asked").distinct().select("asked", F.explode("asked").alias("query_label"))


def _label_ranks(d: Data) -> tuple[DataFrame, DataFrame]:
    """Queries, and the label lane of each different ``asked``: (asked, parent, rank)."""
    from pyspark.sql import Window

    queries, labels = asked_labels(d)
    held = d.embeddings.groupBy("label", F.expr(f"vec_id div {SEGMENTS}").alias("parent")).agg(F.count(F.lit(1)).alias("n"))
    same = held.join(labels, F.col("label") == F.col("query_label")).groupBy("asked", "parent").agg(F.sum("n").alias("n"))
    return queries, same.select("asked", "parent", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("n"), "parent")).alias("rank"))


@relation("vector_lane", _lane_sql("scores"))
def _vector_lane(d: Data) -> DataFrame:
    return _kept(d, "vector-lane", lambda: vector.first_parents(vector.score_all, *coded(d)))


@relation("exact_lane", _lane_sql("exact_scores"))
def _exact_lane(d: Data) -> DataFrame:
    return _kept(d, "exact-lane", lambda: vector.first_parents(vector.score_exact, *plain(d)))


@relation("label_lane", "SELECT qid, parent, row_number() OVER (PARTITION BY qid ORDER BY n DESC, parent) AS rank FROM (SELECT qid, parent, count(*) AS n FROM {scores} WHERE label = query_label GROUP BY qid, parent)")
def _label_lane(d: Data) -> DataFrame:
    """A second lane over the parents of the vector lane: most vectors of the query's label first."""
    queries, ranks = _label_ranks(d)
    return queries.join(ranks, "asked").select("qid", "parent", "rank")


HYBRID = [("lexical", "label_lane"), ("vector", "vector_lane")]


@relation("hybrid_fused", fuse_sql(HYBRID, "parent", ["lexical", "vector"], 20))
def _hybrid_fused(d: Data) -> DataFrame:
    # Of the parents in the label lane only, those beyond its first 40 have 20 better ones before them;
    # those of the vector lane's 20 take their places, however far behind.
    queries, ranks = _label_ranks(d)
    first = queries.join(ranks.where("rank <= 40"), "asked").select("qid", "parent", "rank")
    met = d.vector_lane.select("qid", "parent").join(queries, "qid").join(ranks, ["asked", "parent"]).select("qid", "parent", "rank")
    return fusion.fuse([("lexical", first.unionByName(met)), ("vector", d.vector_lane)], "parent", 20, ["lexical", "vector"])


# --- evaluation -----------------------------------------------------------------------


@relation("ranked", "SELECT qid, vec_id AS item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent, vec_id) AS rank FROM {scores}) WHERE rank <= 20")
def _ranked(d: Data) -> DataFrame:
    return _kept(d, "ranked", lambda: vector.first_segments(vector.score_all, *coded(d)).select("qid", F.col("vec_id").alias("item"), "score", "rank"))


@relation("exact_ranked", "SELECT qid, vec_id AS item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent, vec_id) AS rank FROM {exact_scores}) WHERE rank <= 20")
def _exact_ranked(d: Data) -> DataFrame:
    return _kept(d, "exact-ranked", lambda: vector.first_segments(vector.score_exact, *plain(d)).select("qid", F.col("vec_id").alias("item"), "score", "rank"))


@relation(
    "judgments",
    """SELECT qid, vec_id AS item, CASE WHEN label = query_label THEN 2 WHEN label = (query_label + 1) % 10 THEN 1 ELSE 0 END AS grade, label = (query_label + 5) % 10 AS hard
    FROM {scores} WHERE label IN (query_label, (query_label + 1) % 10, (query_label + 5) % 10)""",
)
def _judgments(d: Data) -> DataFrame:
    queries, graded = graded_labels(d)
    return queries.join(graded, "asked").select("qid", "item", "grade", "hard")


def graded_labels(d: Data) -> tuple[DataFrame, DataFrame]:
    """Queries, and what each different ``asked`` makes of the vectors: (asked, item, grade, hard)."""
    queries, labels = asked_labels(d)
    near = F.array_distinct(F.array(F.col("query_label"), F.expr("(query_label + 1) % 10"), F.expr("(query_label + 5) % 10")))
    rows = d.embeddings.select(F.col("vec_id").alias("item"), "label").join(labels.withColumn("label", F.explode(near)), "label")
    grade = F.when(F.expr("label = query_label"), 2).when(F.expr("label = (query_label + 1) % 10"), 1).otherwise(0)
    return queries, rows.select("asked", "item", grade.alias("grade"), F.expr("label = (query_label + 5) % 10").alias("hard"))


@relation("cases", f"SELECT vec_id AS qid, label, CASE WHEN label < 5 THEN 'go' ELSE 'ts' END AS language, (vec_id // {QUERY_STEP}) % 4 <> 3 AS answerable FROM {{embeddings}} WHERE vec_id % {QUERY_STEP} = 0")
def _cases(d: Data) -> DataFrame:
    return d.embeddings.where(f"vec_id % {QUERY_STEP} = 0").selectExpr("vec_id AS qid", "label", "CASE WHEN label < 5 THEN 'go' ELSE 'ts' END AS language", f"(vec_id div {QUERY_STEP}) % 4 <> 3 AS answerable")


@relation("cohorts", "SELECT qid, 'label-' || label % 3 AS cohort FROM {cases} UNION SELECT qid, CASE WHEN answerable THEN 'task-find' ELSE 'task-none' END FROM {cases}")
def _cohorts(d: Data) -> DataFrame:
    task = F.when(F.col("answerable"), F.lit("task-find")).otherwise(F.lit("task-none"))
    rows = d.cases.select("qid", F.explode(F.array(F.concat(F.lit("label-"), (F.col("label") % 3).cast("string")), task)).alias("cohort"))
    return rows.distinct()


@relation("spans", "SELECT qid, item, 'g' || item % 16 AS group_id, 'a' || (item // 16) % 4 AS alternative FROM {judgments} WHERE grade = 2")
def _spans(d: Data) -> DataFrame:
    """Required spans: groups of alternatives, each a set of items; the query's direct answers."""
    return d.judgments.where("grade = 2").selectExpr("qid", "item", "concat('g', item % 16) AS group_id", "concat('a', (item div 16) % 4) AS alternative")


# --- relation graph and logs --------------------------------------------------------------

_KIND = "CASE l_returnflag WHEN 'A' THEN 'CALL' WHEN 'N' THEN 'TYPE_REF' ELSE 'MEMBER' END"
_OUTCOME = "CASE WHEN l_quantity < 30 THEN 'RESOLVED_UNIQUE' WHEN l_quantity < 40 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END"


def _occurrence_sql(base: str) -> str:
    return f"""SELECT lpad(CAST(l_orderkey AS VARCHAR(20)), 15, '0') || '.' || l_linenumber || '.' || lpad(CAST(l_partkey AS VARCHAR(20)), 12, '0') || '.' || lpad(CAST(l_suppkey AS VARCHAR(20)), 12, '0') AS occ_id, l_partkey AS source, l_suppkey AS target, {_KIND} AS kind, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'INITIALIZER' ELSE 'BODY' END WHEN l_linenumber % 2 = 0 THEN 'TYPE_BODY' ELSE 'SIGNATURE' END AS zone,
    l_linenumber AS ordinal, {_OUTCOME} AS outcome, CASE WHEN l_tax < 0.03 THEN 'PRODUCTION' WHEN l_tax < 0.05 THEN 'TEST' WHEN l_tax < 0.07 THEN 'BENCHMARK' ELSE 'EXAMPLE' END AS role, CAST(l_quantity AS BIGINT) AS bytes FROM {base}"""


@relation("occurrences", _occurrence_sql("{lineitem}"))
def _occurrences(d: Data) -> DataFrame:
    return d.spark.sql(_occurrence_sql("{rows}"), rows=d.lineitem)


TIER_ROWS = """SELECT * FROM (VALUES ('TYPE_REF', 'SIGNATURE', 'DECLARATION_CONTRACT', 1), ('TYPE_REF', 'TYPE_BODY', 'DECLARATION_CONTRACT', 1), ('TYPE_REF', 'BODY', 'BODY_REFERENCE', 3), ('TYPE_REF', 'INITIALIZER', 'BODY_REFERENCE', 3),
  ('CALL', 'SIGNATURE', 'EXECUTABLE_DEPENDENCY', 2), ('CALL', 'TYPE_BODY', 'EXECUTABLE_DEPENDENCY', 2), ('CALL', 'BODY', 'EXECUTABLE_DEPENDENCY', 2), ('CALL', 'INITIALIZER', 'EXECUTABLE_DEPENDENCY', 2),
  ('MEMBER', 'SIGNATURE', 'DECLARATION_STRUCTURE', 4), ('MEMBER', 'TYPE_BODY', 'DECLARATION_STRUCTURE', 4), ('MEMBER', 'BODY', 'DECLARATION_STRUCTURE', 4), ('MEMBER', 'INITIALIZER', 'DECLARATION_STRUCTURE', 4)) AS t(kind, zone, tier, place)"""

_EDGES = f"SELECT source, target, kind, tier, count(*) AS n, min(occ_id) AS best_id, count(DISTINCT role) AS roles FROM {{occurrences}} JOIN ({TIER_ROWS}) USING (kind, zone) WHERE source <> target AND outcome = 'RESOLVED_UNIQUE' GROUP BY source, target, kind, tier"


@relation("edges", _EDGES)
def _edges(d: Data) -> DataFrame:
    from tarnwell.operators.graph import edges

    return edges(d.occurrences)


@relation("log", "SELECT event_id AS id, user_id AS key, event_type AS status, event_type = 'error' AS terminal, value FROM {events}")
def _log(d: Data) -> DataFrame:
    return d.events.selectExpr("event_id AS id", "user_id AS key", "event_type AS status", "event_type = 'error' AS terminal", "value")


@relation("live", "SELECT file_id, path, CASE WHEN file_id % 10 = 3 THEN sha256(sha || 'changed') ELSE sha END AS sha, size FROM {files} WHERE file_id % 10 <> 7 UNION ALL SELECT file_id + 1000000000, 'new/' || path, sha, size FROM {files} WHERE file_id % 20 = 1")
def _live(d: Data) -> DataFrame:
    """The worktree as it is now: some files changed, some gone, some new."""
    now = d.files.where("file_id % 10 <> 7").selectExpr("file_id", "path", "CASE WHEN file_id % 10 = 3 THEN sha2(concat(sha, 'changed'), 256) ELSE sha END AS sha", "size")
    return now.unionAll(d.files.where("file_id % 20 = 1").selectExpr("file_id + 1000000000", "concat('new/', path)", "sha", "size"))


@relation("cache", "SELECT vec_id, CASE WHEN vec_id % 11 = 5 THEN CAST(0 AS FLOAT) ELSE scale END AS scale, norm, codes, vec_id % 3 AS profile FROM {vectors} WHERE vec_id % 7 <> 2")
def _cache(d: Data) -> DataFrame:
    """Stored vectors: some keys are missing, some rows are invalid, profiles differ."""
    return d.vectors.where("vec_id % 7 <> 2").selectExpr("vec_id", "CASE WHEN vec_id % 11 = 5 THEN CAST(0 AS FLOAT) ELSE scale END AS scale", "norm", "codes", "vec_id % 3 AS profile")


@relation("budgets", "SELECT * FROM (VALUES (1, 1024), (2, 2048), (4, 4096), (8, 8192)) AS t(most, bytes)")
def _budgets(d: Data) -> DataFrame:
    return d.spark.sql("SELECT * FROM VALUES (1, 1024), (2, 2048), (4, 4096), (8, 8192) AS t(most, bytes)")

"""Plans of traits, guards and gates. Their SQL says the same in another way than the plan does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import text as X
from tarnwell.operators import graph, store, traits, vector
from tarnwell.plans.frames import frame
from tarnwell.plans.relations import QUERY_STEP, Data, relation

# --- paths and declarations ----------------------------------------------------------------

_SHAPES = (
    ("pkg/a", ".go"),
    ("pkg/a", "_test.go"),
    ("pkg/a", "_example_test.go"),
    ("pkg/a", "_bench_test.go"),
    ("web/a", ".test.ts"),
    ("web/a", ".Example.tsx"),
    ("web/a", ".bench.ts"),
    ("lib/examples/a", ".ts"),
    ("lib/benchmarks/a", ".go"),
    ("lib/tests/a", ".tsx"),
    ("pkg/example_", ".go"),
    ("pkg/bench_", ".go"),
    ("web/Benchmark", ".tsx"),
    ("examples/a", ".go"),
    ("lib//./tests/a", ".ts"),
    ("docs/a", ".md"),
    ("Makefile", ""),
)
_PATH = "CASE file_id % " + str(len(_SHAPES)) + " " + " ".join(f"WHEN {k} THEN '{a}' || file_id || '{b}'" for k, (a, b) in enumerate(_SHAPES)) + " END"


@relation("code_paths", f"SELECT file_id, {_PATH} AS path FROM {{files}}")
def _code_paths(d: Data) -> DataFrame:
    return d.files.selectExpr("file_id", f"{_PATH} AS path")


_BASE = "list_extract(string_split(path, '/'), -1)"


@frame(
    "P14_file_role",
    f"""SELECT path, CASE
    WHEN ends_with(base, '_example_test.go') OR contains(base, '.example.') OR starts_with(base, 'example_') OR contains(lower_path, '/example/') OR contains(lower_path, '/examples/') THEN 'EXAMPLE'
    WHEN ends_with(base, '_bench_test.go') OR contains(base, '.bench.') OR contains(base, 'benchmark') OR starts_with(base, 'bench_') OR contains(lower_path, '/benchmark/') OR contains(lower_path, '/benchmarks/') THEN 'BENCHMARK'
    WHEN ends_with(base, '_test.go') OR contains(base, '.test.') OR contains(lower_path, '/test/') OR contains(lower_path, '/tests/') THEN 'TEST' ELSE 'PRODUCTION' END AS role
    FROM (SELECT path, lower({_BASE}) AS base, replace(replace(lower(path), '/./', '/'), '//', '/') AS lower_path FROM {{code_paths}})""",
)
def _p14(d: Data) -> DataFrame:
    return d.code_paths.select("path", traits.file_role(F.col("path")).alias("role"))


@frame(
    "P08_language_by_extension",
    """SELECT path, CASE WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.tsx') THEN 'tsx' WHEN ends_with(path, '.ts') THEN 'typescript' END AS language,
    ends_with(path, '.go') OR (ends_with(path, '.ts') AND NOT ends_with(path, '.tsx')) AS enabled FROM {code_paths}""",
)
def _p08(d: Data) -> DataFrame:
    found = traits.language(F.col("path"))
    return d.code_paths.select("path", found.alias("language"), F.coalesce(found.isin("go", "typescript"), F.lit(False)).alias("enabled"))


_BODIES = (
    ("go", "'// Old builds.' || chr(10) || '// Deprecated: use New.' || chr(10) || 'func Old() {}'"),
    ("typescript", "'/** Builds. @deprecated use make */' || chr(10) || 'export function old() {}'"),
    ("go", "'func Plain() {}' || chr(10) || '// Deprecated: too late'"),
    ("typescript", "'/** Builds.' || chr(10) || ' * Fine. */' || chr(10) || 'export function f() {} /** @deprecated */'"),
    ("go", "'  // Long.' || chr(10) || repeat(chr(9) || '// And longer.' || chr(10), 60) || '// Deprecated: far down' || chr(10) || 'func F() {}'"),
    ("typescript", "'// @deprecated' || chr(10) || 'function f() {}'"),
    ("go", "chr(10) || '//Deprecated:now' || chr(10) || 'type T int'"),
    ("typescript", "'/** never closed @deprecated'"),
    ("go", "'// Fine.' || chr(10) || chr(10) || '// Deprecated: after a gap' || chr(10) || 'func G() {}'"),
)
_DECLARED = "SELECT p_partkey AS chunk_id, {} AS language, {} AS body FROM {{part}}".format(
    "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{lang}'" for k, (lang, _) in enumerate(_BODIES)) + " END",
    "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {body}" for k, (_, body) in enumerate(_BODIES)) + " END",
)


@relation("declarations", _DECLARED)
def _declarations(d: Data) -> DataFrame:
    return d.spark.sql(_DECLARED.replace("{}", "{{}}"), part=d.part)


@frame(
    "P15_deprecated_trait",
    """SELECT chunk_id, CASE WHEN language = 'go' THEN len(list_filter(lines[1:coalesce(list_position(list_transform(lines, lambda l: starts_with(l, '//')), FALSE), len(lines) + 1) - 1], lambda l: contains(l, 'Deprecated:'))) > 0
    ELSE starts_with(body, '/**') AND contains(body, '*/') AND contains(string_split(body, '*/')[1], '@deprecated') END AS deprecated
    FROM (SELECT chunk_id, language, body, list_transform(string_split(trim(body, ' ' || chr(9) || chr(10)), chr(10)), lambda l: trim(l, ' ' || chr(9))) AS lines FROM {declarations})""",
)
def _p15(d: Data) -> DataFrame:
    return d.declarations.select("chunk_id", traits.deprecated(F.col("language"), F.col("body")).alias("deprecated"))


# --- queries ----------------------------------------------------------------------------------

_ASKS = ("", "the props contract", "set and write", "what does it return", "when is it", "its caller", "used by whom", "by itself", "deprecated examples", "the tests and a benchmark", "bench test example", "interface options", "used or not")
_ASKED = "SELECT item_id AS qid, text || ' ' || CASE item_id % 13 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_ASKS)) + " END AS text FROM {benchmark}"


@relation("asked", f"SELECT qid, {X.normalize_identifier_sql('text')} AS words FROM ({_ASKED})")
def _asked(d: Data) -> DataFrame:
    return d.spark.sql(_ASKED, benchmark=d.benchmark).select("qid", X.normalize_identifier(F.col("text")).alias("words"))


def _in(words) -> str:
    return "coalesce(bool_or(t IN (" + ", ".join(f"'{w}'" for w in words) + ")), FALSE)"


@frame(
    "P17_query_intent",
    f"""SELECT qid, {_in(traits.SIGNATURE_WORDS)} AS signature, {_in(traits.VALUE_PARAMETER_WORDS)} AS value_parameter, {_in(traits.MUTATION_WORDS)} AS mutation, {_in(["return"])} AS returns,
    {_in(traits.CONDITION_WORDS)} AS condition, {_in(["deprecated"])} AS deprecated, CASE WHEN {_in(["caller"])} OR ({_in(["used"])} AND {_in(["by"])}) THEN 'REVERSE' ELSE 'FORWARD' END AS direction,
    concat_ws(',', CASE WHEN {_in(["bench", "benchmark", "benchmarks"])} THEN 'BENCHMARK' END, CASE WHEN {_in(["example", "examples"])} THEN 'EXAMPLE' END, CASE WHEN {_in(["test", "tests"])} THEN 'TEST' END) AS roles
    FROM (SELECT qid, unnest(string_split(words, ' ')) AS t FROM {{asked}}) GROUP BY qid""",
)
def _p17(d: Data) -> DataFrame:
    return d.asked.select("qid", *(c.alias(n) for n, c in traits.intents(F.split("words", " ")).items()))


_ROLES = (*traits.CLOSURE_CLASSES, "TYPE_LOCAL", "CALL_METHOD")
_ROLE = f"CASE target % {len(_ROLES)} " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_ROLES)) + " END"


@frame(
    "P19_closure_role",
    f"""SELECT role, CASE WHEN role = 'TYPE_PARAMETER' THEN 'GENERIC_CONSTRAINT' WHEN role IN ('TYPE_FIELD', 'TYPE_ALIAS', 'TYPE_ARGUMENT', 'TYPE_OTHER') THEN 'SIGNATURE'
    WHEN role IN ('TYPE_VALUE_PARAMETER', 'TYPE_RETURN', 'TYPE_HERITAGE') THEN substr(role, 6) END AS class, count(*) AS n FROM (SELECT {_ROLE} AS role FROM {{occurrences}}) GROUP BY role""",
)
def _p19(d: Data) -> DataFrame:
    rows = d.occurrences.select(F.expr(_ROLE).alias("role"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).select("role", traits.closure_class(F.col("role")).alias("class"), "n")


# --- enclosing parents ------------------------------------------------------------------------

_PARENTS = "(1, 0, 64), (2, 0, 32), (3, 32, 64), (4, 8, 24), (5, 8, 16), (6, 40, 41), (7, 16, 24), (8, 8, 24)"
_SPANS = "(1, 9, 10), (2, 9, 20), (3, 30, 40), (4, 40, 41), (5, 16, 17), (6, 33, 33), (7, 60, 70)"


def _placed(d: Data, values: str, name: str) -> DataFrame:
    rows = d.spark.sql(f"SELECT * FROM VALUES {values} AS t({name}, a, b)")
    # A handful of constant rows for each file.
    return d.files.select("file_id", "size").join(F.broadcast(rows)).selectExpr("file_id", name, "size * a div 64 AS lo", "size * b div 64 AS hi")


@frame(
    "J10_enclosing_parent",
    f"""SELECT file_id, span, lo, hi, (SELECT arg_min(p.parent, (p.b - p.a) * 1000000 + p.parent) FROM (SELECT parent, x.size * s // 64 AS a, x.size * e // 64 AS b FROM (VALUES {_PARENTS}) AS t(parent, s, e)) p WHERE p.a <= x.lo AND x.hi <= p.b) AS parent
    FROM (SELECT file_id, size, span, size * a // 64 AS lo, size * b // 64 AS hi FROM {{files}} CROSS JOIN (VALUES {_SPANS}) AS t(span, a, b)) x""",
)
def _j10(d: Data) -> DataFrame:
    return traits.enclosing(_placed(d, _SPANS, "span"), _placed(d, _PARENTS, "parent"), ["file_id"])


# --- gates and configuration ------------------------------------------------------------------

_FLAGS = "(TRUE, TRUE, TRUE), (TRUE, TRUE, FALSE), (TRUE, FALSE, TRUE), (FALSE, TRUE, TRUE), (FALSE, FALSE, FALSE)"


@frame(
    "P21_hybrid_gate",
    f"""SELECT sample, paid, matches, client, CASE WHEN NOT paid THEN 'PAID_QUERY_DISABLED' WHEN NOT matches THEN 'PROFILE_RECONCILIATION_REQUIRED' WHEN bad > 0 THEN 'VECTOR_SNAPSHOT_INVALID' WHEN good = 0 THEN 'NO_VALID_DOCUMENT_VECTORS' WHEN NOT client THEN 'API_KEY_MISSING' ELSE '' END AS reason
    FROM (SELECT 'all' AS sample, (SELECT count(*) FROM {{cache}} WHERE scale > 0) AS good, (SELECT count(*) FROM {{cache}} WHERE scale <= 0) AS bad
      UNION ALL SELECT 'valid', (SELECT count(*) FROM {{cache}} WHERE scale > 0), 0 UNION ALL SELECT 'invalid', 0, (SELECT count(*) FROM {{cache}} WHERE scale <= 0) UNION ALL SELECT 'none', 0, 0)
    CROSS JOIN (VALUES {_FLAGS}) AS t(paid, matches, client)""",
)
def _p21(d: Data) -> DataFrame:
    """Why a search may not use vectors, over whole, valid, invalid and missing stores and the request's flags."""
    rows = d.vectors.select("vec_id").join(d.cache.select("vec_id", "scale"), "vec_id", "left")
    flags = d.spark.sql(f"SELECT * FROM VALUES {_FLAGS} AS t(paid, matches, client)")
    samples = {"all": "true", "valid": "scale > 0", "invalid": "scale <= 0", "none": "scale IS NULL"}
    out = None
    for name, which in samples.items():
        counts = store.vector_counts(rows.where(which), F.col("scale").isNotNull(), F.coalesce(F.col("scale"), F.lit(0)) > 0)
        one = counts.join(F.broadcast(flags)).select(F.lit(name).alias("sample"), "paid", "matches", "client", store.gate_reason(F.col("paid"), F.col("matches"), F.col("client")).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


# --- guards, over relations in which violations are planted --------------------------------------


@frame(
    "R07_one_query_vector",
    f"SELECT vec_id AS qid, CAST(2 AS BIGINT) AS vectors FROM {{embeddings}} WHERE vec_id % {QUERY_STEP} = 0 AND (vec_id // {QUERY_STEP}) % 3 = 1",
)
def _r07(d: Data) -> DataFrame:
    """Queries whose arms were not given one vector; the third arm's differs in every third query."""
    digest = F.sha2(F.array_join(F.transform("codes", lambda c: c.cast("string")), ","), 256)
    queries = d.vectors.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("qid"), digest.alias("digest"))
    arms = queries.withColumn("arm", F.explode(F.array(*map(F.lit, ("codec", "exact", "control")))))
    other = (F.col("arm") == "control") & (F.expr(f"qid div {QUERY_STEP}") % 3 == 1)
    arms = arms.withColumn("digest", F.when(other, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return arms.groupBy("qid").agg(F.countDistinct("digest").alias("vectors")).where("vectors > 1")


@frame(
    "R09_taxonomy_guard",
    f"""SELECT qid, labels, tasks FROM (SELECT vec_id AS qid, CAST(CASE WHEN (vec_id // {QUERY_STEP}) % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS labels, CAST(CASE WHEN (vec_id // {QUERY_STEP}) % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS tasks
    FROM {{embeddings}} WHERE vec_id % {QUERY_STEP} = 0) WHERE labels <> 1 OR tasks <> 1""",
)
def _r09(d: Data) -> DataFrame:
    """Cases without exactly one label cohort and one task cohort; some lack the task, some have a label more."""
    number = F.expr(f"qid div {QUERY_STEP}")
    rows = d.cohorts.where(~(F.startswith(F.col("cohort"), F.lit("task-")) & (number % 3 == 0)))
    rows = rows.unionByName(d.cases.where(number % 4 == 0).select("qid", F.lit("label-more").alias("cohort")))
    counts = rows.groupBy("qid").agg(F.count_if(F.startswith(F.col("cohort"), F.lit("label-"))).alias("labels"), F.count_if(F.startswith(F.col("cohort"), F.lit("task-"))).alias("tasks"))
    return counts.where("labels <> 1 OR tasks <> 1")


@frame(
    "R20_ranking_sorted",
    f"""WITH stored AS (SELECT qid, vec_id, score, CASE WHEN (qid // {QUERY_STEP}) % 2 = 0 AND rank = 2 THEN 3 WHEN (qid // {QUERY_STEP}) % 2 = 0 AND rank = 3 THEN 2 ELSE rank END AS rank FROM {{vector_lane}})
    SELECT a.qid, a.vec_id FROM stored a JOIN stored b ON b.qid = a.qid AND b.rank = a.rank - 1 WHERE b.score < a.score""",
)
def _r20(d: Data) -> DataFrame:
    """Rows of a stored ranking that stand behind a worse one; in every second query two ranks are exchanged."""
    swapped = F.when(F.expr(f"qid div {QUERY_STEP}") % 2 == 0, F.when(F.col("rank") == 2, 3).when(F.col("rank") == 3, 2))
    stored = d.vector_lane.select("qid", "vec_id", "score", F.coalesce(swapped, F.col("rank")).alias("rank"))
    before = F.lag("score").over(Window.partitionBy("qid").orderBy("rank"))
    return stored.withColumn("before", before).where("before < score").select("qid", "vec_id")


@frame("R08_recomputation", "SELECT side, qid, item FROM (SELECT qid, item FROM {ranked} WHERE item % 7 = 3 AND rank < 20) CROSS JOIN (VALUES ('stored'), ('recomputed')) AS t(side)")
def _r08(d: Data) -> DataFrame:
    """Differences between stored evidence and its recomputation, from both sides; some stored ranks are one too great."""
    rank = F.when((F.col("item") % 7 == 3) & (F.col("rank") < 20), F.col("rank") + 100).otherwise(F.col("rank"))
    stored = d.ranked.select("qid", "item", rank.alias("rank"))
    again = vector.segment_ranks(d.scores).where("rank <= 20").select("qid", F.col("vec_id").alias("item"), "rank")
    gone, new = stored.exceptAll(again).withColumn("side", F.lit("stored")), again.exceptAll(stored).withColumn("side", F.lit("recomputed"))
    return gone.unionByName(new).select("side", "qid", "item")


@frame("S25_graph_integrity", "SELECT source, target + 1000000000000 AS target, 'target' AS missing FROM {edges} WHERE n >= 2 GROUP BY source, target UNION SELECT -source - 1, target, 'source' FROM {edges} WHERE n >= 2 AND kind = 'CALL'")
def _s25(d: Data) -> DataFrame:
    """Edges whose ends the sidecar's nodes lack; copies with such ends are planted among the edges."""
    some = d.edges.where("n >= 2")
    planted = some.selectExpr("source", "target + 1000000000000 AS target").unionAll(some.where("kind = 'CALL'").selectExpr("-source - 1", "target"))
    return graph.dangling(d.edges.select("source", "target").unionAll(planted), d.part.select(F.col("p_partkey").alias("node"))).distinct()


@frame(
    "A42_label_reconciliation",
    """SELECT l.doc_id, CASE WHEN (quality = 1) <> (toxic = 0) OR (quality = 1 AND toxic = 0 AND n_chars % 5 = 0) THEN 'conflict' ELSE 'agreed' END AS outcome,
    CASE WHEN (quality = 1) <> (toxic = 0) OR (quality = 1 AND toxic = 0 AND n_chars % 5 = 0) THEN NULL WHEN quality = 1 THEN 2 ELSE 0 END AS label FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
)
def _a42(d: Data) -> DataFrame:
    """Two passes over the labelled documents: quality gives the first grade, toxicity the second; some groups differ."""
    rows = d.labels.join(d.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    one = rows.select("doc_id", (F.col("quality") * 2).alias("grade"), F.col("lang").alias("grp"))
    group = F.when(F.col("n_chars") % 5 == 0, F.lit("other")).otherwise(F.col("lang"))
    two = rows.select("doc_id", F.when(F.col("toxic") == 0, 2).otherwise(0).alias("grade"), group.alias("grp"))
    return store.reconciled(one, two, "doc_id")


_AT_K = "SELECT k FROM (VALUES (1), (5), (20)) AS t(k)"


@frame(
    "A17_metric_summaries",
    f"""WITH f AS (SELECT r.qid, min(r.rank) AS first_rank FROM {{ranked}} r JOIN {{judgments}} j ON j.qid = r.qid AND j.item = r.item WHERE j.grade = 2 GROUP BY r.qid),
    m AS (SELECT c.qid, c.answerable, c.language, k.k, CASE WHEN f.first_rank <= k.k THEN 1 ELSE 0 END AS hit, CASE WHEN f.first_rank <= k.k THEN 1.0 / CAST(f.first_rank AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS mrr FROM {{cases}} c CROSS JOIN ({_AT_K}) k LEFT JOIN f ON f.qid = c.qid)
    SELECT k, NULL AS language, NULL AS cohort, count(*) AS cases, count_if(answerable) AS answerable_cases, round(avg(hit) FILTER (answerable), 6) AS hit_rate, round(avg(mrr) FILTER (answerable), 6) AS mrr FROM m GROUP BY k
    UNION ALL SELECT k, language, NULL, count(*), count_if(answerable), round(avg(hit) FILTER (answerable), 6), round(avg(mrr) FILTER (answerable), 6) FROM m GROUP BY k, language
    UNION ALL SELECT k, NULL, cohort, count(*), count_if(answerable), round(avg(hit) FILTER (answerable), 6), round(avg(mrr) FILTER (answerable), 6) FROM m JOIN {{cohorts}} h ON h.qid = m.qid GROUP BY k, cohort""",
)
def _a17(d: Data) -> DataFrame:
    """Overall, by language and by cohort: a case counts once in each, though it has two cohorts."""
    first = d.ranked.join(d.judgments.where("grade = 2").select("qid", "item"), ["qid", "item"]).groupBy("qid").agg(F.min("rank").alias("first_rank"))
    rows = d.cases.select("qid", "answerable", "language").join(first, "qid", "left").withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))))
    found = F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False))
    rows = rows.withColumns({"hit": F.when(F.col("answerable"), found.cast("int")), "gain": F.when(F.col("answerable"), F.when(found, 1.0 / F.col("first_rank")).otherwise(0.0))})
    scopes = F.array(F.struct(F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("cohort")), F.struct(F.col("language").alias("language"), F.lit(None).cast("string").alias("cohort")))
    plain = rows.withColumn("s", F.explode(scopes)).select("qid", "k", "answerable", "hit", "gain", "s.*")
    grouped = rows.join(d.cohorts, "qid").select("qid", "k", "answerable", "hit", "gain", F.lit(None).cast("string").alias("language"), "cohort")
    out = plain.unionByName(grouped).groupBy("k", "language", "cohort")
    return out.agg(F.count(F.lit(1)).alias("cases"), F.count_if("answerable").alias("answerable_cases"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("gain"), 6).alias("mrr"))


@frame("T11_best_fact", "SELECT source, target, min(best_id) AS first_fact, first(kind ORDER BY n DESC, best_id) AS best_kind FROM {edges} GROUP BY source, target")
def _t11(d: Data) -> DataFrame:
    """The kind of the edge with most occurrences, of equals the one that occurs first."""
    place = F.struct((-F.col("n")).alias("less"), "best_id")
    return d.edges.groupBy("source", "target").agg(F.min("best_id").alias("first_fact"), F.min_by("kind", place).alias("best_kind"))


@frame(
    "A19_codec_fidelity",
    """WITH e AS (SELECT e.qid, e.item, e.rank, r.rank AS found, r.score, j.grade FROM {exact_ranked} e LEFT JOIN {ranked} r ON r.qid = e.qid AND r.item = e.item LEFT JOIN {judgments} j ON j.qid = e.qid AND j.item = e.item),
    p AS (SELECT a.qid, count(*) AS pairs, count(*) FILTER (a.found > b.found) AS inversions, count(*) FILTER (a.score = b.score) AS ties FROM e a JOIN e b ON b.qid = a.qid AND b.rank > a.rank AND a.found IS NOT NULL AND b.found IS NOT NULL GROUP BY a.qid)
    SELECT e.qid, count(*) AS reference, count(found) AS retained, count(*) - count(found) AS missing, max(CASE WHEN e.rank = 1 AND coalesce(found, 0) <> 1 THEN 1 ELSE 0 END) AS top1_mismatch,
    count(*) FILTER (grade = 2) AS gold, count(*) FILTER (grade = 2 AND found IS NOT NULL) AS gold_retained, round(avg(abs(e.rank - found)), 6) AS mean_displacement, quantile_disc(abs(e.rank - found), 0.5) AS median_displacement,
    quantile_disc(abs(e.rank - found), 0.95) AS p95_displacement, max(abs(e.rank - found)) AS max_displacement, any_value(round(coalesce(CAST(p.inversions AS DOUBLE) / p.pairs, 0), 6)) AS inversion_rate, any_value(round(coalesce(CAST(p.ties AS DOUBLE) / p.pairs, 0), 6)) AS tie_rate
    FROM e LEFT JOIN p ON p.qid = e.qid GROUP BY e.qid""",
)
def _a19(d: Data) -> DataFrame:
    """How the coded ranking keeps the exact one's top: what is missing, gold, displacement of ranks, pairs in the wrong order or tied."""
    rows = d.exact_ranked.select("qid", "item", "rank").join(d.ranked.select("qid", "item", F.col("rank").alias("found"), "score"), ["qid", "item"], "left")
    rows = rows.join(d.judgments.select("qid", "item", "grade"), ["qid", "item"], "left")
    # A query's list is cut to its top before, so these arrays and their pairs are small.
    listed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "found", "score", "grade"))).alias("l"))
    kept = F.filter("l", lambda x: x["found"].isNotNull())
    pairs = F.flatten(F.transform(F.col("kept"), lambda a: F.transform(F.filter(F.col("kept"), lambda b: b["rank"] > a["rank"]), lambda b: F.struct((a["found"] > b["found"]).alias("turned"), (a["score"] == b["score"]).alias("tied")))))
    listed = listed.withColumn("kept", kept).withColumn("pairs", pairs)
    moved = F.array_sort(F.transform("kept", lambda x: F.abs(x["rank"] - x["found"])))
    listed = listed.withColumn("moved", moved).withColumn("n", F.size("moved"))
    nearest = lambda q: F.when(F.col("n") > 0, F.element_at("moved", F.ceil(F.col("n") * q).cast("int")))
    total = F.aggregate("moved", F.lit(0).cast("long"), lambda s, v: s + v)
    share = lambda field: F.round(F.when(F.size("pairs") > 0, F.size(F.filter("pairs", lambda x: x[field])) / F.size("pairs")).otherwise(F.lit(0.0)), 6)
    count = lambda c: c.cast("long")
    return listed.select(
        "qid",
        count(F.size("l")).alias("reference"),
        count(F.col("n")).alias("retained"),
        count(F.size("l") - F.col("n")).alias("missing"),
        F.when(F.exists("l", lambda x: (x["rank"] == 1) & (F.coalesce(x["found"], F.lit(0)) != 1)), 1).otherwise(0).alias("top1_mismatch"),
        count(F.size(F.filter("l", lambda x: x["grade"] == 2))).alias("gold"),
        count(F.size(F.filter("kept", lambda x: x["grade"] == 2))).alias("gold_retained"),
        F.round(F.when(F.col("n") > 0, total / F.col("n")), 6).alias("mean_displacement"),
        nearest(0.5).alias("median_displacement"),
        nearest(0.95).alias("p95_displacement"),
        F.array_max("moved").alias("max_displacement"),
        share("turned").alias("inversion_rate"),
        share("tied").alias("tie_rate"),
    )

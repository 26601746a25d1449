"""Lanes of many queries by tiles, held against the lanes by joins and the control's definition."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwell.functions import text as X
from tarnwell.operators import lexical, tiles
import tarnwell.plans.registry  # noqa: F401 - all relations
from tarnwell.plans.relations import Data

TABLES = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _copied(spark):
    """The rows of the smallest tables three times, so that every score is tied."""
    d = Data(spark, TABLES)
    n = d.forward.count()
    copies = d.forward.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumns({c: F.col(c) + F.col("k") * n for c in ("chunk_id", "file_id")})
    return d, copies.withColumn("path", F.concat(F.col("k").cast("string"), F.lit("/"), "path")).drop("k")


def test_text_lane_by_tiles_is_the_lane_by_joins(spark):
    d, docs = _copied(spark)
    names = d.anchors.where("lane = 'symbol'").select("qid", "normalized")
    index = docs.select("chunk_id", F.split("symbol_words", " ").alias("s"), F.split("body_words", " ").alias("b"))
    index = index.select("chunk_id", F.filter("s", lambda t: t != "").alias("symbol_tokens"), F.filter("b", lambda t: t != "").alias("body_tokens"))
    scored = lexical.bm25(lexical.postings(index, d.query_terms), lexical.corpus_size(lexical.row_lengths(index)), d.query_terms)
    exact = names.join(docs.where("qualified <> ''").select("chunk_id", X.normalize_identifier(F.col("qualified")).alias("normalized")), "normalized")
    want = lexical.text_lane(scored, docs, docs, exact)
    named = docs.withColumn("name", F.when(F.col("qualified") != "", X.normalize_identifier(F.col("qualified"))))
    for rows, block in ((8192, 20_000), (50, 7)):
        got = tiles.text_lane(named, d.query_terms, names, rows=rows, block=block)
        assert _rows(got.select(want.columns)) == _rows(want)


def test_only_the_best_rows_of_a_tile_leave_it(spark, monkeypatch):
    """Every query and row share a common word, yet no more than ``limit`` rows of each different score leave a tile."""
    n, seen = 600, []
    kept = tiles._against
    monkeypatch.setattr(tiles, "_against", lambda *a: seen.append(kept(*a)) or seen[-1])
    docs = spark.range(n).select(F.col("id").alias("chunk_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("path"), F.lit("").alias("qualified"), F.lit(2).cast("long").alias("length"), F.lit("").alias("symbol_words"), F.lit("the end").alias("body_words"), F.lit(None).cast("string").alias("name"))
    terms = spark.range(n).select(F.col("id").alias("qid"), F.lit("the").alias("term"))
    got = tiles.text_lane(docs, terms, spark.createDataFrame([], "qid long, normalized string"), rows=n)
    assert {(r.chunk_id, r.rank) for r in got.collect()} == {(k, k + 1) for k in range(20)} and got.count() == 20 * n
    number = spark.sparkContext.defaultParallelism * 2
    assert seen[0].count() <= 20 * n * number


def test_names_are_looked_up_once_however_many_ask(spark):
    """A thousand queries for one name: its rows are joined once, not once a query."""
    anchors = spark.range(1000).select(F.col("id").alias("qid"), F.lit(1).alias("ord"), F.lit("p.N").alias("raw"), F.lit("p n").alias("normalized"))
    chunks = spark.range(100).select(F.col("id").alias("chunk_id"), F.col("id").alias("file_id"), F.lit("N").alias("symbol"), F.lit("p.N").alias("qualified"), F.lit(0).alias("start_byte"))
    symbols = chunks.select("chunk_id", F.col("qualified").alias("original_name"), F.lit("p n").alias("normalized_name"))
    files = chunks.select("file_id", F.format_string("%03d", "file_id").alias("path"))
    got = lexical.symbol_lane(anchors, symbols, chunks, files).select("qid", "chunk_id", "tier", "rank").collect()
    assert {tuple(r) for r in got} == {(q, k, 1, k + 1) for q in range(1000) for k in range(20)} and len(got) == 20_000


def test_queries_that_match_nothing(spark):
    d = Data(spark, TABLES)
    none = spark.createDataFrame([(1, "zzzzzz")], "qid long, term string")
    docs = d.forward.withColumn("name", F.lit(None).cast("string"))
    assert tiles.text_lane(docs, none, spark.createDataFrame([], "qid long, normalized string")).count() == 0
    assert tiles.text_lane(docs.where("false"), none, spark.createDataFrame([], "qid long, normalized string")).count() == 0


def test_control_by_tiles_is_the_control_by_joins(spark):
    d, _ = _copied(spark)
    words = {new: X.normalize_identifier(F.col(old)) for new, old in (("path_words", "path"), ("qualified_words", "qualified"), ("symbol_words_only", "symbol"))}
    docs = d.forward.withColumns(words)
    names = d.anchors.where("lane = 'symbol'").groupBy("qid").agg(*(F.min(F.when(F.col("ord") == k, F.col("normalized"))).alias(f"name_{k}") for k in (1, 2)))
    rows = d.control.join(docs, "chunk_id").join(names, "qid", "left")
    exact = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False)).desc()
    order = [exact("qualified_words", "name_1"), exact("symbol_words_only", "name_2"), F.desc("path_matched"), F.desc("matched"), "path_words", "start_byte", "end_byte", "qualified", "sha", "path"]
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where("rank <= 20").select("qid", "chunk_id", "matched", "rank")
    assert _rows(tiles.control_lane(docs, d.query_terms, names, rows=50, block=7)) == _rows(want)

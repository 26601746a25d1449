"""Lexical search: postings, BM25, and the text, symbol and path lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.text import escape_like

# BM25 parameters, field weights, floor of the inverse document frequency.
K1, B = 1.2, 0.75
SYMBOL_WEIGHT, BODY_WEIGHT = 5.0, 1.0
LEAST_IDF = 1e-6
CANDIDATES = 20


def postings(index_rows: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, length, tf_symbols, tf_body) of (chunk_id, symbol_tokens, body_tokens).

    ``length`` is the row's number of tokens; it rides along, so that scoring needs no
    join back to the rows. With ``terms`` only their postings are made: the filter runs on the exploded
    tokens, before anything is shuffled. A query set is small next to the corpus,
    but its size is not assumed: Spark broadcasts it only below its own threshold.
    """
    tagged = F.concat(
        F.transform(F.coalesce("symbol_tokens", F.array()), lambda t: F.struct(t.alias("term"), F.lit(1).alias("s"))),
        F.transform(F.coalesce("body_tokens", F.array()), lambda t: F.struct(t.alias("term"), F.lit(0).alias("s"))),
    )
    rows = index_rows.select("chunk_id", _length().alias("length"), F.explode(tagged).alias("t")).select("chunk_id", "length", "t.term", "t.s")
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("chunk_id", "term", "length").agg(F.sum("s").alias("tf_symbols"), F.sum(1 - F.col("s")).alias("tf_body"))


def _length() -> Column:
    return (F.size(F.coalesce("symbol_tokens", F.array())) + F.size(F.coalesce("body_tokens", F.array()))).cast("long")


def row_lengths(index_rows: DataFrame) -> DataFrame:
    """(chunk_id, length): number of tokens of each row."""
    return index_rows.select("chunk_id", _length().alias("length"))


def corpus_size(lengths: DataFrame) -> DataFrame:
    """One row: number of rows and their mean length, of ``row_lengths``."""
    return lengths.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("length").alias("mean_length"))


def term_weights(frequency: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, idf, mean_length) of (term, n); ``corpus`` is one row."""
    idf = F.log((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return frequency.join(F.broadcast(corpus)).select("term", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf).alias("idf"), "mean_length")


def bm25(found: DataFrame, corpus: DataFrame, query_terms: DataFrame, symbol_weight: float = SYMBOL_WEIGHT, body_weight: float = BODY_WEIGHT) -> DataFrame:
    """(qid, chunk_id, score, matched_terms, selected_terms): weighted BM25, higher is better.

    ``found`` are the postings of the queries' terms, ``corpus`` their corpus's size.
    Field weights multiply the term frequency; a row counts once for a term in
    either field; the floor keeps very common terms from counting against a row.
    The terms' weights are as many as the terms of the queries.
    """
    weights = term_weights(found.groupBy("term").agg(F.count(F.lit(1)).alias("n")), corpus)
    tf = symbol_weight * F.col("tf_symbols") + body_weight * F.col("tf_body")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weighted = found.join(weights, "term").select("term", "chunk_id", part.alias("part"))
    selected = query_terms.groupBy("qid").agg(F.countDistinct("term").alias("selected_terms"))
    sums = query_terms.select("qid", "term").distinct().join(weighted, "term").groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched_terms"))
    return sums.join(selected, "qid")


def text_lane(scored: DataFrame, chunks: DataFrame, files: DataFrame, exact: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Top ``limit`` of each query by score, exact qualified name, path, name, id; (.., rank).

    ``exact`` holds (qid, chunk_id) whose qualified name is the query's. Scored chunks
    that are not in ``chunks`` or whose file is missing are orphans, see ``orphans``.
    """
    marked = exact.select("qid", "chunk_id").distinct().withColumn("exact_qualified", F.lit(1))
    rows = scored.join(chunks.select("chunk_id", "file_id", "qualified"), "chunk_id").join(files.select("file_id", "path"), "file_id").join(marked, ["qid", "chunk_id"], "left")
    rows = rows.withColumn("exact_qualified", F.coalesce("exact_qualified", F.lit(0)))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("exact_qualified"), "path", "qualified", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return rows.select("qid", "chunk_id", "score", "matched_terms", "selected_terms", "exact_qualified", "path", "qualified", "rank")


def orphans(scored: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Scored rows without a chunk or file; any row is a broken index."""
    known = chunks.join(files, "file_id", "left_semi")
    return scored.join(known, "chunk_id", "left_anti")


def _anchored(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Best row of each chunk over a query's anchors, each anchor limited first."""
    by_anchor = Window.partitionBy("qid", "ord").orderBy("tier", *order)
    rows = rows.withColumn("k", F.row_number().over(by_anchor)).where(F.col("k") <= limit)
    by_chunk = Window.partitionBy("qid", "chunk_id").orderBy("tier", "ord")
    rows = rows.withColumn("k", F.row_number().over(by_chunk)).where("k = 1")
    final = Window.partitionBy("qid").orderBy("tier", "ord", "path", "qualified", "start_byte", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)
    return rows.select("qid", "chunk_id", "tier", F.col("normalized").alias("matched_anchor"), "path", "qualified", "rank")


def symbol_lane(anchors: DataFrame, symbols: DataFrame, chunks: DataFrame, files: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Chunks with a symbol equal to an anchor, raw or normalized, in five tiers.

    The disjunction is a union of two equi-joins, so that both hash instead of a
    nested loop; the tier's minimum merges rows that match both ways. What an anchor
    finds depends on its text alone, so each different text is looked up and limited
    once, however many queries ask for it.
    """
    names = symbols.select("chunk_id", "original_name", "normalized_name")
    texts = anchors.select("raw", "normalized").distinct()
    raw = texts.join(names, texts["raw"] == names["original_name"])
    folded = texts.join(names, texts["normalized"] == names["normalized_name"])
    rows = raw.unionByName(folded).distinct()
    rows = rows.join(chunks.select("chunk_id", "file_id", "symbol", "qualified", "start_byte"), "chunk_id").join(files.select("file_id", "path"), "file_id")
    same, alike = F.col("original_name") == F.col("raw"), F.col("normalized_name") == F.col("normalized")
    full, short = F.col("original_name") == F.col("qualified"), F.col("original_name") == F.col("symbol")
    tier = F.when(same & full, 1).when(same & short, 2).when(alike & full, 3).when(alike & short, 4).otherwise(5)
    order = [F.col("path"), F.col("qualified"), F.col("start_byte"), F.col("chunk_id")]
    by_text = Window.partitionBy("raw", "normalized").orderBy("tier", *order)
    rows = rows.withColumn("tier", tier).withColumn("k", F.row_number().over(by_text)).where(F.col("k") <= limit)
    return _anchored(anchors.join(rows, ["raw", "normalized"]), order, limit)


#: Letters of a piece of a path by which an infix finds the paths that may hold it.
GRAM = 3


def _last(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), "/"), -1)


def path_ends(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, anchor's columns) of the files whose path is the anchor's ``raw`` or ends in it; ``tier`` 1 or 2.

    Both have the same last step, by which they are joined.
    """
    held = anchors.withColumns({"suffix": F.concat(F.lit("%/"), escape_like(F.col("raw"))), "anchor_step": _last(F.col("raw"))})
    rows = files.select("file_id", "path", _last(F.col("path")).alias("step")).join(held, F.col("step") == F.col("anchor_step"))
    equal, ends = F.expr("path = raw"), F.expr("path ILIKE suffix ESCAPE '!'")
    return rows.where(equal | ends).withColumn("tier", F.when(equal, 1).otherwise(2)).drop("step", "anchor_step", "suffix")


def path_holds(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """The same for the files whose path holds the words of ``normalized`` in order; tier 3.

    Such a path holds the first letters of the longest word, so paths are cut into
    pieces of that length and joined by them; only words shorter than a piece are held
    against every path.
    """
    infix = F.concat(F.lit("%"), F.replace(F.col("normalized"), F.lit(" "), F.lit("%")), F.lit("%"))
    words = F.split("normalized", " ")
    longest = F.reduce(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    held = anchors.withColumns({"infix": infix, "gram": F.when(F.length(longest) >= GRAM, F.substring(longest, 1, GRAM))})
    # Dealt to tasks by number: paths are few bytes, what they are held against is not.
    paths = files.select("file_id", "path", F.lower("path").alias("lower_path")).repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "file_id")
    starts = F.when(F.length("lower_path") >= GRAM, F.sequence(F.lit(1), F.length("lower_path") - GRAM + 1))
    cut = paths.withColumn("piece", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("lower_path"), i, F.lit(GRAM))))))
    found = cut.join(held.where("gram IS NOT NULL"), F.col("piece") == F.col("gram")).drop("piece")
    short = paths.join(held.where("gram IS NULL"), F.expr("lower_path LIKE infix ESCAPE '!'"))
    rows = found.where(F.expr("lower_path LIKE infix ESCAPE '!'")).unionByName(short)
    return rows.drop("infix", "gram", "lower_path").withColumn("tier", F.lit(3))


def path_lane(anchors: DataFrame, chunks: DataFrame, files: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Chunks whose file's path is an anchor, ends in it, or holds its words in order; three tiers."""
    looked = anchors.select("qid", "ord", "raw", "normalized")
    both = path_ends(looked, files).unionByName(path_holds(looked, files))
    rows = both.groupBy("qid", "ord", "raw", "normalized", "file_id", "path").agg(F.min("tier").alias("tier"))
    rows = rows.join(chunks.select("chunk_id", "file_id", "qualified", "start_byte"), "file_id")
    return _anchored(rows, [F.col("path"), F.col("start_byte"), F.col("qualified"), F.col("chunk_id")], limit)

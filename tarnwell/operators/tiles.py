"""Lanes of many queries at once: rows in tiles, each held against a block of queries, the best of a tile kept.

A join of queries with postings has a row for every match, which common words make as
many as queries times rows. Here a tile's rows are inverted in numpy and a query adds up
the lists of its terms in one array, so that only its best rows leave the tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.operators import lexical

#: Rows and tokens of a tile, and queries that are held against it at a time.
ROWS, TOKENS, BLOCK = 8192, 4_000_000, 20_000
#: Queries that are held against a tile at a time if all that they match leaves it.
MATCH_BLOCK = 2048
#: Decimals of a score, and how far below a kept score one may lie that rounds to the same.
DECIMALS = 6
MARGIN = 2 * 10.0**-DECIMALS


class Lists:
    """Rows of each term of ``vocabulary`` in columns of space-joined words, and how often they hold it in each column."""

    def __init__(self, columns: list[pa.ChunkedArray], vocabulary: pa.Array):
        n, width, keys, marks = len(columns[0]), max(1, len(vocabulary)), [], []
        for k, column in enumerate(columns):
            words = pc.split_pattern(pc.fill_null(column.combine_chunks(), ""), " ")
            ids = pc.index_in(words.flatten(), value_set=vocabulary)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False))[known]
            keys.append(rows * width + ids.drop_null().to_numpy().astype(np.int64))
            marks.append(np.full(len(rows), k))
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        marks = np.concatenate(marks)
        #: By row, then term.
        self.rows, self.terms = found // width, found % width
        self.counts = [np.bincount(at[marks == k], minlength=len(found)) for k in range(len(columns))]
        self.starts = np.searchsorted(self.rows, np.arange(n + 1))
        self.order = np.argsort(self.terms, kind="stable")
        self.ends = np.searchsorted(self.terms[self.order], np.arange(width + 1))

    def by_term(self, values: np.ndarray) -> list[np.ndarray]:
        """``values`` of the pairs of row and term, a list for each term."""
        return np.split(values[self.order], self.ends[1:-1])

    def matched(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """How many terms of the mask ``asked`` each of ``rows`` holds."""
        return np.array([np.count_nonzero(asked[self.terms[self.starts[r] : self.starts[r + 1]]]) for r in rows], np.int64)


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """Different strings of a column of lists, and each list as their numbers."""
    lists = column.combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)[:-1])


def first_scored(scores: np.ndarray, exact: np.ndarray, limit: int) -> np.ndarray:
    """Rows, in the order of ties, that may be among the first ``limit`` once scores are rounded.

    All above the score at ``limit``; of those that may round to the same as it, the first
    ``limit`` of each different score, exact ones before others.
    """
    least = np.partition(scores, len(scores) - limit)[len(scores) - limit] if len(scores) > limit else 0.0
    rows = np.flatnonzero((scores >= least - MARGIN) & (scores > 0))
    if len(rows) <= limit:
        return rows
    order = np.lexsort((rows, ~exact[rows], -scores[rows]))
    rows = rows[order]
    new = np.append(True, np.diff(scores[rows]) != 0)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return rows[place < limit]


def _text_tile(limit: int, schema: pa.Schema):
    def pick(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return schema.empty_table()
        docs = docs.sort_by([(c, "ascending") for c in ("path", "qualified", "chunk_id")])
        vocabulary, terms = _coded(asked["terms"])
        names, wanted = _coded(asked["names"])
        lists = Lists([docs["symbol_words"], docs["body_words"]], vocabulary)
        idf = np.zeros(len(vocabulary))
        idf[np.concatenate(terms)] = asked["idfs"].combine_chunks().flatten().to_numpy()
        length, mean = docs["length"].to_numpy()[lists.rows], asked["mean_length"][0].as_py()
        tf = lexical.SYMBOL_WEIGHT * lists.counts[0] + lexical.BODY_WEIGHT * lists.counts[1]
        part = idf[lists.terms] * tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * length / mean))
        rows, parts = lists.by_term(lists.rows), lists.by_term(part)
        name = pc.fill_null(pc.index_in(docs["name"].combine_chunks(), value_set=names, skip_nulls=True), -1).to_numpy()
        mask, found = np.zeros(len(vocabulary), bool), []
        for q, own in enumerate(terms):
            scores = np.zeros(docs.num_rows)
            for t in own:
                scores[rows[t]] += parts[t]
            exact = np.isin(name, wanted[q]) if len(wanted[q]) else np.zeros(len(name), bool)
            kept = first_scored(scores, exact, limit)
            mask[own] = True
            found.append((np.full(len(kept), q), kept, scores[kept], lists.matched(kept, mask), exact[kept]))
            mask[own] = False
        q, kept, scores, matched, exact = (np.concatenate(x) for x in zip(*found))
        own, queries = docs.select(["chunk_id", "path", "qualified"]).take(kept), asked.select(["qid", "selected_terms"]).take(q)
        values = {"qid": queries["qid"], "selected_terms": queries["selected_terms"], **{c: own[c] for c in own.column_names}}
        values |= {"sum": pa.array(scores), "matched_terms": pa.array(matched), "exact_qualified": pa.array(exact.astype(np.int32))}
        return pa.table([values[f.name].cast(f.type) for f in schema], schema=schema)

    return pick


def _control_tile(limit: int, schema: pa.Schema):
    def pick(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return schema.empty_table()
        ties = ("path_words", "start_byte", "end_byte", "qualified", "sha", "path", "chunk_id")
        docs = docs.take(pc.sort_indices(docs, sort_keys=[(c, "ascending") for c in ties], null_placement="at_start"))
        vocabulary, terms = _coded(asked["terms"])
        lists = Lists([docs["symbol_words"], docs["body_words"], docs["path_words"]], vocabulary)
        rows, in_path = lists.by_term(lists.rows), lists.by_term(lists.counts[2] > 0)
        path_rows = [r[p] for r, p in zip(rows, in_path)]
        named = []
        for own, column in (("qualified_words", "name_1"), ("symbol_words_only", "name_2")):
            names = pc.unique(asked[column].combine_chunks()).drop_null()
            code = pc.fill_null(pc.index_in(docs[own].combine_chunks(), value_set=names, skip_nulls=True), -1).to_numpy()
            named.append((code, pc.fill_null(pc.index_in(asked[column].combine_chunks(), value_set=names, skip_nulls=True), -2).to_numpy()))
        found = []
        for q, own in enumerate(terms):
            matched, path = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, bool)
            for t in own:
                matched[rows[t]] += 1
                path[path_rows[t]] = True
            first, second = (code == wanted[q] for code, wanted in named)
            place = np.where(matched > 0, ((first * 2 + second) * 2 + path) * (len(own) + 1) + matched, 0)
            least = np.partition(place, len(place) - limit)[len(place) - limit] if len(place) > limit else 0
            kept = np.flatnonzero((place >= max(least, 1)))
            kept = kept[np.argsort(-place[kept], kind="stable")[:limit]]
            found.append((np.full(len(kept), q), kept, matched[kept], path[kept], first[kept], second[kept]))
        q, kept, matched, path, first, second = (np.concatenate(x) for x in zip(*found))
        own = docs.select(["chunk_id", *ties[:-1]]).take(kept)
        values = {"qid": asked["qid"].take(q), **{c: own[c] for c in own.column_names}, "matched": pa.array(matched)}
        values |= {"path_matched": pa.array(path), "exact_1": pa.array(first), "exact_2": pa.array(second)}
        return pa.table([values[f.name].cast(f.type) for f in schema], schema=schema)

    return pick


def _match_tile(schema: pa.Schema, scored: bool):
    """Every row that holds a term of a query, a list of them for each query; rows of one chunk_id are one chunk."""

    def pick(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return schema.empty_table()
        chunks = pc.dictionary_encode(docs["chunk_id"].combine_chunks(), null_encoding="encode")
        code = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n, vocabulary, terms = len(chunks.dictionary), *_coded(asked["terms"])
        lists = Lists([docs["symbol_words"], docs["body_words"], docs["path_words"]], vocabulary)
        # Pairs of chunk and term; a chunk of several rows has their counts together.
        width = max(1, len(vocabulary))
        pairs, at = np.unique(code[lists.rows] * width + lists.terms, return_inverse=True)
        counts = [np.bincount(at, c, len(pairs)) for c in lists.counts]
        owner, term = pairs // width, pairs % width
        order = np.argsort(term, kind="stable")
        ends = np.searchsorted(term[order], np.arange(width + 1))[1:-1]
        by_term = lambda values: np.split(values[order], ends)
        rows, in_path, part, times = by_term(owner), by_term(counts[2] > 0), None, np.ones(n, np.int64)
        if scored:
            idf = np.zeros(width)
            idf[np.concatenate(terms)] = asked["idfs"].combine_chunks().flatten().to_numpy()
            mean = asked["mean_length"][0].as_py()
            by_code, times = np.argsort(code, kind="stable"), np.bincount(code, minlength=n)
            first = np.cumsum(times) - times
            pair = np.repeat(np.arange(len(pairs)), times[owner])
            place = np.arange(len(pair)) - np.repeat(np.cumsum(times[owner]) - times[owner], times[owner])
            length = docs["length"].to_numpy()[by_code[first[owner[pair]] + place]]
            tf = (lexical.SYMBOL_WEIGHT * counts[0] + lexical.BODY_WEIGHT * counts[1])[pair]
            each = idf[term[pair]] * tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * length / mean))
            part = by_term(np.bincount(pair, each, len(pairs)))
        found, sizes = [], []
        for own in terms:
            matched, more = np.zeros(n, np.int64), np.zeros(n, float if scored else bool)
            for t in own:
                matched[rows[t]] += 1
                if scored:
                    more[rows[t]] += part[t]
                else:
                    more[rows[t][in_path[t]]] = True
            kept = np.flatnonzero(matched)
            sizes.append(len(kept))
            found.append((kept, matched[kept] * times[kept], more[kept]))
        kept, matched, more = (np.concatenate(x) for x in zip(*found))
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        listed = pa.StructArray.from_arrays([chunks.dictionary.take(pa.array(kept)), pa.array(matched), pa.array(more)], fields=list(schema.field("found").type.value_type))
        return pa.table([asked["qid"], pa.ListArray.from_arrays(offsets, listed).cast(schema.field("found").type)], schema=schema)

    return pick


def _against(docs: DataFrame, queries: DataFrame, n_queries: int, make, limit: int, columns: str, rows: int, block: int) -> DataFrame:
    """``make``'s rows of every tile with every block of queries; ``docs`` have chunk_id and length, ``queries`` qid."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(columns)
    n, tokens = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(n / rows), math.ceil(tokens / TOKENS), min(2 * cores, math.ceil(n / 512)))
    blocks = max(1, math.ceil(n_queries / block))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    number = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = docs.withColumn("tile", number("chunk_id", tiles)).withColumn("block", each(blocks))
    right = queries.withColumn("block", number("qid", blocks)).withColumn("tile", each(tiles))
    both = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block"))
    return both.applyInArrow(make(limit, to_arrow_schema(schema)), schema)


def frequencies(docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(term, n): rows that hold a term of the queries. Rows of a batch are counted before anything is shuffled."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = [pc.split_pattern(pc.fill_null(b[c], ""), " ") for c in ("symbol_words", "body_words")]
            rows = np.concatenate([np.repeat(np.arange(b.num_rows), pc.list_value_length(w).to_numpy(zero_copy_only=False)) for w in words])
            coded = pc.dictionary_encode(pa.concat_arrays([w.flatten() for w in words]))
            pairs = np.unique(rows * len(coded.dictionary) + coded.indices.to_numpy())
            counts = np.bincount(pairs % len(coded.dictionary), minlength=len(coded.dictionary))
            yield pa.record_batch([coded.dictionary, pa.array(counts)], schema=schema)

    found = docs.select("symbol_words", "body_words").mapInArrow(count, "term string, n long")
    return found.join(query_terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def _weighted(docs: DataFrame, query_terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, t, mean_length), the terms of each query that rows hold with their weights, and (qid, selected_terms)."""
    weights = lexical.term_weights(frequencies(docs, query_terms), lexical.corpus_size(docs))
    asked = query_terms.select("qid", "term").distinct()
    selected = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("selected_terms"))
    lists = asked.join(weights, "term").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"), F.max("mean_length").alias("mean_length"))
    return lists, selected


def scores(docs: DataFrame, query_terms: DataFrame, rows: int = ROWS, block: int = MATCH_BLOCK) -> DataFrame:
    """All scores of ``lexical.bm25``: (qid, chunk_id, score, matched_terms, selected_terms), for which no match is shuffled.

    ``docs`` have chunk_id, length, symbol_words and body_words (space-joined).
    """
    lists, selected = _weighted(docs, query_terms)
    queries = lists.select("qid", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"), "mean_length")
    held = docs.select("chunk_id", "length", "symbol_words", "body_words", F.lit("").alias("path_words"))
    columns = "qid long, found array<struct<chunk_id:long,matched_terms:long,sum:double>>"
    found = _against(held, queries, selected.count(), lambda _, schema: _match_tile(schema, True), 0, columns, rows, block)
    found = found.join(selected, "qid").select("qid", F.explode("found").alias("f"), "selected_terms")
    return found.select("qid", "f.chunk_id", F.round("f.sum", DECIMALS).alias("score"), "f.matched_terms", "selected_terms")


def matches(docs: DataFrame, query_terms: DataFrame, rows: int = ROWS, block: int = MATCH_BLOCK) -> DataFrame:
    """(qid, chunk_id, matched, path_matched): chunks with any term of a query, how many different ones, and whether one is in the path.

    ``docs`` have chunk_id, length, symbol_words, body_words and path_words; a chunk may have several rows.
    """
    queries = query_terms.select("qid", "term").distinct().groupBy("qid").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    columns = "qid long, found array<struct<chunk_id:long,matched:long,path_matched:boolean>>"
    held = docs.select("chunk_id", "length", "symbol_words", "body_words", "path_words")
    found = _against(held, queries, queries.select("qid").count(), lambda _, schema: _match_tile(schema, False), 0, columns, rows, block)
    return found.select("qid", F.explode("found").alias("f")).select("qid", "f.*")


def text_lane(docs: DataFrame, query_terms: DataFrame, names: DataFrame, limit: int = lexical.CANDIDATES, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The lane of ``lexical.text_lane`` over the scores of ``lexical.bm25``, of many queries.

    ``docs`` have chunk_id, path, qualified, length, symbol_words, body_words (space-joined) and ``name``,
    the normalized qualified name; ``names`` are (qid, normalized) that make a row exact.
    """
    docs = docs.where("chunk_id IS NOT NULL")
    lists, selected = _weighted(docs, query_terms)
    exact = names.groupBy("qid").agg(F.collect_set("normalized").alias("names"))
    queries = lists.join(selected, "qid").join(exact, "qid", "left")
    queries = queries.select("qid", "selected_terms", "mean_length", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    columns = "qid long, chunk_id long, sum double, matched_terms long, selected_terms long, exact_qualified int, path string, qualified string"
    held = docs.select("chunk_id", "path", "qualified", "length", "symbol_words", "body_words", "name")
    best = _against(held, queries, selected.count(), _text_tile, limit, columns, rows, block).withColumn("score", F.round("sum", DECIMALS))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("exact_qualified"), "path", "qualified", "chunk_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("qid", "chunk_id", "score", "matched_terms", "selected_terms", "exact_qualified", "path", "qualified", "rank")


def control_lane(docs: DataFrame, query_terms: DataFrame, names: DataFrame, limit: int = lexical.CANDIDATES, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """First ``limit`` of each query's chunks that hold a token of it, by the control's ten keys: (qid, chunk_id, matched, rank).

    ``docs`` have chunk_id, length, symbol_words, body_words, path_words, qualified_words,
    symbol_words_only (the symbol's) and the keys start_byte, end_byte, qualified, sha, path;
    ``names`` are (qid, name_1, name_2), equal to an exact row's qualified and symbol's words.
    """
    docs = docs.where("chunk_id IS NOT NULL")
    terms = query_terms.select("qid", "term").distinct().groupBy("qid").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    queries = terms.join(names, "qid", "left").select("qid", "terms", "name_1", "name_2")
    columns = "qid long, chunk_id long, path_words string, start_byte long, end_byte long, qualified string, sha string, path string, matched long, path_matched boolean, exact_1 boolean, exact_2 boolean"
    best = _against(docs, queries, terms.select("qid").count(), _control_tile, limit, columns, rows, block)
    order = [F.desc("exact_1"), F.desc("exact_2"), F.desc("path_matched"), F.desc("matched"), "path_words", "start_byte", "end_byte", "qualified", "sha", "path"]
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= limit).select("qid", "chunk_id", "matched", "rank")

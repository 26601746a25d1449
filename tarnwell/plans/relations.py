"""The engine's relations over the driver's tables.

Each relation is a DataFrame builder and the same in SQL, under one name, so that a
plan can be run by Spark and checked by another engine. A plan in portable SQL
names relations as ``{name}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import text as X
from tarnwell.functions import vectors as V
from tarnwell.sources.published import published

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Data:
    """The tables of one folder and the relations over them, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.built = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.built:
            if name in TABLES:
                self.built[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in RELATIONS:
                self.built[name] = RELATIONS[name].build(self)
            else:
                raise AttributeError(name)
        return self.built[name]


@dataclass(frozen=True)
class Relation:
    build: Callable[[Data], DataFrame]
    sql: str


RELATIONS: dict[str, Relation] = {}


def relation(name: str, sql: str):
    def keep(build):
        RELATIONS[name] = Relation(build, sql)
        return build

    return keep


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_0-9]+)\}", sql)))


def portable(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of portable SQL: its text is planned by Catalyst over the relations' DataFrames."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = Data(spark, sf_dir)
        frames = {n: getattr(data, n) for n in _names(sql)}
        text = sql.replace("LISTLEN(", "array_size(")
        return spark.sql(text, **frames) if frames else spark.sql(text)

    return run


def oracle(sql: str) -> str:
    """The SQL with its relations as common table expressions."""
    order: list[str] = []

    def need(text: str):
        for n in _names(text):
            if n not in order and n not in TABLES:
                need(RELATIONS[n].sql)
                if n not in order:
                    order.append(n)

    need(sql)
    fill = lambda text: re.sub(r"\{([a-z_0-9]+)\}", r"\1", text)
    body = fill(sql).replace("LISTLEN(", "len(").strip()
    parts = [f"{n} AS ({fill(RELATIONS[n].sql).strip()})" for n in order]
    if re.match(r"WITH\s", body):
        text = "WITH " + ", ".join([*parts, body[5:]]) if parts else body
    else:
        text = f"WITH {', '.join(parts)} {body}" if parts else body
    return _narrow(text)


def _narrow(sql: str) -> str:
    """count_if as a 64-bit integer, as Spark has it; the other engine counts in 128 bits."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 0, i + len("count_if")
        while True:
            depth += (sql[j] == "(") - (sql[j] == ")")
            j += 1
            if not depth:
                break
        out += [sql[at:i], "CAST(coalesce(count_if(", _narrow(sql[i + len("count_if(") : j - 1]), "), 0) AS BIGINT)"]
        at = j
    return "".join([*out, sql[at:]])


# --- files, chunks, symbols -------------------------------------------------------


@relation("files", "SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, sha256(text) AS sha, strlen(text) AS size FROM {documents}")
def _files(d: Data) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.documents.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("lang").alias("language"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.octet_length("text").cast("long").alias("size"))


@relation(
    "chunks",
    """SELECT doc_id AS chunk_id, doc_id AS file_id, source AS kind, coalesce(p_name, '') AS symbol,
    coalesce(p_brand || '.' || p_name, '') AS qualified, 0 AS start_byte, strlen(text) AS end_byte, text AS body
    FROM {documents} LEFT JOIN {part} ON p_partkey = doc_id""",
)
def _chunks(d: Data) -> DataFrame:
    both = d.documents.join(d.part, d.documents["doc_id"] == d.part["p_partkey"], "left")
    return both.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("kind"),
        F.coalesce("p_name", F.lit("")).alias("symbol"),
        F.coalesce(F.concat("p_brand", F.lit("."), "p_name"), F.lit("")).alias("qualified"),
        F.lit(0).alias("start_byte"),
        F.octet_length("text").cast("long").alias("end_byte"),
        F.col("text").alias("body"),
    )


@relation(
    "symbols",
    f"""SELECT chunk_id, original_name, {X.normalize_identifier_sql("original_name")} AS normalized_name FROM (
    SELECT chunk_id, symbol AS original_name FROM {{chunks}} WHERE symbol <> '' UNION SELECT chunk_id, qualified FROM {{chunks}} WHERE qualified <> '')""",
)
def _symbols(d: Data) -> DataFrame:
    names = d.chunks.select("chunk_id", F.explode(F.array_distinct(F.array("symbol", "qualified"))).alias("original_name")).where("original_name <> ''")
    return names.withColumn("normalized_name", X.normalize_identifier(F.col("original_name")))


@relation(
    "anchors",
    f"""SELECT qid, ord, raw, {X.normalize_identifier_sql("raw")} AS normalized, lane FROM (
    SELECT item_id AS qid, 1 AS ord, p_brand || '.' || p_name AS raw, 'symbol' AS lane FROM {{benchmark}} JOIN {{part}} ON p_partkey = item_id
    UNION ALL SELECT item_id, 2, p_name, 'symbol' FROM {{benchmark}} JOIN {{part}} ON p_partkey = item_id
    UNION ALL SELECT item_id, 1, item_id || '.txt', 'path' FROM {{benchmark}})""",
)
def _anchors(d: Data) -> DataFrame:
    named = d.benchmark.join(d.part, d.benchmark["item_id"] == d.part["p_partkey"])
    rows = (
        named.select(F.col("item_id").alias("qid"), F.lit(1).alias("ord"), F.concat("p_brand", F.lit("."), "p_name").alias("raw"), F.lit("symbol").alias("lane"))
        .unionAll(named.select("item_id", F.lit(2), "p_name", F.lit("symbol")))
        .unionAll(d.benchmark.select("item_id", F.lit(1), F.concat(F.col("item_id").cast("string"), F.lit(".txt")), F.lit("path")))
    )
    return rows.select("qid", "ord", "raw", X.normalize_identifier(F.col("raw")).alias("normalized"), "lane")


# --- query planning and lexical index ----------------------------------------------


@relation(
    "fragments",
    rf"""SELECT qid, pos, raw, {X.normalize_identifier_sql("raw")} AS normalized, {X.confidence_sql("raw")} AS confidence,
    contains(raw, '/') OR regexp_matches(lower(raw), '\.(go|ts|tsx)$') AS is_path FROM (
    SELECT item_id AS qid, unnest(regexp_extract_all(text, '{X.FRAGMENT}')) AS raw, generate_subscripts(regexp_extract_all(text, '{X.FRAGMENT}'), 1) - 1 AS pos FROM {{benchmark}})""".replace(r"\p{L}", r"\p{L}"),
)
def _fragments(d: Data) -> DataFrame:
    rows = d.benchmark.select(F.col("item_id").alias("qid"), F.posexplode(X.fragments(F.col("text"))).alias("pos", "raw"))
    raw = F.col("raw")
    return rows.select("qid", "pos", "raw", X.normalize_identifier(raw).alias("normalized"), X.confidence(raw).alias("confidence"), X.is_path(raw).alias("is_path"))


@relation(
    "query_terms",
    """SELECT qid, term, min(rank) AS rank FROM (
    SELECT qid, unnest(string_split(normalized, ' ')) AS term, CASE WHEN confidence = 'text' THEN 100000 ELSE 0 END + pos * 100 + generate_subscripts(string_split(normalized, ' '), 1) AS rank
    FROM {fragments}) WHERE term <> '' GROUP BY qid, term""",
)
def _query_terms(d: Data) -> DataFrame:
    # Identifier tokens come before text tokens; a repeated token keeps its first place.
    words = d.fragments.select("qid", "pos", "confidence", F.posexplode(F.split("normalized", " ")).alias("k", "term")).where("term <> ''")
    rank = F.when(F.col("confidence") == "text", 100_000).otherwise(0) + F.col("pos") * 100 + F.col("k") + 1
    return words.groupBy("qid", "term").agg(F.min(rank).cast("long").alias("rank"))


@relation(
    "index_rows",
    f"""SELECT chunk_id, {X.index_tokens_sql(X.normalize_identifier_sql("symbol || ' ' || qualified"))} AS symbol_tokens, {X.index_tokens_sql("body")} AS body_tokens FROM {{chunks}}""",
)
def _index_rows(d: Data) -> DataFrame:
    names = X.normalize_identifier(F.concat_ws(" ", "symbol", "qualified"))
    return d.chunks.select("chunk_id", X.index_tokens(names).alias("symbol_tokens"), X.index_tokens(F.col("body")).alias("body_tokens"))


@relation(
    "postings",
    """SELECT chunk_id, term, CAST(sum(s) AS BIGINT) AS tf_symbols, CAST(sum(b) AS BIGINT) AS tf_body FROM (
    SELECT chunk_id, unnest(symbol_tokens) AS term, 1 AS s, 0 AS b FROM {index_rows} UNION ALL SELECT chunk_id, unnest(body_tokens), 0, 1 FROM {index_rows})
    WHERE term IN (SELECT term FROM {query_terms}) GROUP BY chunk_id, term""",
)
def _postings(d: Data) -> DataFrame:
    return d.all_postings.join(d.query_terms.select("term").distinct(), "term", "left_semi").select("chunk_id", "term", "length", "tf_symbols", "tf_body")


@relation("all_postings", "SELECT * FROM {postings}")
def _all_postings(d: Data) -> DataFrame:
    """The inverted index of all chunks, made once and ordered by term; a plan reads what its terms need."""
    from tarnwell.operators.lexical import postings

    build = lambda: postings(d.index_rows).repartitionByRange("term").sortWithinPartitions("term")
    return published(d.spark, "postings", [f"{d.dir}/documents.parquet", f"{d.dir}/part.parquet"], build)


@relation("row_lengths", "SELECT chunk_id, len(symbol_tokens) + len(body_tokens) AS length FROM {index_rows}")
def _row_lengths(d: Data) -> DataFrame:
    from tarnwell.operators.lexical import row_lengths

    build = lambda: row_lengths(d.index_rows)
    return published(d.spark, "lengths", [f"{d.dir}/documents.parquet", f"{d.dir}/part.parquet"], build)


@relation("words", "SELECT chunk_id, array_to_string(symbol_tokens, ' ') AS symbol_words, array_to_string(body_tokens, ' ') AS body_words, len(symbol_tokens) + len(body_tokens) AS length FROM {index_rows}")
def _words(d: Data) -> DataFrame:
    """The indexed words of all rows, made once; what all queries match is found in tiles of them."""

    def build() -> DataFrame:
        names = X.normalize_identifier(F.concat_ws(" ", "symbol", "qualified"))
        # Dealt to tasks by number, as a table of chunks may be a single split.
        rows = d.chunks.select("chunk_id", "symbol", "qualified", "body").repartition("chunk_id")
        rows = rows.select("chunk_id", X.index_tokens(names).alias("symbol_tokens"), X.index_tokens(F.col("body")).alias("body_tokens"))
        length = F.size(F.coalesce("symbol_tokens", F.array())) + F.size(F.coalesce("body_tokens", F.array()))
        words = [F.array_join(f"{c}_tokens", " ").alias(f"{c}_words") for c in ("symbol", "body")]
        return rows.select("chunk_id", *words, length.cast("long").alias("length"))

    return published(d.spark, "words", [f"{d.dir}/documents.parquet", f"{d.dir}/part.parquet"], build)


@relation("forward", "SELECT c.*, f.path, f.sha, array_to_string(r.symbol_tokens, ' ') AS symbol_words, array_to_string(r.body_tokens, ' ') AS body_words, len(r.symbol_tokens) + len(r.body_tokens) AS length FROM {index_rows} r JOIN {chunks} c ON c.chunk_id = r.chunk_id JOIN {files} f ON f.file_id = c.file_id")
def _forward(d: Data) -> DataFrame:
    """Every chunk with its file and its indexed words, made once; plans over many queries go through it in tiles."""

    def build() -> DataFrame:
        names = X.normalize_identifier(F.concat_ws(" ", "symbol", "qualified"))
        # Dealt to tasks by number, as a table of files may be a single split.
        rows = d.chunks.join(d.files.select("file_id", "path", "sha"), "file_id").repartition("chunk_id")
        rows = rows.withColumns({"symbol_tokens": X.index_tokens(names), "body_tokens": X.index_tokens(F.col("body"))})
        length = F.size(F.coalesce("symbol_tokens", F.array())) + F.size(F.coalesce("body_tokens", F.array()))
        words = [F.array_join(f"{c}_tokens", " ").alias(f"{c}_words") for c in ("symbol", "body")]
        return rows.select("chunk_id", "file_id", "symbol", "qualified", F.col("start_byte").cast("long").alias("start_byte"), "end_byte", "path", "sha", *words, length.cast("long").alias("length"))

    return published(d.spark, "forward", [f"{d.dir}/documents.parquet", f"{d.dir}/part.parquet"], build)


# --- vectors ------------------------------------------------------------------------

DIMENSIONS = 32
#: Every row whose id is divisible by this is a query, against all rows.
QUERY_STEP = 50
#: Vectors of one parent.
SEGMENTS = 10

_UNIT = f"list_transform(embedding[1:{DIMENSIONS}], lambda v: CAST(CAST(v AS DOUBLE) / len AS FLOAT))"


@relation(
    "vectors",
    f"""SELECT vec_id, parent, label, unit, scale, codes, CAST(sqrt(CAST(list_sum(list_transform(codes, lambda c: c * c)) AS DOUBLE)) * CAST(scale AS DOUBLE) AS FLOAT) AS norm FROM (
    SELECT *, list_transform(unit, lambda v: greatest(-127, least(127, CAST(round(CAST(v AS DOUBLE) / CAST(scale AS DOUBLE)) AS INT)))) AS codes FROM (
    SELECT *, CAST(list_max(list_transform(unit, lambda v: abs(CAST(v AS DOUBLE)))) / 127 AS FLOAT) AS scale FROM (
    SELECT vec_id, vec_id // {SEGMENTS} AS parent, label, {_UNIT} AS unit FROM (
    SELECT *, sqrt(list_reduce(list_transform(embedding[1:{DIMENSIONS}], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda a, b: a + b)) AS len FROM {{embeddings}}))))""",
)
def _vectors(d: Data) -> DataFrame:
    unit = d.embeddings.select("vec_id", F.expr(f"vec_id div {SEGMENTS}").alias("parent"), "label", V.reduce_and_normalize(F.col("embedding"), DIMENSIONS).alias("unit"))
    scaled = unit.withColumn("scale", V.scale_of(F.col("unit")))
    coded = scaled.withColumn("codes", V.codes_of(F.col("unit"), F.col("scale")))
    return coded.withColumn("norm", V.code_norm(F.col("codes"), F.col("scale")))


_CODE_DOT = "list_sum(list_transform(list_zip(q.codes, v.codes), lambda z: CAST(z[1] AS BIGINT) * z[2]))"


@relation(
    "scores",
    f"""SELECT q.vec_id AS qid, v.vec_id, v.parent, q.label AS query_label, v.label, round(greatest(-1.0, least(1.0,
    CAST({_CODE_DOT} AS DOUBLE) * CAST(q.scale AS DOUBLE) * CAST(v.scale AS DOUBLE) / (CAST(q.norm AS DOUBLE) * CAST(v.norm AS DOUBLE)))), 6) AS score
    FROM {{vectors}} v JOIN {{vectors}} q ON q.vec_id % {QUERY_STEP} = 0""",
)
def _scores(d: Data) -> DataFrame:
    from tarnwell.operators.vector import score_all

    v = d.vectors.select("vec_id", "parent", "label", "codes", "scale", "norm")
    return score_all(v.where(F.col("vec_id") % QUERY_STEP == 0), v)


_EXACT = "list_reduce(list_transform(list_zip(q.unit, v.unit), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)), lambda a, b: a + b)"


@relation(
    "exact_scores",
    f"""SELECT q.vec_id AS qid, v.vec_id, v.parent, q.label AS query_label, v.label, round({_EXACT}, 6) AS score
    FROM {{vectors}} v JOIN {{vectors}} q ON q.vec_id % {QUERY_STEP} = 0""",
)
def _exact_scores(d: Data) -> DataFrame:
    from tarnwell.operators.vector import score_exact

    v = d.vectors.select("vec_id", "parent", "label", "unit")
    return score_exact(v.where(F.col("vec_id") % QUERY_STEP == 0), v)

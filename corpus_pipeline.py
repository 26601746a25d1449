"""Corpus pipeline: toxicity, SimHash near-dedup, secret scans, source mixing, BPE.

Each stage reads all that its predecessor kept and returns what stays; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import bpe, mixing, near_copies, secret_scan, toxicity
from tarnwell.llm.common import remove, scope, stage, write

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go.

    Null and empty texts are scored as texts without words. Ids are not looked at, so
    repeated rows and rows without an id are judged by their text alone. An empty table
    stays empty; columns beyond those of documents are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs.select(*COLUMNS), labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingle-set similarity of 0.8 or more) one document stays.

    SimHash's trie join finds whom to compare, the sets decide. The document of the least
    doc_id stays, any id before none; of texts that share that id, the one of the least
    key. Only rows that are equal in doc_id and text are one document. Null and empty
    texts are copies of each other. An empty table stays empty; columns beyond those of
    documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    groups = near_copies.near_copies(docs)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    rows = groups.groupBy("doc_id", "key").agg(F.max(first).alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1")
    marked = stage(rows.select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "stays"), "marked")
    keyed = docs.withColumn("row_key", near_copies.text_key())
    # Most rows are told to stay by their key alone, so that their texts are not shuffled.
    keyed, clear = near_copies.parted_by(keyed, marked.select(F.col("of_key").alias("row_key")), "row_key")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key"))
    kept = clear.unionByName(keyed.join(marked.hint("merge"), same, "left_anti"))
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        # Only rows that repeat are gathered, so texts are not sorted for the others.
        kept = kept.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "row_key"]))
    return kept.select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with the secrets in their texts replaced and n_chars counted anew.

    A null text stays null, and so does its n_chars; an empty one stays empty. Repeated
    rows stay repeated, an empty table empty; columns beyond those of documents are dropped.
    """
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as many times as the mix takes half or more of its words, at most three times.

    In each shard of the mix only the two documents at the ends of its run of words are
    taken in part, so what a shard gives departs from its quota by at most half of these
    two. Documents without words (null or empty texts) stay once. Rows that are equal in
    all columns are mixed one by one, and so are rows that share a doc_id or have none. An
    empty table stays empty; columns beyond those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    # Rows of one key are equal, so it is enough to know how many of them stay.
    keyed = docs.withColumn("row_key", F.xxhash64(*COLUMNS))
    taken = mixing.mix(keyed.select(F.struct("doc_id", "row_key").alias("doc_id"), "text", "source"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    taken = taken.groupBy(F.col("doc_id.doc_id").alias("of_id"), F.col("doc_id.row_key").alias("of_key")).agg(F.sum(times).cast("int").alias("times"), F.count(F.lit(1)).alias("n"))
    taken = stage(taken.where("times > 0"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key"))
    # Sorted and merged at every size, as the takes of many documents can't be sent to all tasks.
    out = keyed.join(taken.where("n = 1").hint("merge"), same)
    repeated = taken.where("n > 1")
    if not repeated.isEmpty():
        once = keyed.join(repeated.select("of_id", "of_key"), same, "left_semi").dropDuplicates(["doc_id", "row_key"])
        out = out.unionByName(once.join(repeated, same))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, ids, n_tokens.

    Null and empty texts have no ids; repeated rows come back repeated, a null doc_id
    stays null, an empty table gives no rows; other columns are not read.
    """
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

#: The classifier and the byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        with scope(spark):
            after = step(spark, docs, sf_dir)
            path = write(after, name)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(after.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Evaluation datasets: nested JSON documents to long tables, and their guards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.schemas import DDL
from tarnwell.sources.config import strict_json

DATASET = f"schema_version int, version string, corpus_id string, cases array<struct<{', '.join(p.replace(' ', ':', 1) for p in DDL['case'].split(', '))}>>"


def check_text(text: str, known: set[str] | None = None) -> None:
    """Strictness that a columnar JSON reader lacks: unknown fields, duplicate keys, trailing data."""
    value = strict_json(text)
    if not isinstance(value, dict):
        raise ValueError("an object is expected")
    known = known or {"schema_version", "version", "corpus_id", "cases"}
    if extra := sorted(set(value) - known):
        raise ValueError(f"unknown fields: {extra}")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of one multi-line document, or of a folder of them; a malformed one fails."""
    docs = spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select("corpus_id", F.explode("cases").alias("c")).select("corpus_id", "c.*")


def spans(cases: DataFrame) -> DataFrame:
    """(id, group_id, alternative, path, content_sha256, qualified_symbol, start_byte, end_byte) of the required groups."""
    g = cases.select("id", F.explode("required_groups").alias("g")).select("id", F.col("g.id").alias("group_id"), F.posexplode("g.alternatives").alias("alternative", "a"))
    return g.select("id", "group_id", "alternative", F.explode("a.spans").alias("s")).select("id", "group_id", "alternative", "s.*")


def judgments(cases: DataFrame) -> DataFrame:
    """(id, span fields, grade, hard) of the judgments and hard negatives."""
    graded = cases.select("id", F.explode("judgments").alias("j")).select("id", "j.span.*", "j.grade", F.lit(False).alias("hard"))
    hard = cases.select("id", F.explode("hard_negatives").alias("h")).select("id", "h.span.*", F.lit(0).alias("grade"), F.lit(True).alias("hard"))
    return graded.unionByName(hard)


def violations(cases: DataFrame) -> DataFrame:
    """(id, violation): repeated ids, empty texts, answerable cases without a group, grades and ranges out of bounds."""
    rows = [
        cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("violation")),
        cases.where("text IS NULL OR trim(text) = ''").select("id", F.lit("empty text")),
        cases.where("answer_mode <> 'abstainable' AND coalesce(size(required_groups), 0) = 0").select("id", F.lit("no required group")),
        cases.where("answer_mode = 'abstainable' AND coalesce(size(required_groups), 0) > 0").select("id", F.lit("abstainable with groups")),
        judgments(cases).where("grade NOT BETWEEN 0 AND 2").select("id", F.lit("grade")),
        spans(cases).where("start_byte < 0 OR end_byte <= start_byte").select("id", F.lit("range")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def contained(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted spans with the rank of the first hit that holds them: equal identity, enclosing range.

    ``hits`` (id, path, content_sha256, qualified_symbol, hit_start, hit_end, rank).
    """
    keys = ["id", "path", "content_sha256", "qualified_symbol"]
    both = wanted.join(hits, keys, "left").withColumn("rank", F.when((F.col("hit_start") <= F.col("start_byte")) & (F.col("hit_end") >= F.col("end_byte")), F.col("rank")))
    return both.groupBy(*wanted.columns).agg(F.min("rank").alias("rank"))


def requirement_coverage(found: DataFrame, k: int) -> DataFrame:
    """(id, coverage, complete) at cutoff k: a group counts if one alternative has all its spans."""
    whole = found.groupBy("id", "group_id", "alternative").agg(F.min(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("w")).groupBy("id", "group_id").agg(F.max("w").alias("w"))
    return whole.groupBy("id").agg(F.avg("w").alias("coverage"), (F.min("w") == 1).alias("complete"))


def to_text(cases: list[dict], corpus: str = "c", version: str = "1") -> str:
    """A dataset document of plain cases."""
    return json.dumps({"schema_version": 1, "version": version, "corpus_id": corpus, "cases": cases}, ensure_ascii=False, indent=1)

"""Retrieval metrics over long rows: one row per query, cutoff and metric input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_cutoffs(ranked: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Each ranked row once for each cutoff k that it is within."""
    return ranked.withColumn("k", F.explode(F.array(*(F.lit(k) for k in cutoffs)))).where("rank <= k")


def case_metrics(cases: DataFrame, ranked: DataFrame, judgments: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Hit, recall, MRR, NDCG, hard-negative hit and returned count of every case and cutoff.

    ``cases`` (qid), ``ranked`` (qid, item, rank), ``judgments`` (qid, item, grade 0..2,
    hard boolean). Items are identities, so a repeated item counts at its first rank.
    Cases without a result keep zero-valued rows.
    """
    first = ranked.groupBy("qid", "item").agg(F.min("rank").alias("rank"))
    judged = first.join(judgments, ["qid", "item"], "left")
    gain = (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1.0)
    found = at_cutoffs(judged.withColumn("gain", gain), cutoffs).groupBy("qid", "k").agg(
        F.count_if(F.col("grade") == 2).alias("direct"),
        F.min(F.when(F.col("grade") == 2, F.col("rank"))).alias("first_rank"),
        F.sum("gain").alias("dcg"),
        F.coalesce(F.bool_or("hard"), F.lit(False)).alias("hard_hit"),
        F.count(F.lit(1)).alias("returned"),
    )
    best = judgments.where("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "item")))
    ideal = at_cutoffs(best.withColumn("rank", F.col("i")), cutoffs).groupBy("qid", "k").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1.0)).alias("idcg"))
    totals = judgments.groupBy("qid").agg(F.count_if(F.col("grade") == 2).alias("total"))
    rows = cases.select("qid").withColumn("k", F.explode(F.array(*(F.lit(k) for k in cutoffs)))).join(totals, "qid", "left").join(found, ["qid", "k"], "left").join(ideal, ["qid", "k"], "left")
    zero = F.lit(0.0)
    return rows.select(
        "qid",
        "k",
        F.coalesce(F.col("direct") > 0, F.lit(False)).alias("hit"),
        F.round(F.coalesce(F.when(F.col("total") > 0, F.coalesce("direct", F.lit(0)) / F.col("total")), zero), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first_rank"), zero), 6).alias("mrr"),
        F.round(F.coalesce(F.when(F.col("idcg") > 0, F.coalesce("dcg", zero) / F.col("idcg")), zero), 6).alias("ndcg"),
        F.coalesce("hard_hit", F.lit(False)).alias("hard_hit"),
        F.coalesce("returned", F.lit(0)).cast("long").alias("returned"),
    )

"""Fusion of ranked lanes by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(lanes: list[tuple[str, DataFrame]], key: str, limit: int | None, ties: list[str], columns: list[str] | None = None, k: int = RRF_K) -> DataFrame:
    """Fuse lanes of (qid, key, rank): a full outer join as one union and one aggregate.

    The score adds 1 / (k + rank) in the lanes' order; ties go by ``ties``, lanes'
    ranks with missing ones last, then by the key.
    """
    names = [n for n, _ in lanes]
    rows = None
    for name, lane in lanes:
        one = lane.select("qid", key, F.lit(name).alias("lane"), F.col("rank").cast("long").alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("qid", key).agg(*(F.min(F.when(F.col("lane") == n, F.col("rank"))).alias(f"{n}_rank") for n in names))
    score = None
    for n in names:
        part = F.coalesce(1.0 / (k + F.col(f"{n}_rank")), F.lit(0.0))
        score = part if score is None else score + part
    wide = wide.withColumn("score", F.round(score, 12))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *(F.col(f"{t}_rank").asc_nulls_last() for t in ties), key)
    out = wide.withColumn("rank", F.row_number().over(order))
    out = out.where(F.col("rank") <= limit) if limit else out
    return out.select("qid", key, *(f"{n}_rank" for n in names), "score", "rank")


def union_by_best(lanes: list[tuple[str, DataFrame]], key: str, limit: int | None = None) -> DataFrame:
    """Provider union: candidates of all lanes by their best rank, then by the lanes' own."""
    names = [n for n, _ in lanes]
    fused = fuse(lanes, key, None, names)
    best = F.least(*(F.coalesce(f"{n}_rank", F.lit(1 << 40)) for n in names))
    order = Window.partitionBy("qid").orderBy(best, *(F.col(f"{n}_rank").asc_nulls_last() for n in names), key)
    out = fused.withColumn("best_rank", best).withColumn("rank", F.row_number().over(order))
    out = out.where(F.col("rank") <= limit) if limit else out
    return out.select("qid", key, *(f"{n}_rank" for n in names), "best_rank", "rank")

"""Ordinal and tie ranks of whole lists, without one list in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``, the place of each row in its list (``keys``) by ``order``.

    ``bucket`` cuts a list into many parts whose ascending order agrees with ``order``.
    The parts are counted, the counts of a list added up, and rows numbered within their
    part, so that a long list is numbered by as many tasks as it has parts.
    """
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return rows.join(before, [*keys, "_bucket"]).withColumn(name, F.col("_before") + within).drop("_bucket", "_before")


def tie_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, tie_start, tie_end, n) of each different value: first and last place of its rows, greatest first."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("rows").over(upto)
    return counts.select(key, value, (end - F.col("rows") + 1).alias("tie_start"), end.alias("tie_end"), F.sum("rows").over(Window.partitionBy(key)).alias("n"))

"""Greedy packers: order-dependent folds over short ranked arrays.

A skipped row does not use up budget, so none of these is a running sum. Each is a
fold with a small state over the ordered array of one query or file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("items"))


def pack_bodies(ranked: DataFrame, budget: int) -> DataFrame:
    """Bodies under a byte budget: the parent if it fits, else the matched segment, else nothing.

    Takes (qid, rank, id, parent_bytes, segment_bytes nullable); ranked lists are
    cut to their return limit first, so an array holds some tens of rows. Returns
    (qid, rank, id, outcome, used_bytes).
    """
    items = _ordered(ranked, ["qid"], "rank", ["id", "parent_bytes", "segment_bytes"])
    kind = "array<struct<rank:bigint,id:bigint,outcome:string,used_bytes:bigint>>"
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        whole = x["parent_bytes"] <= s["left"]
        part = x["segment_bytes"].isNotNull() & (x["segment_bytes"] <= s["left"])
        used = F.when(whole, x["parent_bytes"]).when(part, x["segment_bytes"]).otherwise(F.lit(0)).cast("long")
        outcome = F.when(whole, F.lit("parent")).when(part, F.lit("segment")).when(x["segment_bytes"].isNull(), F.lit("no_matched_segment")).otherwise(F.lit("budget"))
        row = F.struct(x["rank"].cast("long").alias("rank"), x["id"].cast("long").alias("id"), outcome.alias("outcome"), used.alias("used_bytes"))
        return F.struct((s["left"] - used).alias("left"), F.concat(s["out"], F.array(row)).alias("out"))

    return items.select("qid", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("o")).select("qid", "o.*")


def pack_count_bytes(rows: DataFrame, keys: list[str], count: int | Column, budget: int | Column) -> DataFrame:
    """Take rows in order while their number and bytes allow; a row too large is passed over.

    Takes (*keys, ord, id, bytes); returns the taken rows with the bytes used so far. The
    bounds may be columns of the keys, so that many cells are packed in one pass.
    """
    items = _ordered(rows, keys, "ord", ["id", "bytes"])
    kind = "array<struct<ord:bigint,id:bigint,total:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < count) & (s["used"] + x["bytes"] <= budget)
        used = (s["used"] + F.when(fits, x["bytes"]).otherwise(F.lit(0))).cast("long")
        row = F.struct(x["ord"].cast("long").alias("ord"), x["id"].cast("long").alias("id"), used.alias("total"))
        return F.struct((s["n"] + F.when(fits, 1).otherwise(0)).cast("long").alias("n"), used.alias("used"), F.when(fits, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    return items.select(*keys, F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("o")).select(*keys, "o.*")


def pack_clusters(rows: DataFrame, keys: list[str], files: int | Column, budget: int | Column) -> DataFrame:
    """The same with a bound on distinct files instead of rows; takes (*keys, ord, id, path, bytes)."""
    items = _ordered(rows, keys, "ord", ["id", "path", "bytes"])
    kind = "array<struct<ord:bigint,id:bigint,total:bigint>>"
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        seen = F.array_union(s["seen"], F.array(x["path"]))
        fits = (F.size(seen) <= files) & (s["used"] + x["bytes"] <= budget)
        used = (s["used"] + F.when(fits, x["bytes"]).otherwise(F.lit(0))).cast("long")
        row = F.struct(x["ord"].cast("long").alias("ord"), x["id"].cast("long").alias("id"), used.alias("total"))
        return F.struct(F.when(fits, seen).otherwise(s["seen"]).alias("seen"), used.alias("used"), F.when(fits, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"))

    return items.select(*keys, F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("o")).select(*keys, "o.*")


def _groups(sizes, most: int, budget: int) -> list[int]:
    out, group, n, used = [], 0, 0, 0
    for size in sizes:
        if n and (n >= most or used + size > budget):
            group, n, used = group + 1, 0, 0
        n, used = n + 1, used + size
        out.append(group)
    return out


def next_fit(items: Column, size: str, most: int, budget: int) -> Column:
    """Group numbers, from 0, of an ordered array of structs: a group closes when the next item does not fit.

    One pass over the sizes in an Arrow batch; a fold of SQL would copy its output at each item.
    """

    @F.pandas_udf("array<int>")
    def groups(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda a: _groups(a.tolist(), most, budget), na_action="ignore")

    return groups(F.transform(items, lambda x: x[size].cast("long")))

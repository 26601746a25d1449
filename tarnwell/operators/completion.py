"""Completion of a query's primary rows: contract closures and relation hints, admitted in order.

A candidate is looked at in order and advances the counters only if it is admitted. As
no refusal depends on how full a budget is, an admission is a rank within a key, and
the counters are running sums over the admitted rows: windows over one query, whose
facts are those at its few primary rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.operators.traits import closure_class

# Budgets in rows and bytes that a running total is held against.
COUNT_BUDGETS = (1, 2, 4, 8)
BYTE_BUDGETS = (1024, 2048, 4096, 8192)


def budgets(value: Column, grid: tuple[int, ...]) -> Column:
    """The budgets of a grid that a total is within, comma-joined; null for a null total."""
    fits = F.filter(F.array(*map(F.lit, grid)), lambda b: value <= b)
    return F.when(value.isNotNull(), F.array_join(F.transform(fits, lambda b: b.cast("string")), ","))


def closures(facts: DataFrame, primary: DataFrame, parents: DataFrame) -> DataFrame:
    """What the declared types of a query's primary rows lead to, admitted once per primary and once per request.

    ``facts`` (source, target, occ_id, kind, zone, role, ordinal), ``primary`` (qid, node,
    rank), ``parents`` (node, file_role, bytes). Facts are taken by the primary's rank,
    the source ordinal and the id. Returns qid, primary, target, occ_id, role_class,
    omission (null for what the request admits), the ordinals within primary and request,
    the request's bytes so far and the budgets that these are within.
    """
    p = primary.select("qid", F.col("node").alias("primary"), "rank")
    typed = facts.where("kind = 'TYPE_REF' AND zone IN ('SIGNATURE', 'TYPE_BODY')")
    rows = typed.join(p, F.col("source") == F.col("primary")).select("qid", "primary", "rank", "target", "occ_id", "ordinal", closure_class(F.col("role")).alias("role_class"))
    own = primary.select(F.col("qid").alias("p_qid"), F.col("node").alias("p_node"))
    rows = rows.join(own, (F.col("qid") == F.col("p_qid")) & (F.col("target") == F.col("p_node")), "left")
    t = parents.select(F.col("node").alias("t_node"), "file_role", "bytes")
    rows = rows.join(t, F.col("target") == F.col("t_node"), "left")
    refused = (
        F.when(F.col("role_class").isNull(), "ROLE_NOT_CONTRACT")
        .when(F.col("primary") == F.col("target"), "SELF_CYCLE")
        .when(F.col("p_node").isNotNull(), "ALREADY_PRIMARY")
        .when(F.col("t_node").isNull(), "MISSING_TARGET_PARENT")
        .when(F.col("file_role") != "PRODUCTION", "TARGET_NOT_PRODUCTION")
        .when(F.col("bytes") <= 0, "BODY_INCOMPLETE")
    )
    rows = rows.withColumn("refused", refused)
    order = ["rank", "ordinal", "occ_id"]
    open_ = F.col("refused").isNull()
    first = F.row_number().over(Window.partitionBy("qid", "primary", "target", open_).orderBy(*order))
    rows = rows.withColumn("by_primary", open_ & (first == 1))
    again = F.row_number().over(Window.partitionBy("qid", "target", "by_primary").orderBy(*order))
    rows = rows.withColumn("by_request", F.col("by_primary") & (again == 1))
    upto = lambda *key: Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda flag, value, *key: F.when(F.col(flag), F.sum(F.when(F.col(flag), value).otherwise(0)).over(upto(*key)))
    rows = rows.withColumns(
        {
            "primary_ordinal": total("by_primary", F.lit(1), "qid", "primary"),
            "request_ordinal": total("by_request", F.lit(1), "qid"),
            "request_bytes": total("by_request", F.col("bytes"), "qid"),
        }
    )
    omission = F.coalesce("refused", F.when(~F.col("by_primary"), "DUPLICATE_TARGET_PARENT_PRIMARY"), F.when(~F.col("by_request"), "DUPLICATE_TARGET_PARENT_REQUEST"))
    return rows.select(
        "qid",
        "primary",
        "target",
        "occ_id",
        F.coalesce("role_class", F.lit("UNDECLARED_SIGNATURE_ROLE")).alias("role_class"),
        omission.alias("omission"),
        "primary_ordinal",
        "request_ordinal",
        "request_bytes",
        budgets(F.col("request_ordinal"), COUNT_BUDGETS).alias("within_counts"),
        budgets(F.col("request_bytes"), BYTE_BUDGETS).alias("within_bytes"),
    )


def hints(frontier: DataFrame, primary: DataFrame, scores: DataFrame) -> DataFrame:
    """Hints at what the frontier leads to, best endpoint first, with the bytes that they take when written out.

    ``frontier`` (qid, endpoint, kind, direction, tier, n, rank), ``primary`` (qid, node),
    ``scores`` (qid, node, score). Endpoints that are primary rows give no hint. Views of
    one endpoint, kind, direction and tier are one hint. Returns qid, endpoint, kind,
    direction, tier, n, line, place, bytes (so far) and the budgets that these are within.
    """
    own = primary.select("qid", F.col("node").alias("endpoint"))
    rows = frontier.join(own, ["qid", "endpoint"], "left_anti").groupBy("qid", "endpoint", "kind", "direction", "tier").agg(F.sum("n").alias("n"), F.min("rank").alias("rank"))
    rows = rows.join(scores.select("qid", F.col("node").alias("endpoint"), "score"), ["qid", "endpoint"], "left")
    line = F.concat_ws(" ", F.col("endpoint").cast("string"), "kind", "direction", "tier", F.col("n").cast("string"))
    rows = rows.withColumn("line", line)
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "endpoint", "rank", "kind", "direction", "tier")
    place = F.row_number().over(order)
    upto = F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"place": place, "bytes": upto})
    return rows.select("qid", "endpoint", "kind", "direction", "tier", "n", "line", "place", "bytes", budgets(F.col("place"), COUNT_BUDGETS).alias("within_counts"), budgets(F.col("bytes"), BYTE_BUDGETS).alias("within_bytes"))

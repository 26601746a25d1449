"""Relation graph: edges, statistics, one-hop expansion, frontier and its selection."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.operators.traits import structural_tier, tier_place


def edges(occurrences: DataFrame) -> DataFrame:
    """Distinct resolved edges without self-loops: occurrences, least occurrence id, roles."""
    kept = occurrences.where("source <> target AND outcome = 'RESOLVED_UNIQUE'").withColumn("tier", structural_tier(F.col("kind"), F.col("zone")))
    return kept.groupBy("source", "target", "kind", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("occ_id").alias("best_id"), F.countDistinct("role").alias("roles"))


def dangling(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, missing) for each end of an edge that ``nodes`` (node) lacks."""
    lost = lambda end: edge_rows.join(nodes, F.col(end) == F.col("node"), "left_anti").select("source", "target", F.lit(end).alias("missing"))
    return lost("source").unionByName(lost("target"))


def one_hop(edge_rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges of each seed in both directions: (qid, seed, other, direction, ..).

    The OR over both ends is a union of two equi-joins. An edge from a seed to
    itself shows once, as REVERSE.
    """
    cols = [c for c in edge_rows.columns if c not in ("source", "target")]
    s = seeds.select("qid", "seed")
    out = edge_rows.where("source <> target").join(s, F.col("source") == F.col("seed")).select("qid", "seed", F.col("target").alias("other"), F.lit("FORWARD").alias("direction"), *cols)
    back = edge_rows.join(s, F.col("target") == F.col("seed")).select("qid", "seed", F.col("source").alias("other"), F.lit("REVERSE").alias("direction"), *cols)
    return out.unionByName(back)


def statistics(edge_rows: DataFrame) -> DataFrame:
    """Each edge with its strata: of its source, kind and tier the occurrences and targets, of its target the same."""
    out = Window.partitionBy("source", "kind", "tier")
    back = Window.partitionBy("target", "kind", "tier")
    return edge_rows.withColumns(
        {"source_n": F.sum("n").over(out), "source_targets": F.count(F.lit(1)).over(out), "target_n": F.sum("n").over(back), "target_sources": F.count(F.lit(1)).over(back)}
    )


def share_key() -> Column:
    """n / source_n as an integer that orders fractions exactly while the product of two denominators is below 10^18."""
    return F.expr("(CAST(n AS DECIMAL(19, 0)) * CAST(1000000000000000000 AS DECIMAL(19, 0))) div CAST(source_n AS DECIMAL(20, 0))")


def edge_order() -> list[Column]:
    """Order of edge views: direction, tier, share of the source, how few targets and sources, anchor, endpoint's rank, best occurrence."""
    return [
        F.asc("mismatch"),
        tier_place(F.col("tier")).asc(),
        share_key().desc(),
        F.asc("source_targets"),
        F.asc("target_sources"),
        F.asc("target_n"),
        F.asc("anchor"),
        F.asc("endpoint_rank"),
        F.asc("best_id"),
        F.asc("source"),
        F.asc("target"),
        F.asc("kind"),
    ]


def views(edge_rows: DataFrame, anchors: DataFrame, dense: DataFrame, most_dense: int = 20) -> DataFrame:
    """Edges at each query's anchors, seen from the anchor: both directions, without loops.

    ``anchors`` has qid, node, anchor (1, 2) and wanted (the query's direction); ``dense``
    has qid, node and rank. A bridge is an edge whose ends are the query's two anchors.
    """
    a = anchors.select("qid", "node", "anchor", "wanted")
    plain = edge_rows.where("source <> target")
    seen = [
        plain.join(a, F.col(mine) == F.col("node")).select("qid", "anchor", "wanted", F.col("node"), F.col(other).alias("endpoint"), F.lit(direction).alias("direction"), *edge_rows.columns)
        for mine, other, direction in (("source", "target", "FORWARD"), ("target", "source", "REVERSE"))
    ]
    rows = seen[0].unionByName(seen[1])
    pairs = anchors.groupBy("qid").agg(F.array_sort(F.collect_set("node")).alias("pair"))
    ranks = dense.select(F.col("qid").alias("of"), F.col("node").alias("at"), F.col("rank").alias("endpoint_rank"))
    rows = rows.join(pairs, "qid").join(ranks, (F.col("qid") == F.col("of")) & (F.col("endpoint") == F.col("at")), "left").drop("of", "at")
    both = (F.size("pair") == 2) & (F.col("pair") == F.array_sort(F.array("source", "target")))
    return rows.select(
        *(c for c in rows.columns if c not in ("pair", "wanted", "endpoint_rank")),
        F.when(F.col("wanted") == F.col("direction"), 0).otherwise(1).alias("mismatch"),
        F.coalesce("endpoint_rank", F.lit(most_dense + 1)).alias("endpoint_rank"),
        F.col("endpoint_rank").isNotNull().alias("dense"),
        both.alias("bridge"),
    )


def frontier(view_rows: DataFrame, per_bucket: int = 2) -> DataFrame:
    """Top ``per_bucket`` views of each (qid, anchor, direction, tier) bucket, then each edge once, ranked.

    Two anchors, two directions and four tiers bound a query to 32 edges. A bridge that
    the tops of both its buckets leave out takes the last place in the first of them. A
    bucket has one bridge at most, since a tier has one kind, so none lacks a place.
    """
    bucket = Window.partitionBy("qid", "anchor", "direction", "tier")
    edge = Window.partitionBy("qid", "source", "target", "kind", "tier")
    rows = view_rows.withColumn("bucket_rank", F.row_number().over(bucket.orderBy(*edge_order())))
    # Does any of a bridge's views survive by itself? If not its first view is reserved a place.
    rows = rows.withColumn("view", F.row_number().over(edge.orderBy(*edge_order()))).withColumn("safe", F.min("bucket_rank").over(edge) <= per_bucket)
    reserved = F.col("bridge") & ~F.col("safe") & (F.col("view") == 1)
    first = F.when(reserved | (F.col("bridge") & (F.col("bucket_rank") <= per_bucket)), 0).otherwise(1)
    rows = rows.withColumn("place", F.row_number().over(bucket.orderBy(first, *edge_order()))).where(F.col("place") <= per_bucket)
    rows = rows.withColumn("k", F.row_number().over(edge.orderBy(*edge_order()))).where("k = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*edge_order()))).drop("view", "safe", "place", "k")


def select_edge(frontier_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The edge that each of three policies takes of a query's frontier, or why it abstains.

    cap_only takes the first; bridge the first that joins the two anchors; graph_only
    that bridge, else the one edge that no other of its tier dominates among those seen
    forward to endpoints outside the dense ranks, if exactly one is left over all tiers.
    Returns qid, policy, outcome, source, target, kind, tier.
    """
    edge = F.struct("rank", "source", "target", "kind", "tier")
    own = frontier_rows.where("NOT bridge AND direction = 'FORWARD' AND NOT dense")
    fields = ("source", "target", "kind", "tier", "rank", "n", "source_n", "source_targets", "target_sources")
    a = own.select("qid", *fields)
    b = own.select(F.col("qid").alias("b_qid"), *(F.col(c).alias(f"b_{c}") for c in fields))
    # Fractions are compared by their cross products.
    mine, theirs = (F.expr(f"CAST({x} AS DECIMAL(19, 0)) * CAST({y} AS DECIMAL(19, 0))") for x, y in (("n", "b_source_n"), ("b_n", "source_n")))
    no_worse = (theirs >= mine) & (F.col("b_source_targets") <= F.col("source_targets")) & (F.col("b_target_sources") <= F.col("target_sources"))
    better = (theirs > mine) | (F.col("b_source_targets") < F.col("source_targets")) | (F.col("b_target_sources") < F.col("target_sources"))
    left = a.join(b, (F.col("qid") == F.col("b_qid")) & (F.col("tier") == F.col("b_tier")) & no_worse & better, "left_anti")
    found = frontier_rows.groupBy("qid").agg(F.min(edge).alias("first"), F.min(F.when(F.col("bridge"), edge)).alias("bridge"))
    alone = left.groupBy("qid").agg(F.count(F.lit(1)).alias("survivors"), F.min(edge).alias("winner"))
    rows = queries.select("qid").join(found, "qid", "left").join(alone, "qid", "left")
    n = F.coalesce("survivors", F.lit(0))
    graph_only = F.when(F.col("bridge").isNotNull(), F.struct(F.lit("DIRECT_BRIDGE").alias("outcome"), F.col("bridge").alias("edge"))).otherwise(
        F.struct(
            F.when(n == 0, F.lit("NO_CANDIDATE")).when(n == 1, F.lit("ONE_WINNER")).otherwise(F.lit("MULTIPLE_WINNERS")).alias("outcome"),
            F.when(n == 1, F.col("winner")).alias("edge"),
        )
    )
    one = lambda name, column, lost: F.struct(F.lit(name).alias("policy"), F.when(F.col(column).isNull(), F.lit(lost)).otherwise(F.lit("SELECTED")).alias("outcome"), F.col(column).alias("edge"))
    policies = F.array(one("cap_only", "first", "NO_FRONTIER_EDGE"), one("bridge", "bridge", "NO_DIRECT_ANCHOR_BRIDGE"), F.struct(F.lit("graph_only").alias("policy"), graph_only["outcome"].alias("outcome"), graph_only["edge"].alias("edge")))
    rows = rows.select("qid", F.explode(policies).alias("p"))
    return rows.select("qid", "p.policy", "p.outcome", "p.edge.source", "p.edge.target", "p.edge.kind", "p.edge.tier")


def pareto(rows: DataFrame, keys: list[str], up: list[str], down: str, ident: str) -> DataFrame:
    """Rows of each group that no other row dominates: as good in all of ``up`` (more) and in ``down`` (less), better in one.

    Of rows that are equal in ``up`` only those of the least ``down`` can stay, so a
    group is first reduced to one row for each combination of ``up``, of which even a
    group with very many rows has few; these are held against each other.
    """
    fields = [*keys, ident, *up, down]
    least = rows.groupBy(*keys, *up).agg(F.min(down).alias(down))
    a, b = least.alias("a"), least.alias("b")
    at = lambda s, c: F.col(f"{s}.{c}")
    same = reduce(and_, (at("a", c) == at("b", c) for c in keys))
    good = reduce(and_, (at("b", c) >= at("a", c) for c in up)) & (at("b", down) <= at("a", down))
    other = reduce(or_, (at("b", c) > at("a", c) for c in up))
    front = a.join(b, same & good & other, "left_anti")
    return rows.select(*fields).join(front, [*keys, *up, down], "left_semi").select(*fields)


def reserve_bridges(rows: DataFrame, capacity: int = 2) -> DataFrame:
    """Place bridges in their buckets: in a free place, else instead of the bucket's worst non-bridge.

    Takes (qid, bucket, id, rank, bridge); a bridge names the buckets it may use by
    rows of the same id. An overflow, a bridge that finds no place, makes the query
    abstain. The state spans buckets, so a query is one pandas group of a bounded
    frontier. Returns (qid, bucket, id, bridge, abstained).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        qid = pdf["qid"].iloc[0]
        taken: dict[str, list] = {}
        plain = pdf[~pdf["bridge"]].sort_values(["bucket", "rank", "id"])
        for b, g in plain.groupby("bucket", sort=True):
            taken[b] = [(r.rank, r.id, False) for r in g.head(capacity).itertuples()]
        abstained = False
        for ident, g in pdf[pdf["bridge"]].sort_values(["rank", "id", "bucket"]).groupby("id", sort=False):
            options = list(g["bucket"])
            free = [b for b in options if len(taken.get(b, [])) < capacity]
            if free:
                taken.setdefault(free[0], []).append((int(g["rank"].iloc[0]), ident, True))
                continue
            worst = sorted(((max(x for x in taken[b] if not x[2]), b) for b in options if any(not x[2] for x in taken[b])), reverse=True)
            if not worst:
                abstained = True
                continue
            gone, b = worst[0]
            taken[b].remove(gone)
            taken[b].append((int(g["rank"].iloc[0]), ident, True))
        out = [(qid, b, i, br, abstained) for b in sorted(taken) for _, i, br in sorted(taken[b])]
        return pd.DataFrame(out, columns=["qid", "bucket", "id", "bridge", "abstained"])

    slim = rows.select(F.col("qid").cast("long"), F.col("bucket").cast("string"), F.col("id").cast("long"), F.col("rank").cast("long"), "bridge")
    return slim.groupBy("qid").applyInPandas(one, "qid long, bucket string, id long, bridge boolean, abstained boolean")


def resolve_names(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Target of each reference by name and package: RESOLVED_UNIQUE, AMBIGUOUS or UNRESOLVED.

    An approximation without a type checker: definitions of the reference's package
    win over others; a target is given only where one definition is left.
    """
    near = definitions.groupBy(F.col("name").alias("d_name"), F.col("package").alias("d_package")).agg(F.count(F.lit(1)).alias("near"), F.min("def_id").alias("near_id"))
    far = definitions.groupBy(F.col("name").alias("f_name")).agg(F.count(F.lit(1)).alias("far"), F.min("def_id").alias("far_id"))
    rows = references.join(near, (F.col("name") == F.col("d_name")) & (F.col("package") == F.col("d_package")), "left").join(far, F.col("name") == F.col("f_name"), "left")
    rows = rows.withColumns({"near": F.coalesce("near", F.lit(0)), "far": F.coalesce("far", F.lit(0))})
    n = F.when(F.col("near") > 0, F.col("near")).otherwise(F.col("far"))
    outcome = F.when(n == 1, "RESOLVED_UNIQUE").when(n > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    target = F.when(n == 1, F.when(F.col("near") > 0, F.col("near_id")).otherwise(F.col("far_id")))
    return rows.select("ref_id", "name", "package", outcome.alias("outcome"), target.alias("target"))

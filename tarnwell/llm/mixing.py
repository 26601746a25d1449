"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

The mix is made of equal blocks of words, at most ``block`` of them and at least so few
that the least target has BLOCKS of them. Blocks go to sources by the
highest quotients target / (2k - 1), then, by the same rule, from a source to its
groups of shards and from a group to its shards, in proportion to the blocks these
hold. No apportionment has more than ``fan_out`` parties below the sources, so a
source with a third of all rows is spread over many shards, windows and tasks.

Within a shard the documents stand in a seeded random order, cut into equal
blocks; a quota of q blocks out of n is q div n whole passes plus a run of q mod n
blocks on the shard's ring from a seeded start. How many words of a document a run
covers is arithmetic on its interval, so no block is ever a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import stage, word_count

#: Weights by the rank of a source, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: The least target is made of so many blocks, so that a block is half a percent of it, or one word.
BLOCKS = 200
#: So many equal rows, and more, are numbered, so that they spread over the shards.
MANY = 4096
#: No target is above this many times its source's size.
CEILING = 3


def targets(sources: DataFrame, weights: Sequence[float] = CYCLE, ceiling: int = CEILING) -> DataFrame:
    """Add weight and target to (source, source_size): shares of all sizes by weight, up to the ceiling.

    Sharing the excess again and again ends where every open source has the same
    words per weight. Sources reach their ceiling in order of ceiling / weight, so
    that level follows from running sums over the (few) sources in this order.
    Sources rank by code point, null last.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    s = sources.withColumn("rank", F.row_number().over(ranked) - 1)
    s = s.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", (F.col("source_size") * ceiling).cast("double"))
    whole = Window.partitionBy()
    filling = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    s = s.withColumn("taken_most", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("taken_most")) / F.col("open_weight"))
    # The first source in this order that stays under its ceiling sets the level for all after it.
    s = s.withColumn("at", F.row_number().over(filling))
    under = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("at", "level"))
    s = s.withColumn("final", F.min(under).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, parent: Sequence[str], tie: Sequence[str], weight: str, seats: str, quota: str) -> DataFrame:
    """Add the integer ``quota``: each parent's ``seats`` go to its parties by highest quotients.

    With S parties of total weight T, the seats N can only end between the roundings
    of w (N - S/2) / T and w (N + S/2) / T, so of all quotients only about 3 S need
    ranking. Equal quotients go by ``tie``. Parties of no weight get none.
    """
    within = Window.partitionBy(*parent)
    p = parties.withColumn("_n", F.col(seats).cast("double"))
    p = p.withColumn("_t", F.sum(F.col(weight)).over(within).cast("double")).withColumn("_s", F.count(F.lit(1)).over(within))
    share = F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(F.lit(0.0))
    # One less and one more against rounding errors of the division.
    sure = F.greatest(F.lit(0), F.floor(share * (F.col("_n") - F.col("_s") / 2) + 0.5) - 1).cast("long")
    most = F.when(share > 0, F.greatest(F.lit(0), F.floor(share * (F.col("_n") + F.col("_s") / 2) + 0.5) + 1)).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("_sure", sure).withColumn("_most", most)
    p = p.withColumn("_left", (F.col("_n") - F.sum("_sure").over(within)).cast("long"))
    keys = [*parent, *tie]
    numbers = F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))
    q = p.select(*keys, "_left", weight, F.explode(numbers).alias("_k"))
    best = Window.partitionBy(*parent).orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc(), *(F.col(c).asc_nulls_last() for c in tie), "_k")
    won = q.withColumn("_at", F.row_number().over(best)).where("_at <= _left")
    won = won.groupBy(*(F.col(c).alias(f"_of_{c}") for c in keys)).agg(F.count(F.lit(1)).alias("_won"))
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        same = one if same is None else same & one
    p = p.join(won, same, "left")
    return p.select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(quota))


def _covered(upto: Column, start: Column, run: Column, words: Column) -> Column:
    """Words among the first ``upto`` of a ring of ``words`` that the run from ``start`` covers."""
    straight = F.greatest(F.lit(0), F.least(upto, start + run) - start)
    wrapped = F.least(upto, F.greatest(F.lit(0), start + run - words))
    return straight + wrapped


def numbered_copies(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``copy``: 0, and 0, 1, .. for the rows of a key that MANY rows or more share.

    The rows of such a key are counted in each partition and the counts added up, so no
    task orders more of them than a partition holds. Which of equal rows gets which
    number is left open, and no result depends on it.
    """
    many = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= MANY).drop("_rows"), "many")
    if many.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    of = many.select(*(F.col(k).alias(f"_of_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    some = stage(rows.withColumn("_at", F.spark_partition_id()).join(of, same, "left_semi"), "copies")
    counts = some.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_at").alias("_of_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy("_at"))
    some = some.withColumn("_within", within).join(counts, same & (F.col("_at") == F.col("_of_at")))
    some = some.select(*rows.columns, (F.col("_before") + F.col("_within") - 1).cast("long").alias("copy"))
    return rows.join(of, same, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(some)


def mix(docs: DataFrame, weights: Sequence[float] = CYCLE, ceiling: int = CEILING, block: int = 32, shard_words: int = 1 << 18, fan_out: int = 1024, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``taken`` is how many of the document's words the mix takes, repeats counted: 0
    to ``ceiling`` times its size. The order in a shard is by a seeded hash of
    doc_id, size and text, so reruns agree, and rows that share a doc_id or have none are
    spread like others; rows that are equal in all of these are told apart only by their
    position, which changes nothing but which of them is taken, and come back as often;
    MANY and more of these are numbered and spread over the shards. A null text has size
    0 and takes nothing; a null source is a source of its own, ranked last; a source
    without words has target 0. An empty table gives no rows. Only doc_id, text and
    source are read.
    """
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("of_text"))
    sizes = stage(sizes, "sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling)
    sources = sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    # One row for each source, all of which fit the windows above.
    whole = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / BLOCKS))).cast("long"))
    sources = sources.withColumn("_all", F.lit(0)).withColumn("_seats", F.round(F.sum("target").over(whole) / F.col("block")))
    sources = stage(sainte_lague(sources, ["_all"], ["source"], "target", "_seats", "blocks").drop("_all", "_seats"), "sources")
    at = sources.select(F.col("source").alias("of"), "n_shards")
    placed = sizes.join(at, sizes["source"].eqNullSafe(at["of"]), "left").drop("of")
    placed = numbered_copies(placed, ["source", "doc_id", "size", "of_text"])
    placed = placed.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size", "of_text")).drop("of_text")
    # Very many equal rows are spread by their number, others lie together.
    spread = F.expr("CASE WHEN copy = 0 THEN xxhash64(order) ELSE xxhash64(order, copy) END")
    placed = stage(placed.withColumn("shard", F.pmod(spread, F.col("n_shards")).cast("int")).drop("n_shards", "copy"), "placed")

    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    blocks = sources.select(F.col("source").alias("of"), "block")
    shards = shards.where("words > 0").join(blocks, shards["source"].eqNullSafe(blocks["of"])).drop("of")
    shards = shards.withColumn("n", F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long")).drop("block")
    shards = stage(shards.withColumn("part", F.expr(f"shard div {fan_out}").cast("int")), "shards")
    parts = shards.groupBy("source", "part").agg(F.sum("n").alias("part_n"))
    totals = shards.groupBy(F.col("source").alias("of")).agg((F.sum("n") * ceiling).alias("blocks_most"))
    seats = sources.select("source", "blocks").join(totals, F.col("source").eqNullSafe(F.col("of")))
    seats = seats.select(F.col("source").alias("of"), F.least("blocks", "blocks_most").alias("source_blocks"))
    parts = parts.join(seats, parts["source"].eqNullSafe(seats["of"])).drop("of")
    parts = sainte_lague(parts, ["source"], ["part"], "part_n", "source_blocks", "part_blocks")
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.least("part_blocks", F.col("part_n") * ceiling).alias("part_blocks"))
    shards = shards.join(parts, shards["source"].eqNullSafe(parts["of"]) & (shards["part"] == parts["of_part"])).drop("of", "of_part")
    shards = sainte_lague(shards, ["source", "part"], ["shard"], "n", "part_blocks", "q")
    q = F.least("q", F.col("n") * ceiling)
    extra, start = q % F.col("n"), F.expr(f"pmod(xxhash64({seed}, source, shard, 'start'), n)")
    # Block k starts at word k * words div n, so blocks are equal to within one word.
    shards = shards.select(
        F.col("source").alias("of"), F.col("shard").alias("of_shard"), "words", F.floor(q / F.col("n")).alias("passes"),
        F.expr("CAST(0 AS BIGINT)").alias("zero"), extra.alias("extra"), start.alias("start"), "n",
    )
    edge = lambda k: F.floor(k * F.col("words") / F.col("n"))
    first = edge(F.col("start"))
    last = F.when(F.col("start") + F.col("extra") <= F.col("n"), edge(F.col("start") + F.col("extra"))).otherwise(F.col("words") + edge(F.col("start") + F.col("extra") - F.col("n")))
    shards = stage(shards.select("of", "of_shard", "words", "passes", first.alias("run_start"), (last - first).alias("run")), "quotas")

    ring = Window.partitionBy("source", "shard").orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
    stream = placed.withColumn("end", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)))
    out = stream.join(shards, stream["source"].eqNullSafe(shards["of"]) & (stream["shard"] == shards["of_shard"]), "left")
    begin = F.col("end") - F.col("size")
    run = [F.col("run_start"), F.col("run"), F.col("words")]
    taken = F.col("passes") * F.col("size") + _covered(F.col("end"), *run) - _covered(begin, *run)
    known = sources.select(F.col("source").alias("of_source"), "source_size", "target")
    out = out.join(known, out["source"].eqNullSafe(known["of_source"]), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source", "shard")

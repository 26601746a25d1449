"""Near copies by exact Jaccard similarity of shingle sets.

Texts of equal shingle sets are one node. The trie self-join over SimHash fingerprints
of the sets finds candidates, with budgets well above what a near copy needs. Only nodes
of one component of the candidate links are compared, by their whole sets; a pair is left
out only if links found before connect it already.

A component of more than ``chunk`` nodes is compared in chunks. Its chunks are joined
within themselves, then one node of each group found stands for it; what still falls
into several groups is dealt out as pairs of chunks, without those that lie in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import connected_components, pieces, scope, small_batches, stage
from tarnwell.llm.simhash import SimHash, near_copy_search, near_pairs, set_fingerprints, shingle_hashes

#: Two texts are near copies if their shingle sets have this Jaccard similarity, as a fraction, or more.
AT_LEAST = (4, 5)
#: Nodes that one piece of work holds of either side.
CHUNK = 512
#: Words of 64 bits of the filter by which sets that no piece needs are left out before they are shuffled.
FILTER_WORDS = 1 << 18

_SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("fp", pa.binary())])
_SET = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])


def _node(s: np.ndarray) -> int:
    """A name of a shingle set."""
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _made(batches, p: SimHash, schema: pa.Schema, make):
    """Columns that ``make`` gives of each piece's shingle sets, behind those that the piece has."""
    for batch in batches:
        for b in pieces(batch):
            sets = [np.unique(shingle_hashes(t, p.width, p.seed)) for t in b.column("text").to_pylist()]
            node = pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64))
            own = [b.column(n) for n in schema.names if n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*own, node, pa.array([make(s) for s in sets], pa.binary())], schema=schema)


def _links(nodes: np.ndarray, groups: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what the near copies among ``sets`` connect, beyond their ``groups``.

    If there are two ``sides``, only pairs across them are compared.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    nodes, sides, size = nodes[order], sides[order], size[order]
    labels = np.unique(groups[order], return_inverse=True)[1]
    ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(size)])
    across, (over, under) = sides.min() != sides.max(), AT_LEAST
    held, links = np.zeros(len(ids), bool), []
    for i in range(1, len(nodes)):
        # A smaller set can be near only if its size alone allows it.
        low = int(np.searchsorted(size, -(-over * size[i] // under)))
        if low >= i:
            continue
        wanted = labels[low:i] != labels[i]
        if across:
            wanted &= sides[low:i] != sides[i]
        if not wanted.any():
            continue
        own = ids[start[i] : start[i + 1]]
        held[own] = True
        both = np.add.reduceat(held[ids[start[low] : start[i]]], start[low:i] - start[low], dtype=np.int64)
        held[own] = False
        for j in np.flatnonzero(wanted & ((over + under) * both >= over * (size[low:i] + size[i]))) + low:
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                links.append((nodes[i], nodes[j]))
    return links


def _compare(batches):
    """Links of the pieces of a partition that is sorted by piece; holds a batch and one piece."""

    def links(part: pd.DataFrame):
        out, piece = [], part[["root", "piece"]]
        low = np.flatnonzero((piece != piece.shift()).any(axis=1).to_numpy())
        for a, b in zip(low, [*low[1:], len(part)]):
            if b - a > 1:
                own = part.iloc[a:b]
                out += _links(own["node"].to_numpy(np.int64), own["grp"].to_numpy(np.int64), own["side"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in own["shingles"]])
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        last = int(np.flatnonzero((batch[["root", "piece"]] != batch[["root", "piece"]].shift()).any(axis=1).to_numpy())[-1])
        if last:
            yield links(batch.iloc[:last])
        held = batch.iloc[last:]
    if held is not None:
        yield links(held)


def parted_by(held: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``held`` whose ``key`` may be among ``rows``', rows whose key certainly isn't).

    Texts and sets are far larger than what says which are concerned, so they are held
    against a bit filter of bounded size first, and only what passes need be shuffled.
    """
    place = f"pmod(xxhash64({key}), {FILTER_WORDS * 64})"
    bits = lambda df: df.withColumns({"_word": F.expr(f"{place} div 64"), "_bit": F.expr(f"shiftleft(1L, CAST({place} % 64 AS INT))")})
    words = stage(bits(rows.select(key)).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "filter")
    # At most FILTER_WORDS rows of two longs are broadcast.
    marked = bits(held).join(F.broadcast(words), "_word", "left").withColumn("_hit", F.coalesce(F.expr("(_bits & _bit) <> 0"), F.lit(False)))
    return marked.where("_hit").select(*held.columns), marked.where("NOT _hit").select(*held.columns)


def _sets(slim: DataFrame, members: DataFrame, p: SimHash) -> DataFrame:
    """(node, shingles) of the members' nodes, made anew from the texts that are needed."""
    texts = parted_by(slim.select("key", "text"), members, "key")[0].select("text")
    made = small_batches(texts).mapInArrow(lambda batches: _made(batches, p, _SET, lambda s: s.tobytes()), "node long, shingles binary")
    return stage(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within the pieces of ``rows`` (root, piece, side, node, grp)."""
    # Sorted and merged at every size, as the sets of many rows can't be sent to all tasks.
    whole = rows.join(parted_by(sets, rows, "node")[0].hint("merge"), "node").select("root", "piece", "side", "node", "grp", "shingles")
    whole = whole.repartition("root", "piece").sortWithinPartitions("root", "piece")
    # Sets are as large as texts, so they too go through in small batches.
    return stage(small_batches(whole).mapInPandas(_compare, "a long, b long"), "links")


def _grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``grp``, the least node that the links lead to."""
    found = connected_components(links).select(F.col("node").alias("of"), F.col("root").alias("to"))
    return stage(members.drop("grp").join(found, F.col("node") == F.col("of"), "left").withColumn("grp", F.coalesce("to", "node")).drop("of", "to"), "members")


def _split(members: DataFrame) -> DataFrame:
    """The members of components that are still in several groups."""
    several = members.groupBy("root").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("root")
    return members.join(several, "root", "left_semi")


def _linked(members: DataFrame, sets: DataFrame, chunk: int) -> DataFrame:
    """``members`` (root, node) with the group ``grp`` that each node's near copies make."""
    one_piece = lambda rows: rows.withColumn("piece", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk)).cast("string")).withColumn("side", F.lit(0))
    sized = lambda rows: rows.join(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    members = stage(sized(members), "members").withColumn("grp", F.col("node"))
    links = _compared(one_piece(members), sets)
    members = _grouped(members, links)
    large = stage(_split(members.where(F.col("n") > chunk)).drop("n"), "large")
    if large.isEmpty():
        return members
    # One node a group stands for it: links between these join whole groups at once.
    links = links.unionByName(_compared(one_piece(sized(large.where("node = grp"))), sets))
    large = stage(_split(_grouped(large, links)), "large")
    # A group of a chunk or more has chunks of its own, which need no comparison among themselves.
    groups = large.groupBy("root", "grp").agg(F.count(F.lit(1)).alias("of_grp"))
    own = F.col("of_grp") >= chunk
    rest = groups.groupBy("root").agg(F.coalesce(F.sum(F.when(~own, F.col("of_grp"))), F.lit(0)).alias("rest"))
    parts = F.greatest(F.lit(1), F.ceil(F.when(own, F.col("of_grp")).otherwise(F.col("rest")) / chunk))
    name = F.concat_ws("-", F.when(own, F.col("grp").cast("string")).otherwise(F.lit("rest")), F.pmod(F.xxhash64("node"), parts).cast("string"))
    dealt = large.join(groups, ["root", "grp"]).join(rest, "root").withColumns({"chunk": name, "alone": F.when(own, F.col("grp"))}).select("root", "node", "grp", "chunk", "alone")
    dealt = stage(dealt, "dealt")
    chunks = dealt.groupBy("root", "chunk").agg(F.first("alone").alias("alone"))
    other = chunks.select(F.col("root").alias("of"), F.col("chunk").alias("chunk_b"), F.col("alone").alias("alone_b"))
    pairs = chunks.join(other, (F.col("root") == F.col("of")) & (F.col("chunk") <= F.col("chunk_b")))
    pairs = pairs.where("NOT coalesce(alone = alone_b, false)").select("root", "chunk", "chunk_b")
    pairs = stage(pairs.withColumn("piece", F.concat_ws(",", "chunk", "chunk_b")), "chunks")
    sides = pairs.select("root", "piece", F.col("chunk"), F.lit(0).alias("side")).unionByName(pairs.where("chunk < chunk_b").select("root", "piece", F.col("chunk_b").alias("chunk"), F.lit(1).alias("side")))
    links = links.unionByName(_compared(dealt.join(sides, ["root", "chunk"]), sets))
    return _grouped(members, links)


def text_key(text: str = "text"):
    """What tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.col(text).cast("string"))


def near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, component_id, key (of its text), component_key.

    Documents link if their sets of five-word shingles have a Jaccard similarity of
    AT_LEAST or more; ``component_id`` is the smallest doc_id reachable by links, itself
    included, and ``component_key`` the smallest key among that id's texts there. Texts
    without words are copies of each other. Repeated rows come back repeated. A null
    doc_id keeps its row; it is the component's id only if no document of the group has
    one. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    p = near_copy_search(docs.count())
    with scope(docs.sparkSession):
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("key"))
        prints = small_batches(slim).mapInArrow(lambda batches: _made(batches, p, _SKETCH, lambda s: set_fingerprints(s, p)), "doc_id long, key long, node long, fp binary")
        prints = stage(prints, "sketches")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        nodes = stage(prints.groupBy("node").agg(F.min(first).alias("least"), F.min("fp").alias("fp")), "nodes")
        roots = connected_components(stage(near_pairs(nodes.select("node", "fp"), p), "links"))
        members = stage(nodes.select("node", F.col("least.key").alias("key")).join(roots, "node"), "members")
        members = _linked(members.select("root", "node"), _sets(slim, members, p), chunk)
        linked = stage(nodes.select("node", "least").join(members.select("node", "grp"), "node"), "linked")
        least = stage(linked.groupBy("grp").agg(F.min("least").alias("group_least")), "least")
        moved = linked.join(least, "grp").select("node", "group_least")
        placed = nodes.join(moved, "node", "left").select("node", F.coalesce("group_least", "least").alias("first"))
        placed = stage(placed.select("node", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("component_key")), "components")
        out = prints.select("doc_id", "key", "node").join(placed, "node", "left")
        return stage(out.select("doc_id", "component_id", "key", "component_key"), "groups", keep=True)

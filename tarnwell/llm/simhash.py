"""SimHash near-duplicate groups through a binary trie self-join.

Fingerprints are leaves of a binary trie. The self-join walks pairs of trie nodes
of the same depth together, adds up the bits in which their paths differ, and
drops a pair as soon as that exceeds the Hamming budget.

Distribution: a pair within a budget of k bits agrees in full on one of k + 1
bit blocks (or, for ``lead_bits``, with some probability on each leading block).
For each block the bits are rotated so that the block comes first; in that
rotated trie the pair lies under one node of the block's depth, so the subtrees
at that depth are independent pieces of work. A subtree with more than
``chunk`` leaves is dealt out as pairs of chunks. Only spanning-forest links of
each piece leave it, never all pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import connected_components, hook, per_text, scope, stage

#: Leaves of one subtree that one piece of work holds; larger ones are split.
CHUNK = 4096
#: Leading blocks (some 24 bytes each) that are sent to all tasks.
SENT_BLOCKS = 250_000
#: Node pairs that the walk expands at a time.
FRONTIER = 1 << 18


@dataclass(frozen=True)
class SimHash:
    """Parameters of the fingerprints and of the join.

    ``words`` 64-bit fingerprints are taken of the ``width``-word shingles, the first
    of their XXH64 with ``seed``, each further one of the hashes mixed again. Two fingerprints are joined if one of their words
    differs in at most ``budget`` bits and all together in at most ``total_budget``.
    ``rotations`` leading blocks of ``lead_bits`` bits are tried for each word; more
    blocks than ``budget``, none overlapping, make the join complete. With ``distinct``
    a shingle that a text repeats counts once. ``total_budget`` is taken over a word and
    the ``checked`` - 1 that follow it, the first after the last.
    """

    width: int = 3
    seed: int = 42
    words: int = 1
    budget: int = 2
    total_budget: int = 2
    rotations: int = 3
    lead_bits: int = 21
    distinct: bool = False
    checked: int = 4

    @property
    def complete(self) -> bool:
        return self.words == 1 and self.rotations > self.budget and self.rotations * self.lead_bits <= 64


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of the A-Z-lowered words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    # Sums of 255 bits fit a byte, which adds many at a time.
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255].astype(">u8")
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _remixed(h: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of the same shingles: the splitmix64 finaliser, a bijection."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_fingerprints(h: np.ndarray, p: SimHash) -> bytes:
    """The fingerprints of an array of shingle hashes, one after the other."""
    out = []
    for i in range(p.words):
        out.append(fingerprint(h).to_bytes(8, "big"))
        h = _remixed(h) if i + 1 < p.words else h
    return b"".join(out)


def _text_fingerprints(text: str | None, p: SimHash) -> bytes:
    h = shingle_hashes(text, p.width, p.seed)
    return set_fingerprints(np.unique(h) if p.distinct else h, p)


def fingerprints(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """One row per document: doc_id, fp (binary, 8 bytes a word, most significant first).

    Null and empty texts have no shingle and the fingerprint zero.
    """
    return per_text(docs, {"fp": pa.binary()}, lambda: lambda texts: [[_text_fingerprints(t, p) for t in texts]])


def _as_words(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


class _Trie:
    """A forest of binary tries over one array of leaves; a node is a range of it.

    Each range given to ``walk`` must be sorted; ranges of different tries may
    follow one another in any order.
    """

    def __init__(self, leaves: np.ndarray):
        self.leaves, self.ones = leaves, {}

    def _ones_before(self, depth: int) -> np.ndarray:
        if depth not in self.ones:
            bit = (self.leaves >> np.uint64(63 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return self.ones[depth]

    def walk(self, roots: np.ndarray, depth: int, budget: int):
        """Yield leaf positions (i, j) within ``budget`` bits under the root pairs.

        ``roots`` has rows (low_a, high_a, low_b, high_b); a row whose two ranges are
        the same is a self-join. The paths agree down to ``depth``. The walk is depth
        first over blocks of node pairs, so its memory stays bounded; two single
        leaves are settled by one population count, which adds up the rest of both
        paths.
        """
        stack = [(depth, np.column_stack([roots, np.zeros(len(roots), np.int64)]).astype(np.int64))]
        while stack:
            at, pairs = stack.pop()
            if len(pairs) > FRONTIER:
                half = len(pairs) // 2
                stack += [(at, pairs[:half]), (at, pairs[half:])]
                continue
            la, ha, lb, hb, spent = pairs.T
            single = (ha - la == 1) & (hb - lb == 1)
            if single.any():
                i, j = la[single], lb[single]
                near = (np.bitwise_count(self.leaves[i] ^ self.leaves[j]) <= budget) & (i != j)
                if near.any():
                    yield i[near], j[near]
                pairs = pairs[~single]
                la, ha, lb, hb, spent = pairs.T
            if not len(pairs):
                continue
            if at == 64:
                yield from _products(pairs)
                continue
            ones = self._ones_before(at)
            ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
            twin = (la == lb) & (ha == hb)
            children = []
            for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
                a, b = ((la, ma) if x == 0 else (ma, ha)), ((lb, mb) if y == 0 else (mb, hb))
                keep = (a[0] < a[1]) & (b[0] < b[1])
                if x != y:
                    keep &= spent < budget
                if (x, y) == (1, 0):
                    keep &= ~twin
                children.append(np.column_stack([a[0], a[1], b[0], b[1], spent + (x != y)])[keep])
            children = np.concatenate(children)
            if len(children):
                stack.append((at + 1, children))


def _products(pairs: np.ndarray):
    """All (i, j) of the range pairs, whose leaves are equal in all bits, a block at a time."""
    la, ha, lb, hb = pairs[:, :4].T
    rows = np.repeat(np.arange(len(pairs)), ha - la)
    i = np.arange(len(rows)) - np.repeat(np.cumsum(ha - la) - (ha - la), ha - la) + la[rows]
    twin = (la == lb) & (ha == hb)
    low = np.where(twin[rows], i + 1, lb[rows])
    size = hb[rows] - low
    ends = np.cumsum(size)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONTIER, "right")))
        n = size[start:stop]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)
        yield np.repeat(i[start:stop], n), j
        start = stop


#: What makes up a piece of work; ``chunk_a`` and ``chunk_b`` differ for two chunks of one subtree.
PIECE = ["word", "rotation", "lead", "chunk_a", "chunk_b"]


def _join_pieces(rows: pd.DataFrame, p: SimHash) -> pd.DataFrame:
    """Links of the pieces in ``rows``, which are whole and follow one another, as a forest."""
    turn = rows["rotation"].to_numpy(np.int64)
    fps = _as_words(rows["fp"].tolist())
    by = (turn * p.lead_bits % 64).astype(np.uint64)
    own = fps[:, 0]
    back = np.where(by > 0, np.uint64(64) - by, np.uint64(0))
    key = np.where(by > 0, (own << by) | (own >> back), own)
    piece = np.cumsum((rows[PIECE] != rows[PIECE].shift()).any(axis=1).to_numpy())
    chunk, first = rows["chunk"].to_numpy(np.int64), rows["chunk_a"].to_numpy(np.int64)
    two = first != rows["chunk_b"].to_numpy(np.int64)
    side = np.where(two, chunk != first, 0)
    order = np.lexsort([key, side, piece])
    fps, key, piece, side, two = fps[order], key[order], piece[order], side[order], two[order]
    node = rows["node"].to_numpy(np.int64)[order]
    low = np.flatnonzero(np.diff(piece, prepend=-1) != 0)
    high = np.append(low[1:], len(piece))
    cut = low + np.add.reduceat((side == 0).astype(np.int64), low)
    two = two[low]
    roots = np.column_stack([low, np.where(two, cut, high), np.where(two, cut, low), high])
    roots = roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3])]
    labels = np.arange(len(node))
    for a, b in _Trie(key).walk(roots, p.lead_bits, p.budget):
        if p.words > 1:
            # What is connected already need not be looked at, however many copies there are.
            apart = np.flatnonzero(labels[a] != labels[b])
            a, b = a[apart], b[apart]
            near = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64) <= p.total_budget
            a, b = a[near], b[near]
        labels = hook(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return pd.DataFrame({"a": node[moved], "b": node[labels[moved]]})


def _join_sorted(batches, p: SimHash):
    """Join the pieces of a partition that is sorted by piece; holds a batch and one piece."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        last = int(np.flatnonzero((batch[PIECE] != batch[PIECE].shift()).any(axis=1).to_numpy())[-1])
        if last:
            yield _join_pieces(batch.iloc[:last], p)
        held = batch.iloc[last:]
    if held is not None and len(held) > 1:
        yield _join_pieces(held, p)


def near_pairs(nodes: DataFrame, p: SimHash = SimHash(), chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that span the near fingerprints of ``nodes`` (node long, fp binary, distinct)."""
    ranks = F.sequence(F.lit(0), F.lit(p.words * p.rotations - 1))
    rows = nodes.select("node", "fp", F.explode(ranks).alias("rank"))
    rows = rows.withColumns({"word": F.expr(f"rank div {p.rotations}").cast("int"), "rotation": F.expr(f"rank % {p.rotations}").cast("int")})
    rows = rows.withColumn("fp", F.expr(f"substring(concat(fp, fp), word * 8 + 1, {8 * min(p.checked, p.words)})"))
    rows = rows.withColumn("own", F.conv(F.hex(F.expr("substring(fp, 1, 8)")), 16, -10).cast("long"))
    rows = rows.withColumn("turn", (F.col("rotation") * p.lead_bits) % 64)
    turned = F.expr("CASE WHEN turn = 0 THEN own ELSE shiftleft(own, turn) | shiftrightunsigned(own, 64 - turn) END")
    rows = rows.withColumn("lead", F.shiftrightunsigned(turned, 64 - p.lead_bits)).select("word", "rotation", "lead", "node", "fp")
    # Most leading blocks hold one leaf, which links with nothing; only shared ones go on.
    shared = rows.groupBy("word", "rotation", "lead").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1")
    shared = stage(shared.select("word", "rotation", "lead", F.ceil(F.col("leaves") / chunk).cast("int").alias("chunks")), "shared")
    # The blocks are counted: few go to all tasks, so that the rows are shuffled once.
    shared = F.broadcast(shared) if shared.count() <= SENT_BLOCKS else shared
    rows = rows.join(shared, ["word", "rotation", "lead"])
    rows = rows.withColumn("chunk", F.expr("CAST(pmod(xxhash64(node), chunks) AS INT)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    rows = rows.withColumn("chunk_a", F.least("chunk", "other")).withColumn("chunk_b", F.greatest("chunk", "other"))
    rows = rows.select(*PIECE, "chunk", "node", "fp").repartition(*PIECE).sortWithinPartitions(*PIECE)
    return rows.mapInPandas(lambda batches: _join_sorted(batches, p), "a long, b long")


def near_duplicates(docs: DataFrame, p: SimHash = SimHash(), chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Documents link if their fingerprints are within the budget; ``component_id`` is
    the smallest doc_id reachable by links, itself included. Equal fingerprints are
    one node from the start, so copies cost nothing beyond their own row. Repeated
    rows come back repeated. A null doc_id keeps its row; it is the component's id
    only if no document of the group has one. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    with scope(docs.sparkSession):
        prints = stage(fingerprints(docs, p), "fingerprints", keep=True)
        distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
        nodes = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
        roots = stage(connected_components(stage(near_pairs(nodes.select("node", "fp"), p, chunk), "links")), "roots")
        # Only nodes with a link are in roots; each group takes the least id of its nodes.
        linked = stage(nodes.select("node", "least_id").join(roots, "node"), "linked")
        least = stage(linked.groupBy("root").agg(F.min("least_id").alias("group_id")), "least")
        moved = linked.select("node", F.col("root").alias("of")).join(least, F.col("of") == least["root"]).select("node", "group_id")
        placed = nodes.join(moved, "node", "left")
        placed = stage(placed.select(F.col("fp").alias("node_fp"), F.coalesce("group_id", "least_id").alias("component_id")), "components", keep=True)
    out = prints.join(placed, prints["fp"] == placed["node_fp"], "left")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Share of the bits in which two sets of shingle-set similarity 0.8 differ: acos(2j / (1 + j)) / pi.
APART = math.acos(1.6 / 1.8) / math.pi


def near_copy_search(documents: int, missed: float = 0.002) -> SimHash:
    """Settings by which the join finds pairs of shingle sets with a similarity of 0.8 or more.

    Such a pair agrees on a leading block of b bits with probability (1 - APART) ** b.
    The blocks grow with the logarithm of the number of documents, so that a subtree
    holds some hundreds of unlike leaves at any size, and there are as many blocks as
    leave less than ``missed`` of the pairs at 0.8 without one in common; of closer ones
    far less. The budgets lie well above the bits expected at 0.8 (8 of those behind a
    block, 39 of 256), so what is found is a candidate, to be compared exactly.
    """
    lead = min(32, max(12, round(math.log2(max(1, documents))) - 6))
    blocks = math.ceil(math.log(missed) / math.log(1 - (1 - APART) ** lead))
    words = max(4, math.ceil(blocks / (64 // lead)))
    return SimHash(width=5, words=words, budget=18, total_budget=64, rotations=64 // lead, lead_bits=lead, distinct=True)

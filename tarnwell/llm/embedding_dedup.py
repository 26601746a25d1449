"""Embedding near-dedup: int8 tile products with error bounds, full precision only near the threshold.

Unit vectors are quantised per vector, x = s q + e with integer q in -127..127. For
a pair, |x.y - s t (q.r)| <= |e| |t r| + |f|, where e and f are the two vectors'
quantisation errors, known from their own rows. A pair whose quantised product is
above the threshold by more than its bound is a link, one below by more is none,
and only the rest is computed again in double precision.

Equal vectors are one node from the start. Nodes are dealt to tiles and tiles to groups;
each pair of groups is one piece of work, in which every two tiles are multiplied. So a
tile is sent once for each group, not once for each tile. Only codes, scales and errors are shuffled to the pairs; a
tile's doubles are one file in the shared folder, which a piece opens where it has pairs
near the threshold. It returns sums of links per node and a spanning forest of its links,
never the links themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import connected_components, forget, hook, open_in, open_out, scope, shared_dir, stage

THRESHOLD = 0.95
#: Vectors of a tile, and the bytes of its doubles above which it holds fewer (but LEAST_TILE at least).
TILE, TILE_BYTES, LEAST_TILE = 16_384, 32 << 20, 1024
#: Tiles are put into groups of so many at most, once a tile would else be sent to more than COPIES pieces.
GROUP, COPIES = 16, 24
#: Rows of the left tile that are multiplied at a time.
STRIP = 256
#: Bound on rounding of the float32 product of exact integers and of its scaling, at unit length.
ROUNDING = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as float32 integers, scale, error norm) of the rows of x, which have unit length."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-12)
    return codes, scale, error


@dataclass
class Tile:
    """Quantised unit vectors; ``load`` gives them in double precision."""

    codes: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    load: Callable[[], np.ndarray]
    held: np.ndarray | None = None

    @classmethod
    def of(cls, units: np.ndarray) -> Tile:
        return cls(*quantise(units), lambda: units)

    def units(self, at: np.ndarray) -> np.ndarray:
        if self.held is None:
            self.held = self.load()
        return self.held[at]


def tile_links(x: Tile, y: Tile | None, threshold: float, strip: int = STRIP):
    """Yield (i, j, sure, checked) for strips of x against y (None: against itself, i < j only).

    i and j index linked pairs; ``checked`` counts pairs computed in double precision.
    """
    alone = y is None
    z = x if alone else y
    right = np.ascontiguousarray(z.codes.astype(np.float32).T)
    # |t r| <= 1 + |f|; the integer products stay below 2 ** 24, exact in float32, up to 1040 dimensions.
    reach = 1.0 + z.error
    widest, furthest = float(z.error.max(initial=0.0)), float(reach.max(initial=1.0))
    if x.codes.shape[1] > 1040:
        right = right.astype(np.float64)
    for at in range(0, len(x.codes), strip):
        rows = slice(at, min(at + strip, len(x.codes)))
        product = x.codes[rows].astype(right.dtype) @ right
        product *= z.scale.astype(right.dtype)
        # First by one bound for the whole row, then by each pair's own.
        least = (threshold - ROUNDING - x.error[rows] * furthest - widest) / x.scale[rows]
        flat = np.flatnonzero(product >= least[:, None].astype(right.dtype))
        i, j = np.divmod(flat, product.shape[1])
        value = product[i, j].astype(np.float64) * x.scale[rows][i]
        i = i + at
        if alone:
            upper = j > i
            i, j, value = i[upper], j[upper], value[upper]
        bound = x.error[i] * reach[j] + z.error[j] + ROUNDING
        sure = value - bound >= threshold
        near = ~sure & (value + bound >= threshold)
        ni, nj = i[near], j[near]
        exact = np.empty(len(ni), bool)
        for k in range(0, len(ni), 1 << 15):
            part = slice(k, k + (1 << 15))
            exact[part] = np.einsum("ij,ij->i", x.units(ni[part]), z.units(nj[part])) >= threshold
        yield np.concatenate([i[sure], ni[exact]]), np.concatenate([j[sure], nj[exact]]), int(sure.sum()), len(ni)


def _unit(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches):
    for b in batches:
        yield pd.DataFrame({"node": b["node"], "dim": b["dim"], "copies": b["copies"], "data": [np.asarray(v, "<f8").tobytes() for v in b["embedding"]]})


_TILE_ROW = "dim int, tile int, tiles int, nodes binary, copies binary, codes binary, scale binary, error binary, path string"


def _tile(rows: pd.DataFrame, folder: str) -> pd.DataFrame:
    """A tile as one row; its doubles go to a file, under a name of this attempt's own."""
    dim, tile = int(rows["dim"].iloc[0]), int(rows["tile"].iloc[0])
    units = _unit(rows["data"].tolist(), dim)
    path = f"{folder}/tile-{dim}-{tile}-{uuid.uuid4().hex[:8]}"
    with open_out(path) as out:
        out.write(units.astype("<f8").tobytes())
    codes, scale, error = quantise(units)
    held = rows["node"].to_numpy("<i8"), rows["copies"].to_numpy("<i8"), codes, scale.astype("<f8"), error.astype("<f8")
    return pd.DataFrame([(dim, tile, int(rows["tiles"].iloc[0]), *(a.tobytes() for a in held), path)], columns=[c.split()[0] for c in _TILE_ROW.split(", ")])


def _opened(row, dim: int) -> Tile:
    def load() -> np.ndarray:
        with open_in(row.path) as source:
            return np.frombuffer(source.read(), "<f8").reshape(-1, dim)

    return Tile(np.frombuffer(row.codes, np.int8).reshape(-1, dim), np.frombuffer(row.scale, "<f8"), np.frombuffer(row.error, "<f8"), load)


def _compare(piece: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the tiles of two groups, or within one: rows (node, links, root), root the piece's spanning forest."""
    piece = piece.sort_values("tile")
    dim, a, b = int(piece["dim"].iloc[0]), int(piece["a"].iloc[0]), int(piece["b"].iloc[0])
    nodes = [np.frombuffer(x, "<i8") for x in piece["nodes"]]
    copies = [np.frombuffer(x, "<i8") for x in piece["copies"]]
    tiles = [_opened(row, dim) for row in piece.itertuples()]
    groups = piece["group"].tolist()
    start = np.concatenate([[0], np.cumsum([len(n) for n in nodes])])
    ids, many = np.concatenate(nodes), np.concatenate(copies)
    links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    ids_of = lambda k: np.arange(start[k], start[k + 1])
    for x, left in enumerate(tiles):
        for y in range(x, len(tiles)):
            # Between two groups only pairs across them are compared.
            if a != b and groups[x] == groups[y]:
                continue
            # Links of the two tiles are united among themselves first.
            both = ids_of(x) if x == y else np.concatenate([ids_of(x), ids_of(y)])
            own, shift = np.arange(len(both)), 0 if x == y else len(nodes[x])
            for i, j, _, _ in tile_links(left, None if x == y else tiles[y], threshold):
                np.add.at(links, i + start[x], many[j + start[y]])
                np.add.at(links, j + start[y], many[i + start[x]])
                own = hook(own, i, j + shift)
            moved = np.flatnonzero(own != np.arange(len(own)))
            labels = hook(labels, both[moved], both[own[moved]])
            if y > x:
                tiles[y].held = None  # doubles of two tiles are held at a time
        left.held = None
    some = np.flatnonzero(links)
    return pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[labels[some]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows link at a cosine of ``threshold`` or more, in double precision; repeated
    vectors link with each other. Vectors that are null, empty, zero or hold a null
    or non-finite component, and vectors of different length, link with nothing. A
    null vec_id keeps its row; it is a component's id only if no row of it has one,
    and then kept is null. An empty table gives no rows. Columns other than vec_id
    and embedding are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(embedding, v -> v <> 0)")
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    with scope(vectors.sparkSession):
        distinct = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
        distinct = distinct.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")})
        nodes = stage(distinct, "vectors")
        # A number of tiles for each length of vector; lengths are few.
        room = F.least(F.lit(tile), F.greatest(F.lit(LEAST_TILE), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))
        tiles = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / room).cast("int").alias("tiles"))
        packed = nodes.select("node", "dim", "copies", "embedding").mapInPandas(_pack, "node long, dim int, copies long, data binary")
        dealt = packed.join(stage(tiles, "tiles"), "dim").withColumn("tile", F.expr("CAST(pmod(xxhash64(node), tiles) AS INT)"))
        folder = f"{shared_dir(vectors.sparkSession)}/tarnwell-doubles-{uuid.uuid4().hex}"
        forget(vectors.sparkSession, folder)
        whole = stage(dealt.groupBy("dim", "tile").applyInPandas(lambda r: _tile(r, folder), _TILE_ROW), "tiles")
        side = F.greatest(F.lit(1), F.least(F.lit(GROUP), F.expr(f"tiles div {COPIES}")))
        pairs = whole.withColumn("side", side).withColumn("group", F.expr("CAST(tile div side AS INT)"))
        pairs = pairs.withColumn("other", F.explode(F.expr("sequence(0, CAST((tiles - 1) div side AS INT))")))
        pairs = pairs.withColumns({"a": F.least("group", "other"), "b": F.greatest("group", "other")}).drop("other", "tiles", "side")
        found = pairs.groupBy("dim", "a", "b").applyInPandas(lambda p: _compare(p, threshold), "node long, links long, root long")
        found = stage(found, "links")
        roots = stage(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
        sums = found.groupBy("node").agg(F.sum("links").alias("links"))
        linked = stage(nodes.select("node", "least_id").join(roots, "node"), "linked")
        least = stage(linked.groupBy("root").agg(F.min("least_id").alias("group_id")), "least")
        moved = linked.select("node", F.col("root").alias("of")).join(least, F.col("of") == least["root"]).select("node", "group_id")
        known = nodes.join(sums, "node", "left").join(moved, "node", "left")
        known = known.select(
            F.col("embedding").alias("node_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("group_id", "least_id").alias("group_id"),
        )
        known = stage(known, "groups", keep=True)
    # Rows without a usable vector have nothing to look up and stay out of the join.
    found = rows.where("usable").join(known, F.col("embedding") == F.col("node_embedding"), "left")
    out = found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("group_id").alias("component_id"))
    out = out.unionByName(rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

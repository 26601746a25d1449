"""Helpers shared by the training-data operators: staging and connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A maximal run of characters other than space and U+0009..U+000D is a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only on a local master that has none configured."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tarnwell-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Bytes that a writer of a staged table holds before it closes a row group.
ROW_GROUP = 16 << 20

#: Paths staged within each scope that is open in this thread or task.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    where, files = _hadoop_path(spark, path)
    files.delete(where, True)


def forget(spark: SparkSession, path: str) -> None:
    """Have a folder deleted with the open scope, or else when the application ends."""
    where, files = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    if scopes := _scopes.get():
        scopes[-1].append(path)


def write(df: DataFrame, name: str, **options) -> str:
    """Write ``df`` to the shared folder; its path. It is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnwell-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).options(**options).parquet(path)
    where, files = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str, keep: bool = False, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: work above a staged table is neither repeated for a
    second reader nor lost with an executor. The schema is passed to the reader,
    so an empty table comes back with its columns. The table goes with the open
    ``scope``, or with the one around that if it is to be kept, else when the
    application ends.
    """
    path = write(df, name, **options)
    scopes = _scopes.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _arrow_path(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def open_out(path: str):
    """A file to write in the shared folder, local or in a store that Arrow knows."""
    system, where = _arrow_path(path)
    system.create_dir(os.path.dirname(where), recursive=True)
    return system.open_output_stream(where)


def open_in(path: str):
    """A file of the shared folder to read at any place."""
    system, where = _arrow_path(path)
    return system.open_input_file(where)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within, and not kept, are deleted at the end."""
    mine: list[str] = []
    before = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in mine:
            remove(spark, path)


#: Rows of whole texts that a Python worker gets at a time: at some kilobytes a text a few megabytes.
TEXT_ROWS = 1000


def small_batches(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """``df`` in a sibling of its session, whose Arrow batches have at most ``rows`` rows.

    The default of 10,000 rows of whole texts takes some 100 MB of each worker. The
    sibling has all settings of the caller's session, which itself stays as it is.
    """
    spark = df.sparkSession
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(own.conf.get(key))
    own.conf.set(key, min(now, rows) if now > 0 else rows)
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan), own)


#: Texts that a worker turns into Python strings at a time: at most so many, of so many bytes together if there are several.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20

_SPARK_NAMES = {
    pa.int32(): "int",
    pa.int64(): "long",
    pa.float64(): "double",
    pa.bool_(): "boolean",
    pa.string(): "string",
    pa.binary(): "binary",
    pa.list_(pa.int32()): "array<int>",
    pa.list_(pa.int64()): "array<long>",
}


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded rows and bytes of text; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        upto = int(np.searchsorted(ends, before + PIECE_BYTES, "right"))
        upto = min(max(upto, at + 1), at + PIECE_ROWS)
        yield batch.slice(at, upto - at)
        at = upto


def per_text(docs: DataFrame, columns: dict[str, pa.DataType], start: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """One row per document: doc_id, then ``columns`` as a function of the text gives them.

    ``start`` runs once a task and returns the function from a list of texts to a list
    of columns. doc_id stays an Arrow long, so that every id and null is exact. Whole
    texts go through in small batches and pieces.
    """
    schema = pa.schema([("doc_id", pa.int64()), *columns.items()])

    def run(batches):
        judge = None
        for batch in batches:
            for piece in pieces(batch):
                judge = judge or start()
                found = judge(piece.column("text").to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(found, columns.values())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *arrays], schema=schema)

    slim = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return slim.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {_SPARK_NAMES[t]}" for n, t in columns.items())]))


_held: dict = {}


def held(key, make: Callable):
    """What ``make`` gives, kept in this worker process for its later tasks.

    Only the last key's value is kept, so that a worker that serves several operators
    one after the other holds the tables and stores of one.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Store(dict):
    """Values of words, made when first asked for and kept in bounded memory.

    There are two generations: a full store becomes the older one, from which words
    that come again are taken over, so frequent words stay. Words over ``longest``
    characters are not kept.
    """

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    trimmed = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(trimmed)
    gaps = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(trimmed == "", F.lit(0)).otherwise(gaps + 1), F.lit(0)).cast("long")


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs (a[i], b[i]) in a min-label array; labels[x] <= x always holds."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _forest(batches):
    """Reduce the pairs of one partition to a spanning forest, a million pairs at a time."""
    kept = np.empty((0, 2), np.int64)

    def contract(pairs: np.ndarray) -> np.ndarray:
        ids, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(-1, 2)
        labels = hook(np.arange(len(ids)), at[:, 0], at[:, 1])
        moved = np.flatnonzero(labels != np.arange(len(ids)))
        return np.stack([ids[moved], ids[labels[moved]]], axis=1)

    held = [kept]
    size = 0
    for batch in batches:
        held.append(batch[["a", "b"]].to_numpy(np.int64))
        size += len(batch)
        if size >= 1_000_000:
            held, size = [contract(np.concatenate(held))], 0
    pairs = contract(np.concatenate(held))
    for at in range(0, len(pairs), 100_000):
        part = pairs[at : at + 100_000]
        yield pd.DataFrame({"a": part[:, 0], "b": part[:, 1]})


def connected_components(edges: DataFrame, finish_rows: int = 500_000) -> DataFrame:
    """Components of the pairs (a, b) of longs: one row (node, root) per node that has a pair.

    ``root`` is the smallest node reachable. Pairs are first contracted within
    their partitions. While more than ``finish_rows`` remain (a checked count,
    16 bytes a row), rounds of hooking and pointer jumping run as joins over all
    partitions; what is left at or below that bound is finished by one task.
    Pairs with a null or equal ends are ignored; no pairs give no rows.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = stage(pairs.mapInPandas(_forest, "a long, b long"), "pairs")
    nodes = None
    while pairs.count() > finish_rows:
        nodes, pairs = _round(nodes, pairs)
    tail = pairs.coalesce(1).mapInPandas(_forest, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    tail = stage(tail, "roots")
    roots = tail.select(F.col("root").alias("node"), "root").distinct()
    tail = tail.unionByName(roots)
    if nodes is None:
        return tail
    moved = tail.select(F.col("node").alias("at"), F.col("root").alias("to"))
    joined = nodes.join(moved, nodes["root"] == moved["at"], "left")
    return joined.select("node", F.coalesce("to", "root").alias("root"))


def _round(nodes: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: every node hooks onto its smallest neighbour, chains are shortened, pairs follow."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
    for _ in range(2):
        above = up.select(F.col("node").alias("at"), F.col("root").alias("to"))
        up = stage(up.join(above, up["root"] == above["at"], "left").select("node", F.coalesce("to", "root").alias("root")), "hooks")
    x = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    y = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    left = pairs.join(x, "a").join(y, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    left = stage(left.mapInPandas(_forest, "a long, b long"), "pairs")
    if nodes is None:
        return up, left
    above = up.select(F.col("node").alias("at"), F.col("root").alias("to"))
    nodes = nodes.join(above, nodes["root"] == above["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(nodes, "nodes"), left

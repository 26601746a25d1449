"""Review in stages: prepare, adopt, freeze, select. Every stage proves the one before by its digests.

A stage is a folder with its tables as Parquet and a ``stage.json`` that holds the
digest of each table's rows and of the stage before. A stage is opened by computing
these again, so a change of any row, of a digest or of the order of stages is refused.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.store import reconciled
from tarnwell.sources.config import canonical_json
from tarnwell.sources.promotion import rows_digest


class Refused(ValueError):
    """Inputs that do not prove the stage before."""


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _digest(state: dict) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in state.items() if k != "digest"}).encode()).hexdigest()


def _write(spark: SparkSession, folder: str, kind: str, tables: dict[str, DataFrame], before: str, **more) -> str:
    where, files = _file(spark, folder)
    if files.exists(where):
        raise FileExistsError(folder)
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    state = {"kind": kind, "before": before, "tables": {n: rows_digest(spark.read.parquet(f"{folder}/{n}")) for n in tables}, **more}
    state["digest"] = _digest(state)
    # Written last, so a stage that was not finished can't be opened.
    path, _ = _file(spark, f"{folder}/stage.json")
    out = files.create(path, False)
    try:
        out.write(bytearray(canonical_json(state).encode()))
    finally:
        out.close()
    return state["digest"]


def open_stage(spark: SparkSession, folder: str, kind: str, before: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """A stage's state and tables, if they are what the stage was written with and follow ``before``."""
    path, files = _file(spark, f"{folder}/stage.json")
    if not files.exists(path):
        raise Refused(f"{folder}: no finished stage")
    source = files.open(path)
    try:
        state = json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()
    if state["kind"] != kind or state["digest"] != _digest(state):
        raise Refused(f"{folder}: not a {kind} stage, or its state was changed")
    if before is not None and state["before"] != before:
        raise Refused(f"{folder}: does not follow the stage before")
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in state["tables"]}
    for name, rows in tables.items():
        if rows_digest(rows) != state["tables"][name]:
            raise Refused(f"{folder}/{name}: rows were changed")
    return state, tables


def prepare(packets: DataFrame, cells: DataFrame, folder: str) -> str:
    """Keep what is to be reviewed (qid, item, body_sha) and what each policy cell would send (cell, qid, item), before any label."""
    return _write(packets.sparkSession, folder, "prepared", {"packets": packets, "cells": cells}, "")


def _labels(prepared: dict[str, DataFrame], one: DataFrame, two: DataFrame) -> DataFrame:
    wanted = prepared["packets"].select("qid", "item").distinct()
    for rows in (one, two):
        given = rows.select("qid", "item")
        if not given.exceptAll(wanted).isEmpty() or not wanted.exceptAll(given).isEmpty():
            raise Refused("a pass must grade every packet once and nothing else")
    key = F.struct("qid", "item").alias("key")
    rows = reconciled(one.select(key, "grade", "grp"), two.select(key, "grade", "grp"), "key")
    return rows.select("key.qid", "key.item", "outcome", "label")


def to_adopt(spark: SparkSession, prepared: str, one: DataFrame, two: DataFrame) -> str:
    """The digest of the reconciled labels, which the owner adopts as a whole."""
    state, tables = open_stage(spark, prepared, "prepared")
    return hashlib.sha256(f"{state['digest']}\n{rows_digest(_labels(tables, one, two))}".encode()).hexdigest()


def freeze(spark: SparkSession, prepared: str, one: DataFrame, two: DataFrame, adopted: str, folder: str) -> str:
    """Freeze the labels of two passes (qid, item, grade, grp) that the owner adopted by their digest."""
    state, tables = open_stage(spark, prepared, "prepared")
    if to_adopt(spark, prepared, one, two) != adopted:
        raise Refused("these labels were not adopted")
    return _write(spark, folder, "frozen", {"labels": _labels(tables, one, two), "pass_one": one, "pass_two": two}, state["digest"], adopted=adopted)


def select(spark: SparkSession, prepared: str, frozen: str, folder: str) -> str:
    """Hold every policy cell against the frozen labels and write the outcomes by query and by cell."""
    before, tables = open_stage(spark, prepared, "prepared")
    state, labels = open_stage(spark, frozen, "frozen", before["digest"])
    if to_adopt(spark, prepared, labels["pass_one"], labels["pass_two"]) != state["adopted"]:
        raise Refused("the frozen labels were not adopted")
    rows = tables["cells"].join(labels["labels"], ["qid", "item"], "left")
    graded = lambda g: F.count_if(F.col("label") == g)
    counts = [F.count(F.lit(1)).alias("sent"), graded(2).alias("useful"), graded(1).alias("support"), graded(0).alias("noise"), F.count_if(F.col("label").isNull()).alias("unresolved")]
    by_query = rows.groupBy("cell", "qid").agg(*counts)
    by_cell = by_query.groupBy("cell").agg(F.count(F.lit(1)).alias("queries"), *(F.sum(c).alias(c) for c in ("sent", "useful", "support", "noise", "unresolved")))
    return _write(spark, folder, "selected", {"by_query": by_query, "by_cell": by_cell}, state["digest"])

"""Relational state: manifests, change plans, upserts, insert-or-ignore, garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest_digest(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted ``path NUL sha`` lines, and their number.

    A digest over an ordered list is one task's work by definition; a line is about
    a hundred bytes, so a manifest of a million files is 100 MB. ``manifest_tree``
    is the form for more.
    """
    line = F.concat("path", F.decode(F.unhex(F.lit("00")), "UTF-8"), "sha")
    rows = files.agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("l"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.sha2(F.encode(F.array_join(F.col("l.line"), "\n"), "UTF-8"), 256).alias("manifest"), "n")


def manifest_tree(files: DataFrame, buckets: int = 4096) -> DataFrame:
    """The digest in two levels: lines by a hash bucket of their path, then the buckets' digests."""
    line = F.concat("path", F.decode(F.unhex(F.lit("00")), "UTF-8"), "sha")
    rows = files.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))
    leaves = rows.select("bucket", F.sha2(F.encode("lines", "UTF-8"), 256).alias("digest"), "n")
    top = leaves.agg(F.array_sort(F.collect_list(F.struct("bucket", "digest"))).alias("d"), F.sum("n").alias("n"))
    return top.select(F.sha2(F.encode(F.array_join(F.col("d.digest"), "\n"), "UTF-8"), 256).alias("manifest"), "n")


def change_plan(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status): added, deleted, changed or reused, by path and content hash."""
    a, b = live.select("path", F.col("sha").alias("live_sha")), indexed.select("path", F.col("sha").alias("indexed_sha"))
    both = a.join(b, "path", "full")
    status = F.when(F.col("indexed_sha").isNull(), "added").when(F.col("live_sha").isNull(), "deleted").when(F.col("live_sha") == F.col("indexed_sha"), "reused").otherwise("changed")
    return both.select("path", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with ``new`` rows in place of those of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last by ``order``; one aggregate, no window over a hot key."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("r")).select(*keys, "r.*")


def insert_or_ignore(bank: DataFrame, new: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): known keys are left alone; another digest under one is a conflict."""
    known = bank.select(F.col(key).alias("known_key"), F.col(digest).alias("known_digest"))
    once = Window.partitionBy(key).orderBy(digest)
    fresh = new.join(known, new[key] == known["known_key"], "left_anti").withColumn("k", F.row_number().over(once)).where("k = 1").drop("k")
    conflicts = new.join(known, new[key] == known["known_key"]).where(F.col(digest) != F.col("known_digest")).select(key, digest, "known_digest")
    return fresh, conflicts


def embedding_state(keys: DataFrame, stored: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """(key, state): ready with a valid vector, failed after a terminal failure, else pending."""
    have = stored.where("valid").select(key).distinct().withColumn("have", F.lit(True))
    last = failures.groupBy(key).agg(F.max_by("terminal", "id").alias("terminal"))
    state = F.when(F.col("have"), "ready").when(F.col("terminal"), "failed").otherwise("pending")
    return keys.select(key).distinct().join(have, key, "left").join(last, key, "left").select(key, state.alias("state"))


def require_empty(rows: DataFrame, what: str) -> None:
    """Raise if a violation query has a row; only a few are fetched."""
    found = rows.take(3)
    if found:
        raise ValueError(f"{what}: {found}")


# Reasons for a search without vectors.
PAID_QUERY_DISABLED = "PAID_QUERY_DISABLED"
RECONCILIATION_REQUIRED = "PROFILE_RECONCILIATION_REQUIRED"
SNAPSHOT_INVALID = "VECTOR_SNAPSHOT_INVALID"
NO_VALID_VECTORS = "NO_VALID_DOCUMENT_VECTORS"
KEY_MISSING = "API_KEY_MISSING"
EMBEDDING_FAILED = "QUERY_EMBEDDING_FAILED"
PROFILE_CHANGED = "QUERY_PROFILE_CHANGED_DURING_REQUEST"


def vector_counts(keys: DataFrame, present: Column, valid: Column) -> DataFrame:
    """One row (n, good, bad) of the stored vectors; only counts leave the scan."""
    return keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("good"), F.count_if(present & ~valid).alias("bad"))


def gate_reason(paid: Column, matches: Column, client: Column) -> Column:
    """Why a search over ``vector_counts`` may not use vectors; empty if it may.

    What needs no look at the vectors comes first. An invalid row forbids their use
    even where others are valid; missing ones don't.
    """
    reason = F.when(~paid, PAID_QUERY_DISABLED).when(~matches, RECONCILIATION_REQUIRED).when(F.col("bad") > 0, SNAPSHOT_INVALID)
    return reason.when(F.col("good") == 0, NO_VALID_VECTORS).when(~client, KEY_MISSING).otherwise("")


def reconciled(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, outcome, label) of two passes (key, grade, grp): a conflict if only one gives grade 2 or the groups of two such differ, else the lower grade."""
    other = two.select(F.col(key).alias("of"), F.col("grade").alias("second"), F.col("grp").alias("second_grp"))
    rows = one.join(other, F.col(key) == F.col("of"))
    apart = ((F.col("grade") == 2) != (F.col("second") == 2)) | ((F.col("grade") == 2) & ~F.col("grp").eqNullSafe(F.col("second_grp")))
    return rows.select(key, F.when(apart, "conflict").otherwise("agreed").alias("outcome"), F.when(~apart, F.least("grade", "second")).alias("label"))

"""An extension: follow a stream of file versions and publish each micro-batch as a generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.store import latest, upsert
from tarnwell.sources.generations import GenerationStore


def deduplicated(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """File versions (path, sha, seen, ..) without repeats of a version within the watermark."""
    return events.withWatermark("seen", watermark).dropDuplicatesWithinWatermark(["path", "sha"])


def windowed_changes(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Versions and bytes of each window of time; late rows beyond the watermark are dropped by Spark."""
    return events.withWatermark("seen", watermark).groupBy(F.window("seen", window)).agg(F.count(F.lit(1)).alias("versions"), F.sum("size").alias("bytes"))


def publisher(store: GenerationStore, table: str = "files", key: str = "path") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the last version of each key replaces the stored one.

    A batch that is run again after a failure is recognised by its id in the
    manifest, so it is published once.
    """

    def publish(batch: DataFrame, epoch: int) -> None:
        at = store.active()
        if at["manifest"] == f"epoch-{epoch}":
            return
        new = latest(batch, [key], "seen").drop("seen")
        old = store.read(table, at)
        merged = upsert(old.select(*new.columns), new, [key]) if at["generation"] else new
        store.publish(at["generation"], {table: merged}, f"epoch-{epoch}")

    return publish

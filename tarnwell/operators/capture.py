"""Capture of embeddings: plan, request what is missing, keep in the bank, log failures, materialize."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import vectors as V
from tarnwell.operators.store import insert_or_ignore
from tarnwell.sources.embedding import Client, embed


def plan(keys: DataFrame, bank: DataFrame, failures: DataFrame, retry_terminal: bool = False) -> DataFrame:
    """(hash, bytes, action) of (hash, text): hit in the bank, skip after a terminal failure, or request."""
    have = bank.select("hash").distinct().withColumn("have", F.lit(True))
    last = failures.groupBy("hash").agg(F.max_by("classification", "id").alias("classification"))
    size = F.max(F.octet_length("text")).cast("long") if "text" in keys.columns else F.lit(None).cast("long")
    once = keys.groupBy("hash").agg(size.alias("bytes"))
    action = F.when(F.col("have"), "hit").when((F.col("classification") == "terminal") & ~F.lit(retry_terminal), "skip").otherwise("request")
    return once.join(have, "hash", "left").join(last, "hash", "left").select("hash", "bytes", action.alias("action"))


def summary(planned: DataFrame) -> DataFrame:
    """One row: distinct keys, hits, skipped, payable, and the bytes that bound the tokens to pay."""
    pay = F.col("action") == "request"
    return planned.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("action") == "hit").alias("hits"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
        F.count_if(pay).alias("payable"),
        F.coalesce(F.sum(F.when(pay, F.col("bytes"))), F.lit(0)).alias("token_bound"),
    )


def capture(keys: DataFrame, bank: DataFrame, failures: DataFrame, make_client: Callable[[], Client], dimensions: int, **limits) -> tuple[DataFrame, DataFrame]:
    """(new bank rows (hash, vector, sha256), new failure rows (hash, classification, last_error)).

    Stage the result of ``embed`` before use if the provider is paid: a plan that is
    evaluated twice asks twice.
    """
    wanted = plan(keys, bank, failures).where("action = 'request'").select("hash")
    texts = keys.groupBy("hash").agg(F.min("text").alias("text")).join(wanted, "hash", "left_semi")
    answered = embed(texts, make_client, dimensions, **limits)
    got, failed = kept(answered)
    fresh, _ = insert_or_ignore(bank, got, "hash", "sha256")
    return fresh, failed


def kept(answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``embed``'s answers what goes to the bank (hash, vector, sha256) and to the failures (hash, classification, last_error)."""
    digest = F.sha2(F.encode(F.array_join(F.transform("vector", lambda v: v.cast("string")), ","), "UTF-8"), 256)
    got = answered.where("error IS NULL").select("hash", "vector", digest.alias("sha256"))
    kind = F.when(F.col("error").startswith("Retryable"), "retryable").otherwise("terminal")
    return got, answered.where("error IS NOT NULL").select("hash", kind.alias("classification"), F.col("error").alias("last_error"))


def materialize(bank: DataFrame, dimensions: int, codec: str = "int8") -> DataFrame:
    """Serving vectors of the bank's, reduced and normalized: int8 codes with scale and stored norm, or the floats themselves."""
    unit = bank.select("hash", V.reduce_and_normalize(F.col("vector"), dimensions).alias("unit")).withColumn("scale", V.scale_of(F.col("unit")))
    if codec == "float32":
        return unit.select("hash", F.lit(dimensions).alias("dimensions"), F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("float").alias("scale"), V.norm(F.col("unit")).cast("float").alias("norm"), "unit")
    coded = unit.withColumn("codes", V.codes_of(F.col("unit"), F.col("scale")))
    return coded.select("hash", F.lit(dimensions).alias("dimensions"), "codes", "scale", V.code_norm(F.col("codes"), F.col("scale")).alias("norm"), F.lit(None).cast("array<float>").alias("unit"))

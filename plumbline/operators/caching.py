"""Reuse by content: compute for distinct keys that a stored table lacks, and join back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sheets import Refusal


def content_key(*columns: str):
    return F.sha2(F.concat_ws("\0", *columns), 256)


def with_cache(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, stamp: str, value: str, kind: str) -> DataFrame:
    """``rows(key, text)`` with ``value``: stored ones are read, the rest computed once a key and stored.

    ``path`` holds one folder a stamp (model, size, overlap); a folder with another stamp inside is refused.
    """
    spark = rows.sparkSession
    schema = f"key string, {value} {kind}, stamp string"
    folder = f"{path}/{content_stamp(stamp)}"
    try:
        stored = spark.read.schema(schema).parquet(folder)
    except Exception as e:  # the first run has no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], schema)
    if stored.where(F.col("stamp") != stamp).limit(1).count():
        raise Refusal(f"{folder}: stored under another stamp")
    fresh = compute(rows.dropDuplicates(["key"]).join(stored, "key", "left_anti").select("key", "text"))
    fresh.select("key", value).withColumn("stamp", F.lit(stamp)).write.mode("append").parquet(folder)
    return rows.join(spark.read.schema(schema).parquet(folder).drop("stamp").dropDuplicates(["key"]), "key", "left")


def content_stamp(stamp: str) -> str:
    import hashlib

    return hashlib.sha256(stamp.encode()).hexdigest()[:16]


def reuse(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """How many distinct keys a store has and lacks."""
    keys = rows.select("key").distinct().join(stored.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    return keys.agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))

"""Lookups by key: unique indexes, counted misses, fallbacks, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A key that must be unique isn't."""


def unique_index(df: DataFrame, key: str) -> DataFrame:
    """df, once it is certain that no key is there twice."""
    twice = df.groupBy(key).count().filter("count > 1").limit(3).collect()
    if twice:
        raise DuplicateKeys(f"{key} is not unique: {[r[0] for r in twice]}")
    return df


def duplicate_keys(df: DataFrame, *key: Column | str) -> DataFrame:
    """Keys of several rows, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def looked_up(df: DataFrame, index: DataFrame, key: str, columns: list[str], found: str = "is_found") -> DataFrame:
    """df with columns of the index, null where the key isn't there, and whether it is."""
    side = index.select(F.col(key).alias("_key"), *columns, F.lit(True).alias("_found"))
    return df.join(side, F.col(key) == F.col("_key"), "left").withColumn(found, F.coalesce("_found", F.lit(False))).drop("_key", "_found")


def with_fallback(df: DataFrame, index: DataFrame, key: str, own: str, other: str, where: Column) -> DataFrame:
    """df in which an empty list `own` is replaced by the index's `other`, where the condition holds."""
    side = index.select(F.col(key).alias("_key"), F.col(other).alias("_other"))
    joined = df.join(side, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(own, F.when(where & (F.size(F.coalesce(own, F.array())) == 0) & F.col("_other").isNotNull(), F.col("_other")).otherwise(F.col(own))).drop("_key", "_other")


def last_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(key, "_r.*")


def not_done(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the output doesn't have yet."""
    return df.join(done.select(*key).distinct(), key, "left_anti")

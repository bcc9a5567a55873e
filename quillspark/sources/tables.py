"""Tables with optional columns, manifests, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, as nulls of the given type."""
    return reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(None).cast(columns[c])), columns, df)


def compare_manifests(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, state: missing, extra, changed or same. Both have key and h, a hash."""
    a, b = before.select(key, F.col("h").alias("a")), now.select(key, F.col("h").alias("b"))
    state = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def manifest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and the hash of the columns' JSON form."""
    return df.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))

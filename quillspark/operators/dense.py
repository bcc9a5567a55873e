"""Inner products of single pairs of vectors, and their validity. Search over all vectors: see vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def validity(vectors: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: how many vectors there are, of which sizes, and how many aren't finite, zero or off unit length."""
    v = as_doubles(F.col("v"))
    n = norm(v)
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.agg(
        F.count("*").alias("n"),
        F.count_distinct(F.size("v")).alias("sizes"),
        F.max(F.size("v")).cast("long").alias("dims"),
        F.count_if(~finite).alias("not_finite_n"),
        F.count_if(n == 0).alias("zero_n"),
        F.count_if(F.abs(n - 1) > tolerance).alias("off_unit_n"),
        F.round(F.min(n), 5).alias("min_norm"),
        F.round(F.max(n), 5).alias("max_norm"),
    )

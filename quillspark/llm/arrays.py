"""Column functions on arrays that stay linear, or nearly so, in the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, largest: bool = False) -> Column:
    """For each of an array of integers the sum (or the largest, at least 0) of those before it.

    A fold copies what it has made with each step, so it goes over pieces of about the square root of the array's length.
    """

    def more(at: Column, x: Column) -> Column:
        return F.greatest(at, x) if largest else at + x

    def fold(own: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(own, first, lambda acc, x: F.struct(more(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def cut(own: Column) -> Column:
        return let(
            F.ceil(F.sqrt(F.size(own))).cast("int"),
            lambda width: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / width).cast("int")), lambda k: F.slice(own, k * width + 1, width)),
        )

    def tops(pieces: Column) -> Column:
        return F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), more))

    def whole(own: Column) -> Column:
        pieces = let(cut(own), lambda p: F.flatten(F.zip_with(p, fold(tops(p), F.lit(0)), fold)))
        return F.when(F.size(own) > 0, pieces).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def without(values: Column, places: Column) -> Column:
    """An array without the elements at places, which are sorted, counted from 1 and not empty."""

    def rest(own: Column, edges: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(own, F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i) - 1)))

    return let(values, lambda own: let(F.concat(F.array(F.lit(0)), places, F.array(F.size(own) + 1)), lambda edges: rest(own, edges)))

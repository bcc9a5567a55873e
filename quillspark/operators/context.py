"""Context around hits: neighbours, groups, completeness, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(seeds: DataFrame, chunks: DataFrame, radius: int = 2) -> DataFrame:
    """seed, chunk, distance. The walk each way stops at the first gap, other section or page more than one away.

    chunks: doc_id, idx, section, page; seeds: doc_id, idx, any key columns. Offsets are equal keys of a join.
    """
    keys = [c for c in seeds.columns if c not in ("doc_id", "idx")]
    own = chunks.select("doc_id", F.col("idx").alias("at"), F.col("section").alias("s"), F.col("page").alias("p"))
    base = seeds.join(chunks, ["doc_id", "idx"]).select(*keys, "doc_id", "idx", "section", "page")
    found = [base.select(*keys, "doc_id", "idx", F.col("idx").alias("chunk"), F.lit(0).alias("distance"))]
    for way in (-1, 1):
        walk = base
        for step in range(1, radius + 1):
            fits = (F.col("s") == F.col("section")) & (F.abs(F.col("p") - F.col("page")) <= 1)
            walk = walk.withColumn("at", F.col("idx") + way * step).join(own, ["doc_id", "at"]).filter(F.coalesce(fits, F.lit(False)))
            found.append(walk.select(*keys, "doc_id", "idx", F.col("at").alias("chunk"), F.lit(way * step).alias("distance")))
            walk = walk.select(*keys, "doc_id", "idx", "section", "page")
    return reduce(DataFrame.unionByName, found)


def completeness(selected: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """keys, doc_id, parent, selected_n, total_n, complete."""
    total = chunks.groupBy("doc_id", "parent").agg(F.count("*").alias("total_n"))
    got = selected.groupBy(*keys, "doc_id", "parent").agg(F.count_distinct("idx").alias("selected_n"))
    return got.join(total, ["doc_id", "parent"]).withColumn("complete", F.col("selected_n") == F.col("total_n"))


def packed(groups: DataFrame, key: str, limit: int) -> DataFrame:
    """First fit in order: a group is taken if it still fits, else skipped; nothing at all if the first doesn't fit.

    groups: key, position, name, size. A question has few groups: they are folded as one array.
    """
    rows = groups.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "name", F.col("size").cast("int").alias("size")))).alias("g"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("taken"), F.lit(False).alias("stop"))

    def step(acc: Column, g: Column) -> Column:
        fits = (acc["used"] + g["size"] <= limit) & ~acc["stop"]
        return F.struct(F.when(fits, acc["used"] + g["size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(g["name"]))).otherwise(acc["taken"]).alias("taken"), (acc["stop"] | (~fits & (F.size(acc["taken"]) == 0))).alias("stop"))

    out = F.aggregate("g", start, step)
    return rows.select(key, F.array_join(out["taken"], ",").alias("taken"), out["used"].alias("used"))


def round_robin(hits: DataFrame, key: str) -> DataFrame:
    """The first hit of each group, then the second of each, and so on. hits: key, grp, grp_order, idx."""
    depth = F.row_number().over(Window.partitionBy(key, "grp").orderBy("idx"))
    return hits.withColumn("depth", depth).withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("depth", "grp_order", "idx")))


def deduplicated(hits: DataFrame, key: str, signature: Column) -> DataFrame:
    """One hit for each text of a question: seeds before context, then by rank."""
    order = Window.partitionBy(key, "sig").orderBy(F.col("context_only"), "rank", "chunk_id")
    return hits.withColumn("sig", signature).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("sig", "r")

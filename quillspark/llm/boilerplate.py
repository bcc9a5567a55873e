"""Line dedup by distinct-site spread, with DataFrame functions only.

A line's key is a pair of hashes (64 and 32 bits) of the line without white space at its ends. HyperLogLog sketches of the
sites that hold a line are merged by aggregation. Lines whose estimate is within three standard errors of the threshold
get an exact distinct count; those above are boilerplate, those below are not. Boilerplate lines are removed wherever
they stand, even if nothing is left of a text. With unlike, a line must also stand in min_sites different sets of lines,
counted in the same way: lines that only the copies of a document spread are no boilerplate, and the copies stay whole, for
a near-duplicate operator to judge.

Blank lines are kept and never counted. A null site counts as one site of its own. Null text stays null, with no lines;
empty text stays empty. Repeated rows each give a row; they add no spread. Ties don't occur: a line is boilerplate from
min_sites on. A very long text costs time in proportion to its lines. An empty table gives none. Other columns pass through
clean() unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import without
from quillspark.session import Written

MIN_SITES = 8
LG_K = 12


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("h1"), F.hash(bare).alias("h2"))


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) != ""


def spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h1, h2 of the lines that at least min_sites sites hold and, if lines has a column own, that have as many values of it. lines: h1, h2, site."""
    margin = 3 * 1.04 / (2**lg_k) ** 0.5
    by = [c for c in ("site", "own") if c in lines.columns]
    seen = lines.groupBy("h1", "h2").agg(F.least(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, lg_k)) for c in by], F.lit(2**62)).alias("n"))
    seen = seen.filter(F.col("n") >= min_sites * (1 - margin))
    seen = Written(seen, "line-spread").read()
    near = seen.filter(F.col("n") <= min_sites * (1 + margin)).select("h1", "h2")
    some, exact = lines.join(near, ["h1", "h2"], "left_semi"), near
    for c in by:
        exact = exact.join(some.groupBy("h1", "h2").agg(F.count_distinct(c).alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2"), ["h1", "h2"], "left_semi")
    return seen.filter(F.col("n") > min_sites * (1 + margin)).select("h1", "h2").unionByName(exact)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, counts: bool = False, unlike: bool = False) -> DataFrame:
    """docs with boilerplate lines removed from text; counts adds __b_lines and __b_removed. unlike: see above."""
    lines, mark = F.split(F.col(text), "\n"), F.xxhash64(F.col(text))
    own = docs.select(F.col(doc_id).alias("id"), mark.alias("mark"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col(text).alias("text"))
    if unlike:  # the set of a text's lines, whatever their order
        own = own.withColumn("own", F.xxhash64(F.array_sort(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _filled), lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r"))))))))
    named = ["own"] if unlike else []
    own = own.select("*", F.posexplode(F.split("text", "\n")).alias("pos", "line")).drop("text")
    own = own.filter(_filled(F.col("line"))).withColumn("key", _key(F.col("line"))).withColumn("pos", F.col("pos") + 1)
    table = Written(own.select("id", "mark", *named, "site", "pos", "key.h1", "key.h2"), "lines").read()
    common = Written(spread(table.select("h1", "h2", "site", *named), min_sites), "boilerplate").read()
    # Each document's own boilerplate: places of no more than its lines.
    found = table.join(common, ["h1", "h2"], "left_semi").groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("__b_at"))
    found = found.withColumnRenamed("id", "__b_id").withColumnRenamed("mark", "__b_mark")
    joined = docs.join(found.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col("__b_id")) & (mark == F.col("__b_mark")), "left")
    joined = joined.withColumn("__b_text", F.when(F.col("__b_at").isNotNull(), F.array_join(without(lines, F.col("__b_at")), "\n")))
    joined = joined.withColumn("__b_done", F.col("__b_text").isNotNull())
    result = F.when(F.col("__b_done"), F.col("__b_text")).otherwise(F.col(text))
    filled = F.coalesce(F.size(F.filter(lines, _filled)), F.lit(0)).cast("long")
    extra = [filled.alias("__b_lines"), F.when(F.col("__b_done"), F.size("__b_at")).otherwise(F.lit(0)).cast("long").alias("__b_removed")] if counts else []
    return joined.select(*[result.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], *extra)

"""BM25 rankings without all pairs: postings in the order of their impact, in blocks whose largest impact is known.

An index holds, for each term, blocks of at most BLOCK postings by falling impact (the part of BM25 that depends on the chunk;
the term's weight is a factor), and for each chunk its terms. A hot term's postings lie in many blocks of many partitions.
The best k of a question are found in three steps:

1. The first block of each of its terms gives chunks with high partial sums. The best of them are scored in full: the k-th
   of these scores is a bar that the k-th best score can't be below.
2. Terms, from the one with the least largest impact on, whose largest impacts add up to less than LEFT_OUT of the bar are left
   out: a chunk that holds none but these can't reach it. Of the other terms only blocks are read in which a posting, with the
   largest impacts of all other terms, could reach the bar. A chunk is a candidate if what was read of it, with the largest
   impacts of all that wasn't, reaches the bar.
3. Candidates are scored in full from their own terms.

Every bound is kept with a margin above the rounding of scores (6 decimals), so the rows are those of a full ranking.
Ties go to the smaller id. A question without terms, or whose terms stand nowhere, has no rows; neither has an empty index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.bm25 import K1, B, top
from quillspark.session import Written

BLOCK = 128
#: Above the error of a score of 6 decimals.
MARGIN = 1e-5
#: Chunks that set the bar, as a multiple of k.
SEEDS = 4
#: Terms are left out up to this share of the bar: with more of it fewer postings are read, but more chunks scored in full.
LEFT_OUT = 0.4


class Impacts:
    """The index of a table of postings (chunk_id, dl, term, tf, and a mark, the empty term, for each chunk)."""

    def __init__(self, postings: DataFrame, pair_weight: float = 0.25) -> None:
        self.pair_weight = pair_weight
        mark = F.col("term") == ""
        length = F.sum(F.when(mark & F.col("dl").isNotNull(), F.col("tf")))
        total = postings.filter(mark).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.sum(F.col("tf") * F.col("dl")), length), F.lit(1.0))).alias("avgdl"))
        self.n, self.avgdl = total.first()
        own = postings.filter(~mark)
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(self.avgdl))))
        ordered = own.select("term", part.alias("part"), "chunk_id").repartitionByRange("term", F.desc("part"), "chunk_id").sortWithinPartitions("term", F.desc("part"), "chunk_id")
        kind = postings.schema["chunk_id"].dataType.simpleString()
        self.blocks = Written(ordered.mapInArrow(_blocks, f"block long, term string, top double, n long, chunks array<{kind}>, parts array<double>"), "impact-blocks")
        self.chunks = Written(own.groupBy("chunk_id").agg(F.collect_list(F.struct("term", part.alias("part"))).alias("terms")), "impact-chunks")
        terms = self.blocks.read().groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.max_by("block", F.struct("top", -F.col("block"))).alias("first"))
        n = F.lit(float(self.n))
        weight = F.when(F.col("term").startswith("ko:"), F.lit(pair_weight)).otherwise(F.lit(1.0)) * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.terms = Written(terms.select("term", "df", "first", weight.alias("w"), (weight * F.col("top")).alias("most")), "impact-terms")

    def full(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """query_id, chunk_id, score of pairs, from the chunks' own terms. asked: query_id, term, w."""
        held = pairs.join(self.chunks.read(), "chunk_id").select("query_id", "chunk_id", F.explode("terms").alias("x")).select("query_id", "chunk_id", "x.term", "x.part")
        return held.join(asked.select("query_id", "term", "w"), ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("part")), 6).alias("score"))

    def top(self, queries: DataFrame, query_id: str, terms: Column, k: int) -> DataFrame:
        """query_id, chunk_id, score, rank: the best k of each question. terms: an array of words."""
        return self._searched(queries, query_id, terms, k)[0]

    def reads(self, queries: DataFrame, query_id: str, terms: Column, k: int) -> DataFrame:
        """One row: postings of the questions' terms, and those read by the three steps, with the terms of chunks scored in full."""
        _, asked, blocks, scored = self._searched(queries, query_id, terms, k)
        every = asked.agg(F.sum("df").alias("postings"))
        read = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_blocks"))
        full = scored.join(self.chunks.read(), "chunk_id").agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("in_chunks"), F.count("*").alias("scored"))
        return every.crossJoin(F.broadcast(read)).crossJoin(F.broadcast(full))  # one row each

    def _searched(self, queries: DataFrame, query_id: str, terms: Column, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        own = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms)).alias("term"))
        asked = Written(own.join(self.terms.read(), "term"), "impact-asked").read()
        sums = asked.groupBy("query_id").agg(F.sum("most").alias("sum"))
        blocks = self.blocks.read()
        # 1. The bar.
        firsts = asked.select("query_id", "term", F.col("first").alias("block"), "w").join(blocks, ["block", "term"])
        partial = _sums(firsts)
        seeds = top(partial.select("query_id", "chunk_id", "score"), SEEDS * k).select("query_id", "chunk_id")
        seeded = Written(top(self.full(seeds, asked), k), "impact-seeds").read()
        bars = seeded.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - MARGIN).otherwise(F.lit(0.0)).alias("bar"))
        # 2. What can reach it.
        up = Window.partitionBy("query_id").orderBy("most", "term")
        marked = asked.join(sums, "query_id").join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
        marked = Written(marked.withColumn("below", F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("out", F.col("below") < LEFT_OUT * F.col("bar")), "impact-marked").read()
        meta = marked.filter("NOT out").join(blocks.select("block", "term", "top", "n"), "term")
        able = F.col("w") * F.col("top") + F.col("sum") - F.col("most") >= F.col("bar")
        wanted = Written(meta.withColumn("able", able).select("query_id", "block", "term", "w", "top", "n", "able"), "impact-wanted").read()
        unread = wanted.filter("NOT able").groupBy("query_id", "term").agg(F.max(F.col("w") * F.col("top")).alias("more")).groupBy("query_id").agg(F.sum("more").alias("more"))
        slack = marked.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("out"), F.col("most"))), F.lit(0.0)).alias("rest"), F.max("bar").alias("bar")).join(unread, "query_id", "left")
        read = wanted.filter("able").select("query_id", "block", "term", "w", "n")
        seen = _sums(read.drop("n").join(blocks, ["block", "term"]))
        candidates = seen.join(slack, "query_id").filter(F.col("score") + F.col("rest") + F.coalesce("more", F.lit(0.0)) >= F.col("bar")).select("query_id", "chunk_id")
        # 3. In full.
        candidates = Written(candidates, "impact-candidates").read()
        best = top(self.full(candidates, asked), k)
        every = read.select("n").unionByName(firsts.select("n"))
        return best, asked, every, candidates.unionByName(seeds)


def _sums(postings: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: what the postings of some blocks give."""
    each = postings.select("query_id", "w", F.explode(F.arrays_zip("chunks", "parts")).alias("x"))
    return each.groupBy("query_id", F.col("x.chunks").alias("chunk_id")).agg(F.sum(F.col("w") * F.col("x.parts")).alias("score"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK postings of a term: rows come by term and falling part; a run ends with its batch."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first = np.flatnonzero((np.arange(n) - start) % BLOCK == 0)
        offsets = pa.array(np.concatenate([first, [n]]).astype(np.int32))
        made = [pa.array(block + np.arange(1, len(first) + 1)), batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)), pa.array(np.diff(np.concatenate([first, [n]]))), pa.ListArray.from_arrays(offsets, batch.column(2)), pa.ListArray.from_arrays(offsets, batch.column(1))]
        block += len(first)
        yield pa.RecordBatch.from_arrays(made, names=["block", "term", "top", "n", "chunks", "parts"])

"""BM25 over bags of words gives the rows of the full ranking, by any block of questions, and exchanges no postings."""

import random

from pyspark.sql import functions as F

from quillspark.operators import bm25, scan
from quillspark.queries.common import among


def words(c):
    return F.split(c, " ")


def corpus(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, texts[0]) for i in range(300, 320)] + [(7, texts[7]), (7, "a a b"), (400, None)]
    docs = spark.createDataFrame(rows, "id long, t string")
    return docs, spark.createDataFrame([(i, texts[i]) for i in range(0, 300, 20)] + [(900, None), (901, "zz")], "q long, t string")


def plain(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())


def test_same_as_the_postings(spark, monkeypatch):
    docs, asked = corpus(spark)
    full = bm25.scores(bm25.tokenized(docs, "id", F.col("t"), words), asked, "q", F.col("t"), words).filter("query_id IS NOT NULL").localCheckpoint()
    bags = scan.Bags(docs, "id", F.col("t"), words)
    weights = bags.asked(asked, "q", words(F.col("t")))
    assert plain(bags.scores(weights)) == plain(full)
    monkeypatch.setattr(scan, "QUESTIONS", 4)
    monkeypatch.setattr(scan, "CELLS", 64)
    best = bags.top(weights, 7)
    assert plain(best) == plain(bm25.top(full, 7))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "terms" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert scan.Bags(docs.limit(0), "id", F.col("t"), words).scores(weights).count() == 0


def test_hits_alone_are_read(spark):
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert sorted(r[0] for r in among(rows, "doc_id", spark.createDataFrame([(3,), (3,), (77,), (5000,)], "x long")).collect()) == [3, 77]

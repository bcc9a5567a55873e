"""Blocked vector search, the inverted file and the impact-ordered index against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import bm25, impacts, inverted, vectors

DIR = "/root/testdata/sf0.1"


def some(seed, n, dims, values=None):
    rnd = random.Random(seed)
    return [(i, [rnd.choice(values) if values else rnd.gauss(0, 1) for _ in range(dims)]) for i in range(n)]


def frames(spark, rows, every=7):
    v = spark.createDataFrame(rows, "chunk_id long, v array<double>").repartition(4)
    return v, v.filter(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def brute(rows, k, cosines, every=7):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            s = sorted((-round(cosine(a, b) if cosines else sum(x * y for x, y in zip(a, b, strict=True)), 6), i) for i, b in good if len(a) == len(b))
            out += [(q, i, -x + 0.0, r + 1) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


ODD = [(7000, [0.0] * 4), (7001, None), (7002, [1.0, None, 0.0, 0.0]), (7003, [float("nan")] * 4), (7007, [1.0, 2.0]), (7014, []), (None, [1.0] * 4)]


@pytest.mark.parametrize("cosines", [False, True])
@pytest.mark.parametrize("values", [None, (0.0, 1.0, -1.0)])
def test_top_matches_brute_force(spark, monkeypatch, cosines, values):
    monkeypatch.setattr(vectors, "ROWS", 32)
    monkeypatch.setattr(vectors, "QUESTIONS", 8)
    monkeypatch.setattr(vectors, "CELL", 3)
    rows = some(1, 400, 4, values) + ODD
    v, q = frames(spark, rows)
    got = sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in vectors.top(v, q, 5, cosine=cosines).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in brute(rows, 5, cosines)]
    assert np.allclose([g[2] for g in got], [w[2] for w in brute(rows, 5, cosines)])
    assert vectors.top(v.limit(0), q, 5).count() == 0 and vectors.top(v, q.limit(0), 5).count() == 0


@pytest.mark.parametrize("values", [None, (0.0, 1.0, -1.0)])
def test_exact_search_of_the_inverted_file_loses_no_row(spark, values):
    rows = some(2, 500, 4, values) + ODD[:4]
    v, q = frames(spark, rows)
    index = inverted.build(v, batches=3)
    got = sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in inverted.search(index, q, 6, exact=True).collect())
    assert got == [(a, b, r) for a, b, _, r in brute(rows, 6, True)]
    counts = inverted.rebuilt(index).orderBy("batch").collect()
    assert [r["stored"] for r in counts] == list(np.cumsum([r["expected"] for r in counts])) and counts[-1]["stored"] == 501


def test_recall_of_the_inverted_file(spark):
    from quillspark.queries.retrieval import _asked, _vectors

    v, q = _vectors(spark, DIR), _asked(spark, DIR)
    want = {(r["query_id"], r["chunk_id"]) for r in vectors.top(v, q, 10, cosine=True).collect()}
    got = {(r["query_id"], r["chunk_id"]) for r in inverted.search(inverted.build(v), q, 10).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_blended_ranks_match_brute_force(spark):
    rows = some(3, 300, 4, (0.0, 1.0, 2.0))
    v, q = frames(spark, rows, 30)
    rnd = random.Random(4)
    words = {(a, i): rnd.randint(1, 3) for a in range(0, 300, 30) for i in range(300) if rnd.random() < 0.2}
    got = sorted(tuple(r) for r in vectors.blended(v, q, spark.createDataFrame([(a, i, n) for (a, i), n in words.items()], "query_id long, chunk_id long, lexical long"), 12).select("query_id", "chunk_id", "lexical", "dense_rank", "keyword_rank", "rank").collect())
    want = []
    for a in range(0, 300, 30):
        score = {i: round(cosine(rows[a][1], b), 6) for i, b in rows}
        dense = sorted(score, key=lambda i: (-score[i], i))
        word = sorted(score, key=lambda i: (-words.get((a, i), 0), -score[i], i))
        kept = [i for i in dense if dense.index(i) < 6 or (words.get((a, i), 0) and word.index(i) < 6)][:12]
        want += [(a, i, words.get((a, i), 0), dense.index(i) + 1, word.index(i) + 1, r + 1) for r, i in enumerate(kept)]
    assert got == sorted(want)


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_impact_ordered_search_gives_the_full_ranking(spark, monkeypatch, share):
    monkeypatch.setattr(impacts, "LEFT_OUT", share)
    monkeypatch.setattr(impacts, "BLOCK", 8)
    rnd = random.Random(5)
    word = lambda: f"w{min(rnd.randint(0, 60), rnd.randint(0, 60))}"
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["w1 w2"] * 40 + [None]
    docs = bm25.tokenized(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t"), lambda c: F.split(c, " "))
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w50 w59 w0"), (3, "none"), (4, "w1 w1"), (5, " ".join(f"w{i}" for i in range(40)))], "q long, t string")
    words = F.split("t", " ")
    index = impacts.Impacts(bm25.postings(docs).filter("chunk_id is not null"))
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in index.top(asked, "q", words, 7).collect())
    full = bm25.top(bm25.scores(docs, asked, "q", F.col("t"), lambda c: F.split(c, " ")), 7).collect()
    assert got == sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in full)
    read = index.reads(asked, "q", words, 7).first()
    assert 0 < read["in_blocks"] and read["scored"] > 0


def test_impact_ordered_search_reads_fewer_postings(spark):
    from quillspark.queries.common import lexical_tokens, shared_impacts, table

    read = shared_impacts(spark, DIR).reads(table(spark, DIR, "benchmark"), "item_id", lexical_tokens(F.col("text")), 10).first()
    assert read["in_blocks"] < 0.6 * read["postings"] and read["scored"] < 0.1 * 10_000 * 200

import hashlib
from collections import Counter

import numpy as np
import pytest
from corpora import texts

from quillspark.llm import suffixes


def brute(own):
    data = [(t or "").encode() for t in own]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        cut = np.cumsum(mark)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cut])
        out.append((len(b), int(cut.sum()), int((np.diff(cut.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("limit", "part"), [(5_000, 2 << 20), (2, 1_000)])
def test_matches_brute_force_over_many_partitions(spark, monkeypatch, limit, part):
    monkeypatch.setattr(suffixes, "LIMIT", limit)
    monkeypatch.setattr(suffixes, "PART", part)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        own = texts(3, 90)
        df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
        got = {r[0]: tuple(r)[2:] for r in suffixes.dedup(df, keep_bytes=False).collect()}
        want = brute(own)
        assert [i for i in range(len(own)) if got[i] != want[i]] == []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_repeated_rows_ids_and_empty_table(spark, docs, no_docs):
    rows = [(1, "z" * 150 + "unique one " * 10), (1, "another text " * 30), (None, "another text " * 30), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["text"] or "", r["__s_removed"]) for r in suffixes.dedup(df).collect())
    assert got == sorted((t or "", brute([x for _, x in rows])[i][1]) for i, (_, t) in enumerate(rows))
    assert suffixes.dedup(no_docs).count() == 0


def test_multikey_sort():
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    assert suffixes.multikey(data, np.array([0, 3, 6, 9]), np.zeros(4, np.int64), 3).tolist() == [True, True, False, True]
    assert suffixes.multikey(data, np.array([0, 3, 6, 9]), np.array([0, 1, 0, 0]), 3).tolist() == [True, False, False, True]

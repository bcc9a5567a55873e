import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing


def ids_of(texts, plain=False):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    if plain:
        tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_every_id_in_one_piece(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    extra = [(9000, "<|endoftext|> special  two spaces\n\n lead"), (9001, " x"), (9002, "tab\there nbsp  em"), (9003, "don't I'll " * 700)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(6)
    ids = dict(zip([i for i, _ in rows + extra], ids_of([t for _, t in rows + extra]), strict=True))
    pieces = packing.pack(df).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[k])
            at += p["length"]
            assert zlib.crc32(np.array(ids[k][p["start"] : at], "<u4").tobytes()) == p["ids_crc32"]
        assert at == len(ids[k])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_names_of_special_tokens_and_clashing_columns(spark, special):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|><|endoftext|> \n y", "<|endoftext", "plain", "a<|endoftext|>b", None]
    rows = [(7 if i == 5 else i, t, -1, -1, "x") for i, t in enumerate(texts)] + [(0, texts[0], -1, -1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, sequence_id long, rest string").repartition(3)
    want = sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, *_), x in zip(rows, ids_of([r[1] for r in rows], not special), strict=True))
    pieces = packing.pack(df, special=special).collect()
    assert sorted((p["doc_id"], p["doc_tokens"], p["ids_crc32"]) for p in pieces) == want


def test_plan_uses_every_piece_once_with_little_slack():
    rnd = random.Random(3)
    counts = {k: rnd.randint(0, 50) for k in range(1, 1024)}
    rows, windows = packing.plan(counts)
    placed = {}
    fill = {}
    for length, first, n, each, window, offset in rows:
        assert first == placed.get(length, 0) and n % each == 0
        placed[length] = first + n
        for k in range(n // each):
            fill.setdefault(window + k, []).extend((offset + j * length, length) for j in range(each))
    assert placed == {k: v for k, v in counts.items() if v} and len(fill) == windows
    total = sum(k * v for k, v in counts.items())
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    least = max(-(-total // 1024), sum(v for k, v in counts.items() if k > 512))  # two pieces of over half a window share none
    assert windows <= 1.02 * least


def test_skewed_lengths_pad_the_last_window_only(spark):
    texts = [" ".join(f"w{i % 7}" for i in range(300))] * 40 + [" ".join(f"v{i}" for i in range(k)) for k in range(1, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    ids = ids_of(texts)
    assert len(ids[0]) % 1024 > 512 and packing.plan({len(ids[0]) % 1024: 40})[1] == 40
    pieces = packing.pack(df).collect()
    total = sum(map(len, ids))
    fill, at = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == at.get(p["doc_id"], 0) and zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
        at[p["doc_id"]] = p["start"] + p["length"]
        fill.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert at == {k: len(x) for k, x in enumerate(ids)}
    assert set(fill) == set(range(-(-total // 1024)))
    for own in fill.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert sum(sum(n for _, n in x) < 1024 for x in fill.values()) <= 1


def test_plan_cut_has_slack_in_one_window():
    for counts in ({700: 1000}, {700: 1000} | {k: 2 for k in range(1, 1024)}, {1: 3}, {}, {1023: 2, 512: 3}):
        rows, windows = packing.plan_cut(counts)
        assert windows == -(-sum(k * v for k, v in counts.items()) // 1024)
        assert {k: sum(n for x, _, n, *_ in rows if x == k) for k in counts} == counts

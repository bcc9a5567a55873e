"""Classes of near copies, for counts in which copies stand for one document.

A text's shingles of five words (A-Z lower-cased) give BANDS groups of ROWS minima each, under multipliers of their own. Texts
that share a group are linked, and linked texts are one class: texts with a Jaccard similarity of 0.8 are linked with a
probability of 0.999, of 0.6 with 0.91, of 0.1 with 0.01. Texts are known by a 64-bit hash of all their bytes, so that
exact copies are one text from the start. Groups that one text alone has are left out; the rest are links of a graph
between texts and groups, of which connected components are found in rounds of joins. A text without words has no group.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.session import Written

WORDS, BANDS, ROWS = 5, 10, 3
KNOWN = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TIMES = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


_KNOWN_WORDS = _Words()


def text_hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def bands(text: bytes) -> list[int]:
    """The groups of minima of a text; none if it has no words."""
    own = text.translate(_LOWER).split()
    h = np.fromiter(map(_KNOWN_WORDS.__getitem__, own), np.uint64, len(own))
    n = min(WORDS, len(h))
    if not n:
        return []
    mixed = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD + h[i : len(h) - n + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD
    mixed ^= mixed >> np.uint64(32)
    least = np.array([(mixed * t).min() for t in _TIMES], np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ (out >> np.uint64(29))) * _ODD + least[:, k]
    out = (out ^ (out >> np.uint64(31))) * _ODD
    return out.view(np.int64).tolist()


def classes(texts: DataFrame) -> DataFrame:
    """h, class of the texts that have copies, near or exact. texts: h, bands (array), a row for each document."""
    each = Written(texts.groupBy("h").agg(F.first("bands").alias("bands"), F.count("*").alias("rows")), "copies-texts").read()
    held = each.select("h", F.explode("bands").alias("band"))
    shared = held.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    links = Written(held.join(shared, "band").select(F.col("h").alias("a"), F.col("band").alias("b")), "copies-links").read()
    near = components(links).join(links.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("h"), F.col("component").alias("class"))
    exact = each.filter("rows > 1").select("h", F.col("h").alias("class")).join(near, "h", "left_anti")
    return Written(near.unionByName(exact), "copies-classes").read()

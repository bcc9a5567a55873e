"""Spelling by an index of keys: words that may be close to a known word meet it by an equal key, and only these are compared.

A word is close to a known one if the ratio of their matching blocks (twice the letters in blocks over the letters of both)
reaches the cutoff; it is corrected if it is close to exactly one. Letters in blocks are a common subsequence, so the lengths of
both words say how many letters of each may stand outside of it, and with that which keys they meet by; none loses a pair:

- at most one letter of each: what is left of the words, whole or without one letter;
- three letters in all: of two halves of the known word one stands at the same end of the other with one such letter at most;
- more: of one more piece of the known word than there are such letters one stands unbroken, moved by no more places than these.

A word has about three keys a letter as a known one, and some for each length that it can be close to as one to correct. Pairs
that meet are first held against the letters outside by the distance of Levenshtein, which is no larger. Words are runs of small
Latin letters; null is none.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread, write_shared

CUTOFF = 0.88


def _outside(n: int, m: int, cutoff: float) -> tuple[int, int] | None:
    """How many letters of a word of n and of a known one of m letters may stand outside all blocks; None if they can't be close."""
    inside = math.ceil(cutoff * (n + m) / 2 - 1e-9)
    return (n - inside, m - inside) if inside <= min(n, m) else None


class Keys:
    """What makes the keys of words, as words to correct or as known ones; what a length needs is worked out once."""

    def __init__(self, known: bool, cutoff: float = CUTOFF) -> None:
        self.known, self.cutoff = known, cutoff
        self.plans: dict[int, tuple] = {}

    def partners(self, n: int, known: bool) -> list[tuple[int, int, int]]:
        """The lengths that a word of n letters can be close to, each with the letters outside of the asked and of the known word."""
        lengths = range(max(1, int(n * self.cutoff / (2 - self.cutoff) - 1e-9)), int(n * (2 - self.cutoff) / self.cutoff + 1e-9) + 1)
        found = [(x, _outside(x, n, self.cutoff) if known else _outside(n, x, self.cutoff)) for x in lengths]
        return [(x, *out) for x, out in found if out]

    def pieces(self, m: int) -> list[tuple[int, int]]:
        """Where the pieces of a known word of m letters begin and end."""
        most = max(a + b for _, a, b in self.partners(m, True))
        edges = [k * m // (most + 1) for k in range(most + 2)]
        return list(zip(edges, edges[1:], strict=False))

    def plan(self, n: int) -> tuple:
        """For words of n letters: the marks of what is left of them (whole, without a letter) or none, lengths met by halves and by pieces."""
        partners = self.partners(n, self.known)

        def mark(left: int, whole: bool) -> str:
            # Where words can't be close with a letter outside of each, whole words meet only what is left of others.
            return "" if _outside(left + 1, left + 1, self.cutoff) == (1, 1) else str(int(whole == self.known))

        near = (mark(n, True), mark(n - 1, False)) if any(a <= 1 and b <= 1 for _, a, b in partners) else None
        halves = [x for x in partners if max(x[1:]) > 1 and x[1] + x[2] <= 3]
        far = [(i, s, e, m, a, b) for m, a, b in partners if max(a, b) > 1 and a + b > 3 for i, (s, e) in enumerate(self.pieces(n if self.known else m))]
        return near, halves, far

    def of(self, word: str) -> set[str]:
        n, out = len(word), set()
        if n not in self.plans:
            self.plans[n] = self.plan(n)
        near, halves, far = self.plans[n]
        if near:
            out.add(near[0] + word)
            out.update([near[1] + x for x in _without_one(word)])
        if self.known:
            for end, half in (("<", word[: n // 2]), (">", word[n // 2 :])) if halves else ():
                out.add(f"{n}{end}{half}")
                if any(b for _, _, b in halves):
                    out.update([f"{n}{end}-{x}" for x in _without_one(half)])
            out.update([f"{n}:{i}:{word[s:e]}" for i, s, e, *_ in far])
            return out
        for m, a, b in halves:
            for end, size in (("<", m // 2), (">", m - m // 2)):
                at = {x: word[: size + x] if end == "<" else word[max(0, n - size - x) :] for x in (-1, 0, 1)}
                out.add(f"{m}{end}{at[0]}")
                if b:
                    out.add(f"{m}{end}-{at[-1]}")
                if a:
                    out.update([f"{m}{end}{x}" for x in _without_one(at[1])])
        for i, s, e, m, a, b in far:
            out.update([f"{m}:{i}:{word[at : at + e - s]}" for at in range(max(0, s - b), min(n - (e - s), s + a) + 1)])
        return out


def _without_one(word: str) -> set[str]:
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def _keyed(words: DataFrame, known: bool, cutoff: float, name: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(known, cutoff)
        for batch in batches:
            own = batch.column(0)
            found = [keys.of(w) for w in own.to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(found)), pa.string()), own.take(pa.array(owner))], names=["key", name])

    return spread(words).mapInArrow(run, f"key string, {name} string")


def corrections(words: DataFrame, vocabulary: DataFrame, least: int = 6, cutoff: float = CUTOFF) -> DataFrame:
    """word, corrected: the words, not in the vocabulary, that are close to exactly one word of it. Both tables have one column of words."""
    known = vocabulary.toDF("known").filter(F.col("known").rlike(f"^[a-z]{{{least},}}$")).distinct()
    known = write_shared(known, "spelling-known")  # both joins read it
    asked = words.toDF("word").filter(F.col("word").rlike(f"^[a-z]{{{least},}}$")).distinct().join(known, F.col("word") == F.col("known"), "left_anti")
    asked = write_shared(asked, "spelling-asked")
    both = F.length("word") + F.length("known")
    outside = (both - 2 * F.ceil(both * (cutoff / 2) - 1e-9)).cast("int")
    # Catalyst takes keys for as few as the words; many times as many must not be broadcast.
    met = _keyed(asked, False, cutoff, "word").hint("merge").join(_keyed(known, True, cutoff, "known"), "key").select("word", "known", outside.alias("outside"))
    pairs = met.filter(F.expr("levenshtein(word, known, outside) >= 0")).select("word", "known").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for word, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                compared = difflib.SequenceMatcher(None, near, word)
                if compared.quick_ratio() >= cutoff and compared.ratio() >= cutoff:
                    made.append((word, near))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["word", "known"])

    close = pairs.mapInArrow(run, "word string, known string")
    return close.groupBy("word").agg(F.count("*").alias("n"), F.min("known").alias("corrected")).filter("n = 1").select("word", "corrected")

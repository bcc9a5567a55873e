"""Document fingerprints by consistent weighted sampling.

The terms of a text are its runs of WORDS words (white space between them, A-Z lower-cased; the whole text if it has fewer),
each weighed by how often it stands there. For each of SAMPLES samples a term with weight w has r and c, drawn from
Gamma(2, 1), and b, drawn evenly from 0 to 1; with t = floor(ln(w) / r + b) it gets the value ln(c) - r * (t - b + 1), and
the term with the least value, together with its t, is the sample. Two texts have the same sample with a probability that
is the generalised Jaccard similarity of their weights (sum of the smaller over sum of the larger weights), so the share of
samples in common estimates it, with a standard error of at most 0.044 for 128 samples.

What is drawn depends on the term's hash and the sample's number alone: a product of both picks one of DRAWS rows of a table
that is the same everywhere. Terms that get the same value are told apart by their hash. A sample is written as four
hexadecimal digits of 15 bits; different samples look alike once in 32 768.

Null text is empty. Texts without a word share one fingerprint, of zeros, and have nothing in common with any text that has
words. Equal texts have equal fingerprints. A very long text costs time and memory in proportion to its length. An empty
table gives none. Repeated rows each give a row. Other columns pass through fingerprint() and are ignored by edited().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.arrays import let
from quillspark.llm.batches import append_columns, as_bytes, slices, worker_cache

SAMPLES, WORDS = 128, 5
DRAWS = 1 << 16
#: Hashes of words that a worker keeps.
KNOWN = 1 << 18
#: Bytes of text whose terms are held at once.
SLICE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _ordered(x: np.ndarray) -> np.ndarray:
    """float32 as integers in the same order."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


class Sampler:
    """The table of draws, the multiplier of each sample, and hashes of words seen."""

    def __init__(self, samples: int = SAMPLES, words: int = WORDS) -> None:
        own = np.random.Generator(np.random.PCG64(20_240_501))
        u = 1.0 - own.random((5, DRAWS))  # above 0
        self.samples, self.words = samples, words
        self.r, c, self.b = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), 1.0 - u[4]
        self.base = np.log(c) - self.r + self.r * self.b
        self.once = _ordered(self.base) << np.uint64(32)  # the value of a term that stands once: ln(w) = 0, t = 0
        self.times = own.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known = _Words()

    def terms(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and weight of the terms, text by text, and how many each text has."""
        size, hashes = np.zeros(len(texts), np.int64), []
        for k, x in enumerate(texts):
            own = (x or b"").translate(_LOWER).split()
            size[k] = len(own)
            hashes.append(np.fromiter(map(self.known.__getitem__, own), np.uint64, len(own)))
        own_terms, counts, number = [], [], np.zeros(len(texts), np.int64)
        for k, h in enumerate(hashes):
            n = min(self.words, len(h))
            if not n:
                continue
            mixed = np.zeros(len(h) - n + 1, np.uint64)
            for i in range(n):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD + h[i : len(h) - n + 1 + i]
            mixed ^= mixed >> np.uint64(31)
            term, weight = np.unique(mixed * _ODD, return_counts=True)
            own_terms.append(term ^ (term >> np.uint64(32)))
            counts.append(weight)
            number[k] = len(term)
        return (np.concatenate(own_terms), np.concatenate(counts), number) if own_terms else (np.zeros(0, np.uint64), np.zeros(0, np.int64), number)

    def signatures(self, texts: list[bytes | None]) -> np.ndarray:
        """A row of 16-bit samples for each text."""
        term, weight, number = self.terms(texts)
        out = np.zeros((len(texts), self.samples), np.uint16)
        some = np.flatnonzero(number)
        if not len(some):
            return out
        starts = np.cumsum(number[some]) - number[some]
        low, often = term & np.uint64(0xFFFFFFFF), np.flatnonzero(weight > 1)
        log_weight, many = np.log(weight[often].astype(float)), term[often]
        for k, times in enumerate(self.times):
            at = (term * times) >> np.uint64(48)
            value = self.once[at] | low
            if len(often):
                d = (many * times) >> np.uint64(48)
                t = np.floor(log_weight / self.r[d] + self.b[d])
                name = (low[often] + t.astype(np.int64).astype(np.uint64) * _ODD) & np.uint64(0xFFFFFFFF)
                value[often] = _ordered(self.base[d] - self.r[d] * t) << np.uint64(32) | name
            least = np.minimum.reduceat(value, starts) & np.uint64(0xFFFFFFFF)
            out[some, k] = ((least * _ODD) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)  # no sample is 0, the sign of no words
        return out


def _sampler(samples: int, words: int) -> Sampler:
    return worker_cache(("sampler", samples, words), lambda: Sampler(samples, words))


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """docs with the fingerprint of its text, in the place of a column with that name."""

    def make():
        sampler = _sampler(samples, words)
        return lambda texts: [[_hex(x) for x in sampler.signatures(texts)]]

    return append_columns(docs.drop("fingerprint"), text, make, [T.StructField("fingerprint", T.StringType())], SLICE)


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two fingerprints have in common."""
    groups = lambda x: F.regexp_extract_all(x, F.lit("[0-9a-f]{4}"), F.lit(0))
    return F.size(F.filter(F.zip_with(groups(a), groups(b), lambda x, y: x == y), lambda same: same)) / F.size(groups(a))


_EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _place(value: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are less than value, found in two steps of about the root of their number."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits)) + 1
    below = lambda some: F.size(F.filter(some, lambda x: x < value))
    whole, firsts = (F.array(*[F.lit(int(x)) for x in own]) for own in (splits, splits[::step]))
    return F.coalesce(let(below(firsts), lambda n: F.when(n > 0, (n - 1) * step + below(F.slice(whole, (n - 1) * step + 1, step))).otherwise(0)), F.lit(0))


def _dealt(docs: DataFrame) -> DataFrame:
    """part, guest, doc_id, text: rows dealt by ranges of ids, in order; the rows with the least id of a part are guests at the end of the part before.

    Splitters come from a sketch of all ids. As many rows as there are parts reach the driver: their least ids.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("x")).first()["x"] or []
    splits = sorted(set(splits))
    placed = docs.withColumn("part", _place(F.col("doc_id"), splits))
    least = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id"))["doc_id"].alias("first")).orderBy("part").collect()  # at most `parts` rows
    before = [(r["first"], least[k - 1]["part"]) for k, r in enumerate(least)]
    heads = spark.createDataFrame(before, "first long, before int")
    every = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    seats = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guest")))
    every = every.select(F.explode(F.filter(seats, lambda x: x["part"].isNotNull())).alias("x"), "doc_id", "text").select("x.part", "x.guest", "doc_id", "text")
    return every.repartitionById(max(1, len(splits) + 1), F.col("part")).sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), "text")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """Each text against an edited form of it, and against the next one: a row for each row of docs.

    In the edited form the last half of the characters (rounded down) is replaced by as many of the next row's first ones,
    or all if it has fewer. The next row is that with the next id; rows with one id follow each other by text, a null id
    comes first, and after the last row comes the first, also if it is the only one.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, last = _sampler(samples, words), None  # last: part, guest, id, text and signature of the row before
        for batch in batches:
            for piece in slices(batch, 3, SLICE):
                texts = as_bytes(piece.column(3))
                signatures = sampler.signatures(texts)
                rows = list(zip(*(piece.column(k).to_pylist() for k in range(3)), texts, signatures, strict=True))
                pairs = [(a, b) for a, b in zip([last, *rows[:-1]], rows, strict=True) if a is not None and a[0] == b[0] and not a[1]]
                last = rows[-1]
                forms, sizes = [], []
                for a, b in pairs:
                    body, follower = a[3].decode("utf-8", "replace"), b[3].decode("utf-8", "replace")
                    half = len(body) // 2
                    forms.append((body[: len(body) - half] + follower[:half]).encode())
                    sizes.append(len(body))
                if pairs:
                    mine, next_one, changed = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs]), sampler.signatures(forms)
                    columns = [[a[2] for a, _ in pairs], sizes, [hashlib.sha256(x).hexdigest() for x in forms], list(map(_hex, mine)), list(map(_hex, changed)), (mine == changed).mean(1), (mine == next_one).mean(1)]
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=_EDITED.names)

    return _dealt(own).mapInArrow(run, _EDITED)

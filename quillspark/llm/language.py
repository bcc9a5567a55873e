"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a sample of labelled text accepts every substring of the sample. A text is parsed
from left to right into phrases, each the longest match from where it starts; the language in whose automaton the text
needs the fewest phrases, each weighed by the bits that tell a place in that sample, wins; the bits that tell the language,
by its share of the labelled documents, are added, which decides texts of a few letters. Texts are parsed in blocks of
256 bytes, all blocks of a batch side by side, for every language from the same block starts; nothing of a text is left out.

The sample: for each language the labelled document with the least hash in each of BUCKETS buckets, of each an excerpt;
SAMPLE_CHARS in all, shared out evenly among the languages, but LEAST_CHARS for each however many there are. Automata of
GROUP languages are held by a task at once; with more languages texts are parsed once for each group of them.

Labels are used of rows with a doc_id, text and language whose crc32(doc_id as text) mod 4 is not 2. Null text or text
without a letter is `und` with score 0; so is every text if nothing could be learned. A tie goes to the first name. The
score is the share of bits saved against the second language, 1 if only one language is known. Each input row gives a row,
also rows that are alike; an empty table gives none. Columns named as the results are replaced, others pass through.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import append_columns, worker_cache

BUCKETS = 64
GROUP = 256
SAMPLE_CHARS, LEAST_CHARS = 160_000, 600
EXCERPT = 4_000
BLOCK = 256

_LETTER = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(doc_id):
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def letters_of(text: bytes) -> bytes:
    """Lower-case letters, everything else one space."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_LETTER).split())


def has_letter(text: bytes) -> bool:
    plain = text.lower().translate(_LETTER).split()
    return any(97 <= w[0] <= 122 or 97 <= w[-1] <= 122 for w in plain) or any(c.isalpha() for w in plain for c in w.decode("utf-8", "replace"))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, tuple[bytes, float]]:
    """For each language letters of labelled text, of about the same length, and its share of the labelled documents."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    seen = own.groupBy("lang", "bucket").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    total = seen.groupBy("lang").agg(F.sum("n").alias("n"))
    share = {r["lang"]: r["n"] for r in total.collect()}
    chosen = seen.select("lang", "bucket", "h")  # at most BUCKETS rows for each language
    if len(share) <= GROUP:
        chosen = F.broadcast(chosen)
    start = 1 + F.pmod(F.xxhash64(F.col("h"), F.lit(1)), F.greatest(F.length("text") - EXCERPT, F.lit(1))).cast("int")
    got = own.join(chosen, ["lang", "bucket", "h"]).select("lang", "bucket", F.substring(F.col("text"), start, F.lit(EXCERPT)).alias("part"))
    parts: dict[str, dict[int, bytes]] = {}
    for row in sorted(got.distinct().collect(), key=lambda r: (r["lang"], r["bucket"], r["part"])):
        letters = letters_of(row["part"].encode())
        if letters:
            parts.setdefault(row["lang"], {}).setdefault(row["bucket"], letters)
    most = max(LEAST_CHARS, SAMPLE_CHARS // max(4, len(parts)))
    out = {}
    for name, own_parts in sorted(parts.items()):
        each = most // len(own_parts) + 1
        short = sum(min(each, len(x)) for x in own_parts.values())
        if short < most:  # some excerpts are short: more of the long ones
            each += (most - short) // max(1, sum(len(x) > each for x in own_parts.values()))
        out[name] = (b" ".join(x[:each] for _, x in sorted(own_parts.items()))[:most], share[name] / sum(share.values()))
    return out


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts the substrings of text; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Model:
    """For each language a table of steps: twice the next state's row, plus one if a phrase ends before the character."""

    def __init__(self, samples: dict[str, tuple[bytes, float]]) -> None:
        self.names = sorted(samples)
        known = sorted({c for x, _ in samples.values() for c in x} | {32})
        self.width = len(known) + 2  # and bytes that no sample has, and the filler
        place = {c: k for k, c in enumerate(known)}
        self.codes = np.full(256, self.width - 2, np.uint8)
        self.codes[known] = np.arange(len(known))
        self.filler = self.width - 1
        self.tables, self.bits, self.prior = [], [], []
        for name in self.names:
            text, share = samples[name]
            go = suffix_automaton(text)
            table = np.full((len(go), self.width), -1, np.int64)
            for state, edges in enumerate(go):
                for c, to in edges.items():
                    table[state, place[c]] = 2 * self.width * to
            restart = np.where(table[0] >= 0, table[0], 0) + 1
            table = np.where(table < 0, restart[None, :], table)
            table[:, self.filler] = 2 * self.width * np.arange(len(go))
            self.tables.append(table.astype(np.int32).ravel())
            self.bits.append(math.log2(len(text) + 2))
            self.prior.append(-math.log2(share))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Weighed phrases of each text in each language."""
        blocks = np.array([max(1, -(-len(x) // BLOCK)) for x in texts])
        grid = np.full((int(blocks.sum()), BLOCK), self.filler, np.uint8)
        flat, starts = grid.reshape(-1), np.cumsum(blocks) - blocks
        for x, at in zip(texts, starts * BLOCK, strict=True):
            flat[at : at + len(x)] = self.codes[np.frombuffer(x, np.uint8)]
        steps = np.ascontiguousarray(grid.T).astype(np.int32)
        out = np.zeros((len(texts), len(self.names)))
        for k, table in enumerate(self.tables):
            state, count = np.zeros(len(grid), np.int32), np.ones(len(grid), np.int32)
            value = np.empty_like(state)
            for step in steps:
                np.add(state, step, out=state)
                np.take(table, state, out=value, mode="clip")
                np.bitwise_and(value, 1, out=state)
                np.add(count, state, out=count)
                np.right_shift(value, 1, out=state)
            out[:, k] = np.add.reduceat(count, starts) * self.bits[k] + self.prior[k]
        return out


def predict(docs: DataFrame, samples: dict[str, tuple[bytes, float]], text: str = "text", group: int = GROUP) -> DataFrame:
    """docs with lang_pred and score, in the place of columns with these names. The samples travel with the tasks."""
    out = docs.drop("lang_pred", "score", "__l_best")
    names = sorted(samples)
    for at in range(0, max(1, len(names)), group):
        own = {name: samples[name] for name in names[at : at + group]}
        out = _parsed(out, own, text, "__l_best" in out.columns)
    lang, first, second = (F.col("__l_best")[k] for k in ("lang", "first", "second"))
    score = F.when(lang == "und", 0.0).when(second.isNull(), 1.0).otherwise(1 - first / second)
    return out.withColumn("lang_pred", lang).withColumn("score", score).drop("__l_best")


def _parsed(docs: DataFrame, samples: dict[str, tuple[bytes, float]], text: str, more: bool) -> DataFrame:
    """docs with __l_best: the language that takes the fewest bits, its bits and those of the second; with more, against an earlier one."""
    key = f"language-{uuid.uuid4().hex}"

    def make():
        model = worker_cache(key, lambda: Model(samples), 1) if samples else None

        def work(texts: list[bytes | None]) -> list:
            out: list[dict] = [{"lang": "und", "first": None, "second": None} for _ in texts]
            some = [k for k, x in enumerate(texts) if model and x and has_letter(x)]
            if some:
                bits = model.phrases([letters_of(texts[k]) for k in some])
                order = np.argsort(bits, axis=1, kind="stable")
                for k, row, rank in zip(some, bits, order, strict=True):
                    out[k] = {"lang": model.names[rank[0]], "first": float(row[rank[0]]), "second": float(row[rank[1]]) if len(rank) > 1 else None}
            return [out]

        return work

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.DoubleType()), T.StructField("second", T.DoubleType())])
    found = append_columns(docs, text, make, [T.StructField("__l_new", kind)], 2 << 20)
    if not more:
        return found.withColumnRenamed("__l_new", "__l_best")
    old, new = F.col("__l_best"), F.col("__l_new")
    other = F.struct(new["lang"].alias("lang"), new["first"].alias("first"), F.least(new["second"], old["first"]).alias("second"))
    held = F.struct(old["lang"].alias("lang"), old["first"].alias("first"), F.least(old["second"], new["first"]).alias("second"))
    return found.withColumn("__l_best", F.when(new["lang"] == "und", old).when((old["lang"] == "und") | (new["first"] < old["first"]), other).otherwise(held)).drop("__l_new")

"""Quality rules: a ledger of failure bits and measurements, policies over its bits, ablations by bitwise aggregation.

Each rule is evaluated once for each document. The ledger keeps what was measured and one bit for each rule; a policy is a
mask of rules, so another policy version, or a policy without one of its rules, needs no second look at the texts.

Null text has no words and fails `few_words`. Empty text is the same. Every input row gives one row, also rows that are
alike; an empty table gives none. A very long text is measured whole, in memory of a task once. Other columns are ignored
by ledger() and passed through by keep(), whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import append_columns

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

_BIG, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_TAIL = bytes(range(0x80, 0xC0))


#: Rule name and the condition under which a document fails, in the order of the bits.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "{n_words} < 20"),
    ("repeated_windows", "100 * {n_repeat_words} > 30 * {n_words}"),
    ("symbols", "100 * {n_symbols} > 30 * {n_words}"),
    ("shouting", "{n_upper} > {n_lower}"),
    ("repeated_lines", "100 * {n_dup_lines} > 60 * {n_lines}"),
    ("word_length", "{word_chars} > 40 * {n_words}"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policy versions: which rules reject.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BIT["symbols"] | BIT["shouting"],
    "v3": BASE | BIT["symbols"] | BIT["shouting"] | BIT["repeated_lines"] | BIT["word_length"],
}


def _repeated(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """For each document: words in windows of WINDOW words that the document holds twice or more.

    Equal sums of random word weights mark windows that may be equal; only documents with such are looked at exactly.
    """
    docs = len(counts)
    out = np.zeros(docs, np.int64)
    n = len(words)
    if n < WINDOW:
        return out
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    weight = np.random.default_rng(7).integers(1, 2**63, len(index), dtype=np.uint64)
    owner = np.repeat(np.arange(docs, dtype=np.int64), counts)
    with np.errstate(over="ignore"):
        own = weight[ids] ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mixed = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            mixed = mixed * np.uint64(0xD1342543DE82EF95) + own[k : n - WINDOW + 1 + k]
    inside = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    order = np.sort(mixed[inside])
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return out
    maybe = np.unique(owner[: n - WINDOW + 1][inside & np.isin(mixed, twice)])
    starts = np.concatenate([[0], np.cumsum(counts)])
    for d in maybe:
        out[d] = _repeated_exactly(ids[starts[d] : starts[d + 1]])
    return out


def _repeated_exactly(ids: np.ndarray) -> int:
    ranks = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < WINDOW:  # the rank of 2, 4, 8 words in a row
        ranks = np.unique(ranks[:-step] * np.int64(len(ids) + 1) + ranks[step:], return_inverse=True)[1].astype(np.int64)
        step *= 2
    hit = np.bincount(ranks)[ranks] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[WINDOW : WINDOW + len(hit)] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _kernel():
    def work(texts: list[bytes | None]) -> list:
        rows: list[list[int]] = []
        words: list[bytes] = []
        counts = []
        for text in texts:
            text = text or b""
            own = text.split()
            words += own
            counts.append(len(own))
            lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
            chars = len(text.translate(None, _TAIL))
            rows.append([len(own), chars - (len(text) - len(text.translate(None, SPACE))), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines), len(text) - len(text.translate(None, _BIG)), len(text) - len(text.translate(None, _SMALL))])
        repeated = _repeated(words, np.array(counts, np.int64))
        columns = [list(x) for x in zip(*rows, strict=True)]
        columns[MEASURES.index("n_repeat_words")] = repeated.tolist()
        return columns

    return work


def _bits(prefix: str) -> Column:
    total = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(RULES):
        total = total + F.when(F.expr(failed.format(**{m: prefix + m for m in MEASURES})), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def _measured(docs: DataFrame, text: str) -> DataFrame:
    fields = [T.StructField(f"__q_{m}", T.LongType()) for m in MEASURES]
    return append_columns(docs, text, _kernel, fields).withColumn("__q_bits", _bits("__q_"))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and failed_bits: one row for each row of docs."""
    found = _measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    return found.select("doc_id", *[F.col(f"__q_{m}").alias(m) for m in MEASURES], F.col("__q_bits").alias("failed_bits"))


def apply_policy(book: DataFrame, policy: str | int) -> DataFrame:
    """The ledger with base_failed and kept under a policy (a version, or a mask of rule bits)."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return book.withColumns({"base_failed": F.col("failed_bits").bitwiseAND(BASE) != 0, "kept": F.col("failed_bits").bitwiseAND(mask | BASE) == 0})


def ablations(book: DataFrame, policy: str | int) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that only it rejects, and that stay without it."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    bits = F.col("failed_bits").bitwiseAND(mask)
    seen = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if mask & BIT[name]])).alias("r")
    each = seen.select("bits", "n", rules).select("bits", "n", "r.*")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((F.col("bits") != 0) & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("bits_seen"),
    )


def keep(docs: DataFrame, policy: str | int = "v2", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that pass the policy."""
    mask = (POLICIES[policy] if isinstance(policy, str) else policy) | BASE
    return _measured(docs, text).filter(F.col("__q_bits").bitwiseAND(mask) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

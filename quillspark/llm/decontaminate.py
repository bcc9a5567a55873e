"""Benchmark decontamination: one Aho-Corasick automaton over normalised test windows, each text scanned once.

Words are runs of digits, letters a-z (A-Z lower-cased) and bytes of non-ASCII characters. A window is 13 consecutive words
of an item, or all words of a shorter item. A document's words inside any occurrence of a window are hit, and spans give
these in code points of the original text.

The automaton holds at most SHARD_BYTES of windows. A larger benchmark makes several automata, one scan each, with the
hits so far carried along in a table in the shared folder; no size of benchmark is broadcast as a whole.

Null or empty text, and text without words: no words, no hits, not contaminated. Null or empty items have no windows.
Items that are alike all count. Each input row gives one row, also rows that are alike; an empty table gives none, and
without a benchmark nothing is hit. A very long text is scanned whole, in memory of a task once. Other columns pass through
contaminated rows and clean ones, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import _arrow_type, as_bytes, slices, worker_cache
from quillspark.session import write_shared

WINDOW = 13
#: Bytes of window text in one automaton; about 50 times as much memory in each Python worker.
SHARD_BYTES = 2_000_000

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_NORMAL = bytes(c if c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_STATE = [
    T.StructField("__d_spans", T.ArrayType(T.IntegerType())),  # starts and ends of hit words, in turn
    T.StructField("__d_items", T.ArrayType(T.StringType())),
    T.StructField("__d_words", T.LongType()),
    T.StructField("__d_hit", T.LongType()),
    T.StructField("__d_chars", T.ArrayType(T.IntegerType())),  # the same spans in code points
]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def windows_of(words: list[bytes]) -> Iterator[bytes]:
    if words:
        for i in range(max(1, len(words) - WINDOW + 1)):
            yield b" ".join(words[i : i + WINDOW])


def _shards(items: Iterable, most: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """Windows with the items that have them, in parts of about `most` bytes."""
    held: dict[bytes, list[str]] = {}
    size = 0
    for item_id, text in items:
        for window in windows_of(words_of(text.encode() if text is not None else None)):
            own = held.setdefault(window, [])
            if not own:
                size += len(window)
            if not own or own[-1] != str(item_id):
                own.append(str(item_id))
                size += 16
            if size >= most:
                yield list(held.items())
                held, size = {}, 0
    if held:
        yield list(held.items())


def _automaton(windows: list[tuple[bytes, list[str]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (window, _) in enumerate(windows):
        found.add_word(f" {window.decode('latin-1')} ", (k, window.count(b" ") + 1))
    found.make_automaton()
    return found


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _char_spans(text: bytes, spans: list[int]) -> list[int]:
    """Spans of words as code points of the original text."""
    plain = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [int(point[starts[spans[i]]] if i % 2 == 0 else point[ends[spans[i] - 1]]) for i in range(len(spans))]


def _scan(text: bytes | None, automaton, windows, spans: list[int], items: list[str]):
    words = words_of(text)
    if automaton is not None and words:
        flat = b" %s " % b" ".join(words)
        gaps, fresh, seen = None, [], set()
        for end, (k, n) in automaton.iter(flat.decode("latin-1")):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
            last = int(np.searchsorted(gaps, end))
            fresh.append((last - n, last))
            seen.add(k)
        if seen:
            spans = _merged([*zip(spans[::2], spans[1::2], strict=True), *fresh])
            items = sorted({*items, *(x for k in seen for x in windows[k][1])})
    return spans, items, len(words)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with the columns __d_*: hit spans, items, counts. See decontaminated() and report()."""
    spark = docs.sparkSession
    names = list(docs.columns)
    at = names.index(text)
    out = T.StructType([*docs.schema.fields, *_STATE])
    arrow = [_arrow_type(f.dataType) for f in _STATE]

    def scanned(df: DataFrame, windows) -> DataFrame:
        shared = spark.sparkContext.broadcast(windows)
        key, first, width = f"aho-{uuid.uuid4().hex}", "__d_spans" not in df.columns, len(names)

        def run(batches):
            own = shared.value
            automaton = worker_cache(key, lambda: _automaton(own), 1) if own else None
            for batch in batches:
                for part in slices(batch, at):
                    texts = as_bytes(part.column(at))
                    before = [([], [])] * len(texts) if first else list(zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist(), strict=True))
                    rows = []
                    for t, (spans, items) in zip(texts, before, strict=True):
                        spans, items, n = _scan(t, automaton, own, spans, items)
                        rows.append((spans, items, n, sum(spans[1::2]) - sum(spans[::2]), _char_spans(t, spans) if spans else []))
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *[pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), arrow, strict=True)]], names=out.names)

        return df.mapInArrow(run, out)

    items = benchmark.select(F.col(item_id), F.col(item_text)).toLocalIterator()
    df, before = docs, None
    for windows in _shards(items, shard_bytes):
        if before is not None:
            df = write_shared(scanned(df, before), "decontaminate")
        before = windows
    return scanned(df, before)


def _is_contaminated():
    return (F.col("__d_hit") > 0) & (20 * F.col("__d_hit") >= F.col("__d_words"))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated and spans (start and end in the original text) for each row of docs."""
    found = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **kw)
    chars = F.col("__d_chars")
    spans = F.transform(F.sequence(F.lit(1), F.floor(F.size(chars) / 2).cast("int")), lambda i: F.struct(F.element_at(chars, 2 * i - 1).alias("start"), F.element_at(chars, 2 * i).alias("end")))
    return found.select(
        "doc_id",
        F.col("__d_words").alias("n_words"),
        F.col("__d_hit").alias("n_hit"),
        F.col("__d_items").alias("items"),
        _is_contaminated().alias("contaminated"),
        F.when(F.size(chars) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    return find(docs, benchmark, text, **kw).filter(~_is_contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

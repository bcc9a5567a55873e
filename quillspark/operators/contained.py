"""How many of the words of each question a text holds, wherever they stand in it: Arrow batches, by the bytes of the texts.

Words that questions share are looked for once for all of them, and only those all of whose runs of 3, 5 or 8 bytes stand in a text,
by a hash; a text is then searched for the word itself. Questions are held by the driver and by every task, so that a
caller with many deals them out in blocks. Texts that are null or hold none of the words give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Questions of a row at most, which bounds what a batch of rows takes.
QUESTIONS = 256
WORDS = "words array<struct<query_id:long,lexical:long>>"


#: Bits of the hash of a run, and how long runs are: those of a word are the longest that it has.
BITS, SIZES = 18, (3, 5, 8)


def _runs(text: bytes, size: int) -> np.ndarray:
    """The hashes of all runs of so many bytes of a text."""
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    n = max(0, len(data) - size + 1)
    return sum((data[i : i + n] * pow(37, i, 1 << BITS) for i in range(size)), np.zeros(n, np.int64)) & ((1 << BITS) - 1)


def holding(asked: pa.Table) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """asked: query_id, terms (array, each word once). Of batches of id and text: id and WORDS, those of QUESTIONS questions in a row."""
    ids = asked.column("query_id").to_numpy()
    terms = asked.column("terms").combine_chunks()
    question = np.repeat(np.arange(len(ids)), terms.value_lengths().fill_null(0).to_numpy())
    coded = terms.flatten().dictionary_encode()
    words, word = [w.encode() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy()
    short = [i for i, w in enumerate(words) if len(w) < SIZES[0]]
    longer = []  # by size of runs: words, the runs of all, where each word's begin
    for size, more in zip(SIZES, [*SIZES[1:], np.inf], strict=True):
        some = [i for i, w in enumerate(words) if size <= len(w) < more]
        if some:
            runs = [_runs(words[i], size) for i in some]
            longer.append((size, np.array(some), np.concatenate(runs), np.cumsum([0, *map(len, runs)])[:-1]))
    kind = pa.struct([("query_id", pa.int64()), ("lexical", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stands = np.zeros(1 << BITS, bool)
        for batch in batches:
            rows, sizes, found = [], [], []
            for at, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if text is None or not words:
                    continue
                able = list(short)
                for size, some, runs, start in longer:
                    own = _runs(text, size)
                    stands[own] = True
                    able += some[np.logical_and.reduceat(stands[runs], start)].tolist()
                    stands[own] = False
                held = np.zeros(len(words), bool)
                held[[i for i in able if words[i] in text]] = True
                counts = np.bincount(question[held[word]], minlength=len(ids))
                some = np.flatnonzero(counts)
                for k in range(0, len(some), QUESTIONS):
                    rows.append(at)
                    sizes.append(len(some[k : k + QUESTIONS]))
                found.append((ids[some], counts[some]))
            of, n = (np.concatenate([np.zeros(0, np.int64), *[f[c] for f in found]]).astype(np.int64) for c in (0, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(of), pa.array(n)], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), lists], names=["chunk_id", "words"])

    return run

"""Packing by minimum bin slack: documents as token ids, cut and packed into windows of 1024, of which only the last is padded.

A document's ids, with the end id 0, fill as many whole windows as they can; what is left (1 to 1023 ids) is its rest.
The lengths of the rests are a multiset over at most 1023 values, however many documents there are. Its counts go to
the driver, which repeats one step: take the longest length left, find by a bitset subset-sum over the remaining counts
the multiset that fills the window to its capacity, read it back from the bitsets, and use it as often as the
counts allow. Each step uses up a length, so the plan has about as many steps as there are lengths. Rests then find
their place by their rank among the rests of their length: a count for each input partition and a running sum.

Rests that no multiset fills up are laid end to end, and cut where a window ends: once at most, as none is longer than a
window. So all windows but the last are full, however skewed the lengths are. The ids of a rest go with it for the
checksums of its two pieces.

Null and empty texts have one id, the end id. Each input row is packed, also rows that are alike. Very long texts become
many whole windows. Rests of equal length take their places in the order of their partitions. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import as_bytes, slices, worker_cache
from quillspark.session import write_shared

CAPACITY = 1024
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 300_000
#: The split of a byte-level BPE into words; fixed by the tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ODD = re.compile(r"\s\s|^\s|\s$")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file of a byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordIds(dict):
    """Ids of a word with the space before it, as little-endian unsigned 32-bit bytes; made when first asked for.

    special: names of special tokens in a text give their ids, as the tokenizer has it by default; else they are plain text.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        names = [t["content"] for t in whole.get("added_tokens") or []]
        self.named = re.compile("|".join(map(re.escape, names))) if special and names else None
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): k for token, k in model["vocab"].items() if all(c in back for c in token) and token not in names}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.stored = "<u2" if max([0, *ranks.values()]) < 1 << 16 and self.exact.get_vocab_size() <= 1 << 16 else "<u4"
        self.exact.encode_special_tokens = not special

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = self.whole(f" {word}")
        return ids

    def whole(self, text: str) -> bytes:
        try:
            ids = self.fast.encode_ordinary(text)
        except Exception:  # white space too long for its pattern engine
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        """The ids of a text. Words apart by single spaces have the same ids alone as in the text."""
        if not text:
            return b""
        if self.named and self.named.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _ODD.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


_CUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("crcs", T.ArrayType(T.LongType())),  # of the whole windows
        T.StructField("rest", T.IntegerType()),
        T.StructField("rest_crc", T.LongType()),
        T.StructField("rest_ids", T.BinaryType()),  # unsigned, of 16 bits where all ids have no more, else of 32
        T.StructField("part", T.IntegerType()),
        T.StructField("rank", T.LongType()),  # among pieces of this length of this partition
        T.StructField("before", T.LongType()),  # whole windows of this partition before
    ]
)

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(docs: DataFrame, tokenizer: str, capacity: int, special: bool) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        words = worker_cache(("word-ids", tokenizer, special), lambda: WordIds(tokenizer, special))
        part, ranks, whole = TaskContext.get().partitionId(), Counter(), 0
        end = np.array([0], "<u4").tobytes()
        for batch in batches:
            for piece in slices(batch, 1):
                rows = []
                for doc_id, text in zip(piece.column(0).to_pylist(), as_bytes(piece.column(1)), strict=True):
                    ids = words.of((text or b"").decode("utf-8", "replace")) + end
                    n, step = len(ids) // 4, 4 * capacity
                    full = n // capacity
                    rest = n % capacity
                    rows.append((doc_id, n, [zlib.crc32(ids[k * step : (k + 1) * step]) for k in range(full)], rest, zlib.crc32(ids[full * step :]) if rest else 0, np.frombuffer(ids, "<u4", rest, full * step).astype(words.stored).tobytes(), part, ranks[rest], whole))
                    ranks[rest] += 1
                    whole += full
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=_CUT.names)

    return docs.mapInArrow(run, _CUT)


def _closest(counts: dict[int, int], room: int, targets: list[int]) -> dict[int, int]:
    """A multiset of the lengths that sums to the first of the targets that can be reached, else to the most that can."""
    steps: list[tuple[int, int, int]] = []
    reach = 1
    keep = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        times = min(counts[length], room // length)
        steps.append((length, times, reach))
        before, take = reach, 1
        while times > 0:  # multiplicities in powers of two
            use = min(take, times)
            reach |= (reach << (use * length)) & keep
            times -= use
            take *= 2
        if reach >> targets[0] & 1 and reach != before:
            break
    total = next((t for t in targets if reach >> t & 1), reach.bit_length() - 1)
    used: dict[int, int] = {}
    for length, times, before in reversed(steps):
        for k in range(times + 1):
            if total - k * length >= 0 and before >> (total - k * length) & 1:
                if k:
                    used[length] = k
                total -= k * length
                break
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, slack: bool = True) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where pieces go: rows of length, first rank, pieces, pieces a window, first window, offset; and the number of windows.

    Nothing is cut. If no multiset fills a window, one that sums to a power of two is preferred to one with slack. Without
    slack, only full windows are made, and the last ranks of some lengths have no place.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    taken: Counter = Counter()
    rows, windows = [], 0
    powers = [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if 1 << k < capacity]
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v - (k == longest) > 0}
        room = capacity - longest
        used = Counter(_closest(rest, room, [room, *(p - longest for p in powers if p >= longest)]))
        used[longest] += 1
        if not slack and sum(k * n for k, n in used.items()) < capacity:
            del left[longest]
            continue
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken[length], n * times, n, windows, offset))
            taken[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        windows += times
    return rows, windows


def plan_cut(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """As plan(), with all windows full but the last. In rows with no pieces a window the offset is that of the first piece
    in a line of pieces end to end, which begins with the row's window and is cut where windows end."""
    rows, windows = plan(counts, capacity, slack=False)
    taken: Counter = Counter()
    for length, _, n, *_ in rows:
        taken[length] += n
    at = 0
    for length in sorted(counts, reverse=True):
        if n := counts[length] - taken[length]:
            rows.append((length, taken[length], n, 0, windows, at))
            at += n * length
    return rows, windows - -at // capacity


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, special: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. special: see WordIds."""
    tokenizer = tokenizer or default_tokenizer()
    cut = write_shared(_cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tokenizer, capacity, special), "packing")
    counts = {r["rest"]: r["n"] for r in cut.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}  # at most capacity - 1 rows
    rows, windows = plan_cut(counts, capacity)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 6)

    # The first rank of each partition, for each length; whole windows count as the length `capacity`.
    each = cut.filter("rest > 0").groupBy("part", F.col("rest").alias("kind")).agg(F.count("*").alias("n"))
    whole = cut.groupBy("part", F.lit(capacity).alias("kind")).agg(F.sum(F.size("crcs")).cast("long").alias("n"))
    running = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = each.unionByName(whole).withColumn("first", F.coalesce(F.sum("n").over(running), F.lit(0).cast("long")))
    # 'part' and 'kind' are unique: at most `capacity` entries for each partition
    firsts = first.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("kind", "first"))).alias("firsts"))
    placed = cut.join(firsts, "part").select("doc_id", "doc_tokens", "crcs", "rest", "rest_crc", "rest_ids", (F.col("rank") + F.coalesce(F.col("firsts")[F.col("rest")], F.lit(0))).alias("rank"), (F.col("before") + F.col("firsts")[F.lit(capacity)]).alias("before"))

    def run(batches):
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tokens, crcs, rest, rest_crc, rest_ids, rank, before = (batch.column(k) for k in range(8))
            ids_at, full = np.arange(batch.num_rows), np.array([len(x) for x in crcs.to_pylist()], np.int64)
            tokens, rest, rest_crc, rank, before = (np.asarray(x.to_numpy(zero_copy_only=False)).astype(np.int64) for x in (tokens, rest, rest_crc, rank, before))
            own = np.repeat(ids_at, full)
            step = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
            some = np.flatnonzero(rest > 0)
            sequence = offset = size = crc = second = np.zeros(0, np.int64)
            later = later_crc = second
            if len(some):
                at = np.searchsorted(keys, (rest[some] << 44) + rank[some], side="right") - 1
                line = table[at]
                nth, each = rank[some] - line[:, 1], np.maximum(line[:, 3], 1)
                place = line[:, 5] + np.where(line[:, 3] > 0, nth % each, nth) * rest[some]  # in a line, from the start of its first window
                sequence, offset = line[:, 4] + np.where(line[:, 3] > 0, nth // each, place // capacity), place % capacity
                size, crc = np.minimum(rest[some], capacity - offset), rest_crc[some].copy()
                second = np.flatnonzero(size < rest[some])
                later = (rest[some] - size)[second]
                later_crc = np.zeros(len(second), np.int64)
                for k, j in enumerate(second.tolist()):
                    stored = rest_ids[int(some[j])].as_py()
                    held = np.frombuffer(stored, f"<u{len(stored) // int(rest[some[j]])}").astype("<u4")
                    crc[j], later_crc[k] = zlib.crc32(held[: size[j]].tobytes()), zlib.crc32(held[size[j] :].tobytes())
            owner = np.concatenate([own, some, some[second]])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(owner)),
                    pa.array(np.concatenate([step * capacity, full[some] * capacity, full[some[second]] * capacity + size[second]])),
                    pa.array(np.concatenate([np.full(len(own), capacity), size, later])),
                    pa.array(np.concatenate([np.asarray(crcs.flatten()).astype(np.int64), crc, later_crc])),
                    pa.array(tokens[owner]),
                    pa.array(np.concatenate([windows + before[own] + step, sequence, sequence[second] + 1])),
                    pa.array(np.concatenate([np.zeros(len(own), np.int64), offset, np.zeros(len(second), np.int64)])),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(run, _PIECE)

"""Suffix-array dedup: removes every byte that a 200-byte string covers which starts anywhere else in the corpus too.

A suffix array of all bytes isn't needed: in each 200-byte window the 48-byte gram with the least hash is an anchor, chosen
by the window's content alone, so that equal windows have equal anchors in the same place. The suffixes at anchors are the
array's entries, about one for 60 bytes. An entry stands for the run of windows that share the anchor.

1. Entries are range-partitioned by their leading tokens (the anchor gram, then the run's whole content, as hashes) between
   sampled splitters, and sorted in their partition. A run whose content equals a neighbour's is a copy in full. A run
   that only shares its anchor with a neighbour may be a copy in part. So may one at the partition's edge, whose other
   neighbour is in another partition.
2. Runs that may be copies in part are cut into cells of 64 windows, with their bytes. All windows of a cell share a core of
   137 bytes; cells are range-partitioned and sorted by core and content. Within a core the windows are compared byte for
   byte by a multikey sort over 8-byte tokens that drops what stands alone after each token.
3. Cores at a partition's edge, or with more than LIMIT different contents, give one row for each window instead, counted
   by an aggregation, so that neither a boundary nor a very common passage gathers in one task.

Which runs take part in step 2 reaches the second scan as a Bloom filter sized by their number; what it lets through in
excess is compared and found to be alone. Hashes are 64-bit in pairs (anchor and content; core and content or window).

What differs from a textbook suffix array: the order of leading tokens is that of their hashes, which brings equal ones
together, and that is all that is asked of it; Spark sorts the partitions, and the multikey sort the windows of a core;
what meets at a boundary is counted again instead of being compared in place.

Null text is empty: nothing removed. Texts under 200 bytes have no window. Repeated rows are each other's copies, and each
input row gives one row; an empty table gives none. Very long texts are scanned in overlapping parts. Other columns pass
through dedup(), whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import as_bytes, slices
from quillspark.session import Written, write_shared

WINDOW = 200
GRAM = 48
CELL = 64
CORE = WINDOW - CELL + 1
#: Bytes scanned at once; positions in them take POSITION bits of the anchor keys.
PART, POSITION = 2 << 20, 23
#: Different contents of one core that a task compares.
LIMIT = 5_000
#: Bits of the filter that tells the second scan which runs to cut: at least FILTER_EACH for each run, a power of two in
#: FILTER_BITS. Beyond the most, more runs than needed are cut, compared and found to be alone.
FILTER_EACH, FILTER_BITS = 16, (1 << 16, 1 << 28)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Hasher:
    """Hashes of all ranges of a byte string, from sums of weighed bytes; equal bytes have equal hashes anywhere."""

    def __init__(self) -> None:
        self.weights = np.random.default_rng(20).integers(0, 2**64, 256, dtype=_U)
        self.up = self.down = np.ones(0, _U)

    def load(self, data: np.ndarray) -> None:
        if len(self.up) <= len(data):
            n = max(len(data) + 1, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, x, _U)]), dtype=_U) for x in (_BASE, _BACK))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.weights[data] * self.down[: len(data)], dtype=_U)])

    def ranges(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.up[start] + _U(0xD6E8FEB86659FD93) * np.atleast_1d(size).astype(_U))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return self.ranges(np.arange(n), np.full(1, size))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima within blocks of that width."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, _U(2**64 - 1))]).reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def _parts(texts: list[bytes | None]):
    """Groups of (text, its place in texts, offset) of at most about PART bytes; parts of a long text overlap by a window."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if not text or len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, PART):
            piece = text[at : at + PART + WINDOW - 1]
            if size and size + len(piece) > PART:
                yield held
                held, size = [], 0
            held.append((piece, k, at))
            size += len(piece)
    if held:
        yield held


class Runs:
    """The runs of windows with one anchor in a group of texts, as arrays."""

    def __init__(self, hasher: Hasher, group: list[tuple[bytes, int, int]]) -> None:
        self.data = b"".join(x for x, _, _ in group)
        sizes = np.array([len(x) for x, _, _ in group])
        starts = np.cumsum(sizes) - sizes
        hasher.load(np.frombuffer(self.data, np.uint8))
        grams = hasher.grams(GRAM)
        low = _U((1 << POSITION) - 1)
        best = _least((grams & ~low) | np.arange(len(grams), dtype=_U), WINDOW - GRAM + 1)
        anchor = (best & low).astype(np.int64)
        owner = np.repeat(np.arange(len(group)), sizes)[: len(anchor)]
        inside = np.arange(len(anchor)) + WINDOW <= (starts + sizes)[owner]
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~new[1:], [False]]))
        self.first = np.flatnonzero(new)
        self.count = ends - self.first + 1
        self.anchor = anchor[self.first]
        self.key = grams[self.anchor]
        own = owner[self.first]
        self.text = np.array([k for _, k, _ in group])[own]
        self.shift = (np.array([at for _, _, at in group]) - starts)[own]  # from a place here to one in the text
        self.content = hasher.ranges(self.first, self.count + WINDOW - 1)
        self.at = ((self.first + self.shift) << 8) | (self.count - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan_runs(docs: DataFrame) -> DataFrame:
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, 1, PART):
                refs = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for group in _parts(as_bytes(part.column(1))):
                    r = Runs(hasher, group)
                    yield pa.RecordBatch.from_arrays([_signed(r.key), _signed(r.content), pa.array(refs[r.text]), pa.array(r.at)], names=["key", "content", "ref", "at"])

    return docs.mapInArrow(run, "key long, content long, ref long, at long")


def _mark(batches):
    """Rows sorted by key and content -> ref, at, flags: 1 for a copy in full, 2 for a run to be cut into cells."""
    held: list[np.ndarray] | None = None
    first = True

    def flags(key, content, open_start: bool, open_end: bool) -> np.ndarray:
        same_key = key[1:] == key[:-1]
        same = same_key & (content[1:] == content[:-1])
        before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
        key_before, key_after = np.concatenate([[open_start], same_key]), np.concatenate([same_key, [open_end]])
        copy = before | after
        cut = (~before & key_before) | (~after & key_after)  # alone: either neighbour has its key; a copy: the ends of its row of copies
        return copy.astype(np.int8) + 2 * cut.astype(np.int8)

    def chunk(columns: list[np.ndarray], drop_first: bool, keep_last: bool, open_start: bool, open_end: bool):
        f = flags(columns[0], columns[1], open_start, open_end)
        body = slice(1 if drop_first else 0, len(f) - 1 if keep_last else len(f))
        some = np.flatnonzero(f[body]) + body.start
        return pa.RecordBatch.from_arrays([pa.array(columns[2][some]), pa.array(columns[3][some]), pa.array(f[some])], names=["ref", "at", "flags"])

    # Two rows are held: the last, whose flags aren't known yet, and the one before it, which they depend on.
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        columns = own if held is None else [np.concatenate([h, x]) for h, x in zip(held, own, strict=True)]
        yield chunk(columns, drop_first=not first and len(held[0]) > 1, keep_last=True, open_start=first or len(held[0]) == 1, open_end=True)
        first = False
        held = [x[-2:].copy() for x in columns]
    if held is not None:
        yield chunk(held, drop_first=len(held[0]) > 1, keep_last=False, open_start=True, open_end=True)


def _bits_of(ref: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(_mix(ref.view(_U)) * _BASE + at.view(_U))
    return (h >> _U(32)) % _U(bits), (h & _U(0xFFFFFFFF)) % _U(bits)


def _let_through(words: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the runs that may be among those of a filter."""
    one, two = _bits_of(ref, at, 64 * len(words))
    return np.flatnonzero((words[one >> _U(6)] >> (one & _U(63))) & (words[two >> _U(6)] >> (two & _U(63))) & _U(1))


def _filter(marks: DataFrame) -> np.ndarray:
    """A Bloom filter of the runs (ref, at) that are flagged to be cut."""
    marks = marks.filter(F.col("flags").bitwiseAND(F.lit(2)) != 0).select("ref", "at")
    bits = min(max(1 << (FILTER_EACH * marks.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def run(batches):
        words = np.zeros(bits // 64, _U)
        for batch in batches:
            if batch.num_rows:
                for bit in _bits_of(*(batch.column(k).to_numpy(zero_copy_only=False).copy() for k in range(2)), bits):
                    np.bitwise_or.at(words, (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _signed(words[some])], names=["word", "bits"])

    rows = marks.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, _U)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(_U)
    return words


_CELLS = "core long, content long, ref long, at long, off int, data binary"


def _scan_cells(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """The cells of the runs that the filter lets through. off: the place of the first window in its cell."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        hasher, wanted = Hasher(), shared.value
        for batch in batches:
            for part in slices(batch, 1, PART):
                refs = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for group in _parts(as_bytes(part.column(1))):
                    r = Runs(hasher, group)
                    some = _let_through(wanted, refs[r.text], r.at)
                    if not len(some):
                        continue
                    far, near = r.anchor[some] - r.first[some], r.anchor[some] - r.first[some] - r.count[some] + 1
                    pieces = far // CELL - near // CELL + 1
                    own = np.repeat(some, pieces)
                    cell = np.repeat(far // CELL, pieces) - (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                    begin = np.minimum(np.repeat(far, pieces), cell * CELL + CELL - 1)  # distances from the anchor
                    end = np.maximum(np.repeat(near, pieces), cell * CELL)
                    first, count = r.anchor[own] - begin, begin - end + 1
                    core = hasher.ranges(r.anchor[own] - cell * CELL, CORE) + _U(0x2545F4914F6CDD1D) * cell.astype(_U)
                    content = hasher.ranges(first, count + WINDOW - 1) + _U(0x2545F4914F6CDD1D) * begin.astype(_U)
                    data = [r.data[a : a + n] for a, n in zip(first.tolist(), (count + WINDOW - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [_signed(_mix(core)), _signed(_mix(content)), pa.array(refs[r.text[own]]), pa.array(((first + r.shift[own]) << 8) | (count - 1)), pa.array((CELL - 1 - begin % CELL).astype(np.int32)), pa.array(data, pa.binary())],
                        names=["core", "content", "ref", "at", "off", "data"],
                    )

    return docs.mapInArrow(run, _CELLS)


def multikey(data: np.ndarray, place: np.ndarray, group: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which of the strings data[place : place + size] have an equal in their group: a sort by one 8-byte token after
    another in which only strings that aren't alone stay."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    token = np.zeros(len(data), _U)
    for k in range(8):
        token |= padded[k : len(data) + k] << _U(56 - 8 * k)
    left, cls = np.arange(len(place)), group.astype(np.int64)
    for k in range(0, size, 8):
        own = token[place[left] + k]
        if size - k < 8:
            own >>= _U(64 - 8 * (size - k))
        order = np.lexsort((own, cls))
        left, cls, own = left[order], cls[order], own[order]
        equal = (cls[1:] == cls[:-1]) & (own[1:] == own[:-1])
        some = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        cls = np.cumsum(np.concatenate([[True], ~equal]))[some]
        left = left[some]
        if not len(left):
            break
    out = np.zeros(len(place), bool)
    out[left] = True
    return out


class _Resolver:
    """Cells sorted by core and content -> rows of kind 0 (ref, at: a run of windows that are copies) and 1 (a window)."""

    def __init__(self) -> None:
        self.hasher = Hasher()
        self.batch: list[tuple[int, list]] = []
        self.weight = 0

    def solved(self):
        if not self.batch:
            return
        rows = [(g, *row) for g, own in self.batch for row in own]
        self.batch, self.weight = [], 0
        data = np.frombuffer(b"".join(x[4] for x in rows), np.uint8)
        sizes = np.array([len(x[4]) for x in rows])
        starts, counts = np.cumsum(sizes) - sizes, sizes - WINDOW + 1
        owner = np.repeat(np.arange(len(rows)), counts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        group = np.array([x[0] for x in rows])[owner] * CELL + np.array([x[3] for x in rows])[owner] + step
        hit = np.flatnonzero(multikey(data, starts[owner] + step, group))
        if len(hit):
            cut = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            cut = np.union1d(cut, np.flatnonzero(np.diff(owner[hit], prepend=-1) != 0))
            n = np.diff(np.append(cut, len(hit)))
            at = (np.array([x[2] for x in rows])[owner[hit[cut]]] >> 8) + step[hit[cut]]
            yield self.rows(0, np.zeros(len(cut), _U), np.zeros(len(cut), _U), np.array([x[1] for x in rows])[owner[hit[cut]]], (at << 8) | (n - 1))

    def windows(self, core: int, row):
        ref, at, off, data = row
        self.hasher.load(np.frombuffer(data, np.uint8))
        first = np.arange(len(data) - WINDOW + 1)
        own = _mix(self.hasher.ranges(first, WINDOW) + _U(0x2545F4914F6CDD1D) * (first + off).astype(_U))
        return self.rows(1, np.full(len(first), core, np.int64).view(_U), own, np.full(len(first), ref), ((at >> 8) + first) << 8)

    @staticmethod
    def rows(kind: int, core, window, ref, at):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ref), kind, np.int8)), _signed(core), _signed(window), pa.array(ref.astype(np.int64)), pa.array(at.astype(np.int64))], names=["kind", "core", "window", "ref", "at"])

    def __call__(self, batches):
        core, groups, own, edge, spread, last = None, 0, [], True, False, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            copies: list[tuple[int, int]] = []
            for c, content, ref, at, off, data in zip(*columns, strict=True):
                if c != core:
                    if core is not None:
                        yield from self.close(groups, core, own, edge, spread)
                        edge = False
                    core, own, spread, last = c, [], False, None
                    groups += 1
                if last is not None and last[0] == content:
                    if not last[3]:
                        copies.append(last[1:3])
                    copies.append((ref, at))
                    last = (content, ref, at, True)
                    continue
                last = (content, ref, at, False)
                row = (ref, at, off, data)
                if spread:
                    yield self.windows(c, row)
                else:
                    own.append(row)
                    if len(own) > LIMIT:
                        for x in own:
                            yield self.windows(c, x)
                        own, spread = [], True
            if copies:
                ref, at = np.array(copies, np.int64).T
                yield self.rows(0, np.zeros(len(ref), _U), np.zeros(len(ref), _U), ref, at)
        if core is not None:
            yield from self.close(groups, core, own, True, spread)
        yield from self.solved()

    def close(self, group: int, core: int, own: list, edge: bool, spread: bool):
        if spread:
            return
        if edge:
            for row in own:
                yield self.windows(core, row)
        elif len(own) > 1:
            self.batch.append((group, own))
            self.weight += sum(len(x[3]) - WINDOW + 1 for x in own)
            if self.weight > 200_000:
                yield from self.solved()


def _resolve(batches):
    return _Resolver()(batches)


def repeats(docs: DataFrame) -> DataFrame:
    """ref, spans: for each document with repeats the runs of windows found, as start * 256 + number - 1. docs: ref, text."""
    runs = Written(_scan_runs(docs), "suffix-runs")
    entries = ["key", "content", "ref", "at"]
    marks = write_shared(runs.read().repartitionByRange(*entries).sortWithinPartitions(*entries).mapInArrow(_mark, "ref long, at long, flags byte"), "suffix-marks")
    runs.drop()
    cells = Written(_scan_cells(docs, _filter(marks)), "suffix-cells")
    entries = ["core", "content", "ref", "at"]
    found = write_shared(cells.read().repartitionByRange(*entries).sortWithinPartitions(*entries).mapInArrow(_resolve, "kind byte, core long, window long, ref long, at long"), "suffix-found")
    cells.drop()
    single = found.filter("kind = 1")
    twice = single.groupBy("core", "window").agg(F.count("*").alias("n")).filter("n > 1").select("core", "window")
    every = marks.filter(F.col("flags").bitwiseAND(F.lit(1)) != 0).select("ref", "at").unionByName(found.filter("kind = 0").select("ref", "at")).unionByName(single.join(twice, ["core", "window"], "left_semi").select("ref", "at"))
    return every.groupBy("ref").agg(F.collect_list("at").alias("spans"))


def _removed(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    order = np.sort(spans)
    start, end = order >> 8, (order >> 8) + (order & 255) + WINDOW
    top = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]]))
    return list(zip(start[cut].tolist(), top[np.append(cut[1:], len(order)) - 1].tolist(), strict=True))


_OUT = [T.StructField("__s_bytes", T.LongType()), T.StructField("__s_removed", T.LongType()), T.StructField("__s_spans", T.LongType()), T.StructField("__s_sha256", T.StringType()), T.StructField("__s_kept", T.BinaryType())]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """docs with __s_bytes, __s_removed, __s_spans (maximal removed runs), __s_sha256 and __s_kept (what is left, as bytes).

    What is left may cut a character in two, so it is bytes, not text.
    """
    ids = docs.agg(F.count("*").alias("n"), F.count(doc_id).alias("some"), F.count_distinct(doc_id).alias("d")).first()
    unique = ids["n"] == ids["some"] == ids["d"] and docs.schema[doc_id].dataType.simpleString() in ("bigint", "int")
    ref = F.col(doc_id).cast("long") if unique else F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    spans = repeats(docs.select(ref.alias("ref"), F.col(text).alias("text"))).select(F.col("ref").alias("__s_ref"), F.col("spans").alias("__s_at"))
    joined = docs.join(spans.hint("shuffle_hash"), ref == F.col("__s_ref"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__s_at"))
    names, at = list(docs.columns), docs.columns.index(text)
    fields = _OUT if keep_bytes else _OUT[:-1]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for part in slices(batch, at):
                rows = []
                for data, own in zip(as_bytes(part.column(at)), part.column(len(names)), strict=True):
                    data = data or b""
                    cut = _removed(own.values.to_numpy()) if own.is_valid else []
                    edges = [0, *[x for s in cut for x in s], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept)[: len(fields)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(zip(*rows, strict=True), fields, strict=True)]], names=[*names, *[f.name for f in fields]])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))

"""N-gram Jaccard join with a count-vector R-tree: groups of documents linked by shingle sets of a Jaccard threshold or more.

Shingle length and threshold are a Rule: 4 words and 0.85 where none is given; the pipeline's stage gives 5 words and 0.8.

Shingles are hashed to 64 bits, and a document's set is known by a 64-bit sum over it: documents with equal sets are one
class from here on. Two sets that reach the threshold share a shingle among the first few of each, in any order common to
all (prefix filter). The order puts shingles that many documents hold last, as a table of 2**20 counters tells; only
consistency matters for the result. Classes that share such a shingle form a block.

Each class is a point: its shingles are hashed into groups and counted by group. The points of all blocks that a task has
at hand are indexed by one R-tree, whose first coordinate is the block; the overlap of a query with anything under a node
is bounded by the sum of the coordinate minima of the query and the node's maxima, and lengths bound it too. The tree has
64 coordinates; pairs that survive are tried with all 256 groups, of which the coordinates are sums, then verified with
their sets.

Components are asked for, not pairs. So links come in two rounds. The first queries the tree, for each block, with the
class that has the block's shingle earliest in its order (the hub): in a group of near copies that is one without edits of
its own. The components of these links are labels, and the second round queries it with the classes of a block that don't
have its most frequent label, so that all pairs with different labels are tried: no link between components is lost, and a
group of thousands of near copies needs no more than its links to the first. Blocks of more than LIMIT points are dealt
out in pairs of parts; the part of a block that shares one label meets only the rest. A class in more than HOT pairs, such
as a hub, is joined in as many parts.

Null text, and text without words, is the empty set: linked with nothing. With fewer words than a shingle has, the whole
sequence is the one shingle. Repeated rows are in one class, and each input row gives one row. A component is named by its least id,
so that ties don't occur. Very long texts are one set each, in memory of a task once. An empty table gives none. Other
columns are ignored, whatever their names, and pass through representatives().
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import as_bytes, slices
from quillspark.llm.components import components
from quillspark.llm.suffixes import _filter, _let_through, _mix, _signed
from quillspark.session import Written, write_shared


class Rule(NamedTuple):
    """Words of a shingle, and the percent of the union that linked sets share at least."""

    words: int = 4
    percent: int = 85


RULE = Rule()
COARSE, FINE = 64, 256
SLOTS = 1 << 20
#: Points of a block that one task indexes at once, and of blocks together in one tree.
LIMIT, INDEXED = 2_000, 4_096
#: Pairs of a class that are joined in one part, and the most classes that are dealt out.
HOT, MOST_HOT = 256, 100_000
#: Shingles counted together; those a chunk holds fewer times than OFTEN don't count as frequent.
CHUNK, OFTEN = 4_000_000, 2

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]


def shingle_sets(texts: list[bytes | None], size: int = RULE.words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    index: dict[bytes, int] = {}
    words = [(t or b"").translate(_LOWER).split() for t in texts]
    counts = [len(w) for w in words]
    ids = np.fromiter((index.setdefault(x, len(index)) for w in words for x in w), np.int64, sum(counts))
    if not len(ids):
        return [np.zeros(0, _U) for _ in texts]
    own = np.fromiter(map(xxhash.xxh64_intdigest, index), _U, len(index))[ids]
    h = own[: max(0, len(own) - size + 1)]
    for k in range(1, size if len(h) else 0):
        h = h * _FACTORS[(k - 1) % len(_FACTORS)] + own[k : len(own) - size + 1 + k]
    h = _mix(h)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(h[at : at + n - size + 1]))
        elif n:
            total = np.array([n], _U)
            for x in own[at : at + n]:
                total = _mix(total * _FACTORS[0] + x)
            out.append(total)
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(44)).astype(np.int64)


def set_hash(own: np.ndarray) -> int:
    return int(np.sum(_mix(own ^ _U(0xA0761D6478BD642F)), dtype=_U).view(np.int64)) if len(own) else 0


def point(own: np.ndarray, groups: int) -> bytes:
    """Counts of a set's shingles by group, never too low: one byte each, after a byte for their unit."""
    counts = np.bincount(((own >> _U(12)) % _U(groups)).astype(np.int64), minlength=groups)
    unit = -(-int(counts.max()) // 255)
    if unit > 255:
        unit = -(-unit // 256) * 256
        return bytes([0, min(255, unit // 256)]) + np.minimum(255, -(-counts // unit)).astype(np.uint8).tobytes()
    return bytes([max(1, unit), 0]) + (-(-counts // max(1, unit))).astype(np.uint8).tobytes()


def points(packed: list[bytes], groups: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, groups + 2).astype(np.int32)
    return raw[:, 2:] * (raw[:, :1] + 256 * raw[:, 1:2])


def _passes(overlap: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """100 * overlap >= percent * union, with total = the two sizes."""
    return (100 + percent) * overlap >= percent * total


class CountRTree:
    """An R-tree over (block, count vector), packed in order of block and size. Nodes keep the coordinate maxima and the
    ranges of sizes and blocks; only points of a query's own block are found."""

    FAN = 8

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, blocks: np.ndarray | None = None, percent: int = RULE.percent) -> None:
        self.percent = percent
        blocks = np.zeros(len(sizes), np.int64) if blocks is None else blocks
        self.order = np.lexsort((vectors.argmax(1), sizes, blocks))
        size, block = sizes[self.order], blocks[self.order]
        self.levels = [(vectors[self.order], size, size, block, block)]
        while len(self.levels[-1][0]) > self.FAN:
            top, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(top), self.FAN)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def candidates(self, vectors: np.ndarray, sizes: np.ndarray, blocks: np.ndarray | None = None, chunk: int = 256):
        """Pairs (query, point) that the bounds don't exclude."""
        percent = self.percent
        blocks = np.zeros(len(sizes), np.int64) if blocks is None else blocks
        for start in range(0, len(vectors), chunk):
            query = np.repeat(np.arange(start, min(start + chunk, len(vectors))), len(self.levels[-1][0]))
            node = np.tile(np.arange(len(self.levels[-1][0])), len(query) // max(1, len(self.levels[-1][0])))
            for depth in range(len(self.levels) - 1, -1, -1):
                top, low, high, first, last = self.levels[depth]
                n, own = sizes[query], blocks[query]
                fits = (100 * high[node] >= percent * n) & (100 * n >= percent * low[node]) & (first[node] <= own) & (own <= last[node])
                query, node = query[fits], node[fits]
                held = [np.zeros(0, bool)]
                for k in range(0, len(query), 1 << 16):
                    q, m = query[k : k + (1 << 16)], node[k : k + (1 << 16)]
                    held.append(_passes(np.minimum(vectors[q], top[m]).sum(1), sizes[q] + np.maximum(low[m], -(-percent * sizes[q] // 100)), percent))
                keep = np.concatenate(held)
                query, node = query[keep], node[keep]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    query = np.repeat(query, self.FAN)
                    node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                    query, node = query[node < below], node[node < below]
            yield query, self.order[node]


def _coarse(fine: np.ndarray) -> np.ndarray:
    """Groups of one size are unions of groups of the other."""
    return fine.reshape(-1, FINE // COARSE, COARSE).sum(1)


def _texts(batches, rule: Rule, column: int = 1):
    for batch in batches:
        for part in slices(batch, column):
            refs = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield refs, shingle_sets(as_bytes(part.column(column)), rule.words)


def _describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """kind 0: ref, n, set, fine for each document; kind 1: slot and its count."""
    names = ["kind", "ref", "n", "set", "fine"]

    def run(batches):
        frequent, held, weight = np.zeros(SLOTS, np.int64), [], 0

        def count():
            own, times = np.unique(np.concatenate(held), return_counts=True)
            some = times >= OFTEN
            np.add.at(frequent, _slot(own[some]), times[some])

        for refs, sets in _texts(batches, rule):
            held += sets
            weight += sum(map(len, sets))
            if weight >= CHUNK:
                count()
                held, weight = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(refs), np.int8)), pa.array(refs), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([point(x, FINE) if len(x) else b"" for x in sets], pa.binary())], names=names)
        if held:
            count()
        some = np.flatnonzero(frequent)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int8)), pa.array(some), pa.array(frequent[some]), *[pa.nulls(len(some), t) for t in (pa.int64(), pa.binary())]], names=names)

    return docs.mapInArrow(run, "kind byte, ref long, n long, set long, fine binary")


def _prefixes(docs: DataFrame, levels: np.ndarray, rule: Rule) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        rank = shared.value
        for _, sets in _texts(batches, rule):
            h, ids, places = [], [], []
            for own in sets:
                n = len(own)
                if n:
                    size = n - -(-rule.percent * n // 100) + 1
                    level = rank[_slot(own)]
                    first = own[np.lexsort((own, level))[:size]] if level.any() else own[:size]
                    h.append(first)
                    ids.append(np.full(size, set_hash(own)))
                    places.append((np.arange(size) << 32) | n)
            if h:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(h)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], names=["h", "set", "place"])

    return docs.mapInArrow(run, "h long, set long, place long")


def _blocks(batches):
    """Rows sorted by h, place and set -> those that share their h (or may, at the partition's edge), with the block's first."""
    held, first = None, True

    def chunk(columns, drop_first: bool, keep_last: bool, open_start: bool):
        h, own, place, hub, hub_place = columns
        same = h[1:] == h[:-1]
        before, after = np.concatenate([[open_start], same]), np.concatenate([same, [True]])
        copy = np.concatenate([[False], same & (own[1:] == own[:-1])])
        keep = (before | after) & ~copy
        keep[: 1 if drop_first else 0] = False
        if keep_last:
            keep[-1] = False
        some = np.flatnonzero(keep)
        mask = 0xFFFFFFFF
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (h, own, place & mask, hub, hub_place & mask)], names=["h", "set", "n", "hub", "hub_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if held is not None:
            own = [np.concatenate([x, y]) for x, y in zip(held, own, strict=False)]
        start = np.concatenate([[True], own[0][1:] != own[0][:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
        hub, hub_place = own[1][at], own[2][at]
        if held is not None:  # the block at the start began earlier
            old = at == 0
            hub, hub_place = np.where(old, held[3][0], hub), np.where(old, held[4][0], hub_place)
        columns = [*own, hub, hub_place]
        yield chunk(columns, drop_first=held is not None and len(held[0]) > 1, keep_last=True, open_start=held is None or len(held[0]) == 1)
        held = [x[-2:].copy() for x in columns]
    if held is not None:
        yield chunk(held, drop_first=len(held[0]) > 1, keep_last=False, open_start=True)


def _pairs(batches, percent: int):
    """Rows (h, part_a, part_b, side, label, n, set, fine) sorted by h and parts -> pairs with different labels that the bounds let through."""
    held = None

    kept: list[np.ndarray] = []

    def found(a, b, rows):
        """Pairs often share several blocks of a task: they are gathered and told apart by the million."""
        one, two = rows["set"][a], rows["set"][b]
        kept.append(np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1) if len(a) else np.zeros((2, 0), np.int64))
        if sum(x.shape[1] for x in kept) >= 1_000_000:
            kept[:] = [np.unique(np.concatenate(kept, axis=1), axis=1)]
            if kept[0].shape[1] >= 500_000:
                yield from flush()

    def finer(a, b, rows):
        keep = [np.zeros(0, bool)]
        for k in range(0, len(a), 1 << 14):
            x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
            keep.append(_passes(np.minimum(rows["fine"][x], rows["fine"][y]).sum(1), rows["n"][x] + rows["n"][y], percent))
        keep = np.concatenate(keep)
        return a[keep], b[keep]

    def flush():
        if kept:
            pairs = np.unique(np.concatenate(kept, axis=1), axis=1)
            kept.clear()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def allowed(a, b, rows):
        cross = (rows["part_a"][a] == rows["part_b"][a]) | (rows["side"][a] != rows["side"][b])
        return cross & (rows["label"][a] != rows["label"][b]) & (rows["set"][a] != rows["set"][b])

    def work(rows):
        key = np.stack([rows[k] for k in ("h", "part_a", "part_b")])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
        starts = np.append(np.flatnonzero(new), len(new))
        first = 0
        while first < len(starts) - 1:  # whole blocks, INDEXED points or one block
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + INDEXED, side="right")) - 1)
            own = np.arange(starts[first], starts[last])
            yield from tree(own, np.cumsum(new[own]), rows)
            first = last

    def tree(at, block, rows):
        order = np.lexsort((rows["label"][at], block))
        label = rows["label"][at][order]
        new = np.concatenate([[True], (label[1:] != label[:-1]) | (block[order][1:] != block[order][:-1])])
        run = np.cumsum(new) - 1
        n = np.bincount(run)[run]
        top = np.zeros(block.max() + 1, np.int64)
        np.maximum.at(top, block[order], n)
        main = np.zeros(len(at), bool)  # of the most frequent label of a block; of several, all but one ask too
        best = np.full(len(top), 2**63 - 1, np.int64)
        some = n == top[block[order]]
        np.minimum.at(best, block[order][some], label[some])
        main[order] = label == best[block[order]]
        vectors, sizes, ask = rows["coarse"][at], rows["n"][at], np.flatnonzero(~main)
        for a, b in CountRTree(vectors, sizes, block, percent).candidates(vectors[ask], sizes[ask], block[ask]):
            a = ask[a]
            keep = (main[b] | (a < b)) & allowed(at[a], at[b], rows) | (~main[b] & (a < b) & allowed(at[b], at[a], rows))
            yield from found(*finer(at[a][keep], at[b][keep], rows), rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        own = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(("h", "part_a", "part_b", "side", "label", "n", "set"))}
        own["fine"] = points(batch.column(7).to_pylist(), FINE)
        own["coarse"] = _coarse(own["fine"])
        rows = own if held is None else {k: np.concatenate([held[k], own[k]]) for k in own}
        last = (rows["h"] == rows["h"][-1]) & (rows["part_a"] == rows["part_a"][-1]) & (rows["part_b"] == rows["part_b"][-1])
        cut = len(last) - int(last.sum())  # rows are sorted: the last block may go on in the next batch
        if cut:
            yield from work({k: x[:cut] for k, x in rows.items()})
        held = {k: x[cut:] for k, x in rows.items()}
    if held is not None:
        yield from work(held)
    yield from flush()


def _joined(pairs: DataFrame, key: str, table: DataFrame, counted: DataFrame) -> DataFrame:
    """pairs with the columns of table, whose key is unique; a key of more than HOT pairs is dealt out.

    counted: a written table with the keys of pairs.
    """
    hot = counted.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    few = hot.orderBy(F.desc("n")).limit(MOST_HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("parts")).collect()  # at most MOST_HOT rows
    if not few:
        return pairs.join(table, key)
    parts = F.broadcast(pairs.sparkSession.createDataFrame(few, f"{key} long, __parts int"))
    dealt = pairs.join(parts, key, "left").withColumn("__part", F.pmod(F.xxhash64(*counted.columns), F.coalesce("__parts", F.lit(1)).cast("long")).cast("int")).drop("__parts")
    copies = table.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"]).drop("__part")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    pairs = write_shared(pairs, "ngram-tried")
    of = classes.select(F.col("set"), F.col("ref"), F.col("n"), F.col("fine"))
    both = _joined(pairs, "a", of.select(F.col("set").alias("a"), F.col("ref").alias("ref_a"), F.col("n").alias("n_a"), F.col("fine").alias("fine_a")), pairs)
    both = _joined(both, "b", of.select(F.col("set").alias("b"), F.col("ref").alias("ref_b"), F.col("n").alias("n_b"), F.col("fine").alias("fine_b")), pairs)

    def fine(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, INDEXED):
                part = batch.slice(start, INDEXED)
                _, query, block = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                one, two = (points(part.column(k).to_pylist(), FINE) for k in (4, 5))
                n_a, n_b = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                tree = CountRTree(_coarse(two), n_b, block, rule.percent)
                near = np.concatenate([np.zeros(0, np.int64), *[row for _, row in tree.candidates(_coarse(one[query]), n_a[query], np.arange(len(query)))]])
                near = np.sort(near[_passes(np.minimum(one[near], two[near]).sum(1), n_a[near] + n_b[near], rule.percent)])
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(near)) for k in (0, 1, 6, 7)], names=["a", "b", "ref_a", "ref_b"])

    left = write_shared(both.select("a", "b", "n_a", "n_b", "fine_a", "fine_b", "ref_a", "ref_b").mapInArrow(fine, "a long, b long, ref_a long, ref_b long"), "ngram-pairs")
    needed = left.select(F.explode(F.array("ref_a", "ref_b")).alias("ref")).distinct().select("ref", F.lit(0).cast("long").alias("at"), F.lit(2).alias("flags"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(needed))

    def sets(batches):
        words = shared.value
        for batch in batches:
            refs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            some = _let_through(words, refs, np.zeros(len(refs), np.int64))
            for part in slices(batch.take(pa.array(some)), 1):
                own = shingle_sets(as_bytes(part.column(1)), rule.words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in own], pa.binary())], names=["ref", "own"])

    held = docs.mapInArrow(sets, "ref long, own binary").join(needed.select("ref"), "ref", "left_semi").dropDuplicates(["ref"])
    held = write_shared(held, "ngram-sets")
    joined = _joined(left, "ref_a", held.select(F.col("ref").alias("ref_a"), F.col("own").alias("own_a")), left)
    joined = _joined(joined, "ref_b", held.select(F.col("ref").alias("ref_b"), F.col("own").alias("own_b")), left)

    def check(batches):
        for batch in batches:
            a, b, keep = [], [], []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(one.as_buffer(), _U), np.frombuffer(two.as_buffer(), _U)
                keep.append(bool(_passes(np.intersect1d(one, two, assume_unique=True).size, len(one) + len(two), rule.percent)))
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return joined.select("a", "b", "own_a", "own_b").mapInArrow(check, "a long, b long")


def _second_round(blocks: DataFrame, classes: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of classes of a block with different labels."""
    rows = blocks.select("h", "set").join(labels, "set", "left").select("h", "set", F.coalesce("label", "set").alias("label"))
    rows = write_shared(rows, "ngram-labelled")
    sizes = rows.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("top"))
    mixed = sizes.filter(F.col("total") > F.col("top.n")).select("h", "total", F.col("top.label").alias("main"), F.col("top.n").alias("most"))
    own = rows.join(mixed, "h")
    rest_parts = F.ceil((F.col("total") - F.col("most")) / LIMIT).cast("int")
    main_parts = F.ceil(F.col("most") / LIMIT).cast("int")
    rest_part = F.pmod(F.xxhash64("set"), rest_parts.cast("long")).cast("int")
    main_part = F.pmod(F.xxhash64("set"), main_parts.cast("long")).cast("int")
    # Parts of the rest are numbered 0, 1, ...; those of the main label -1, -2, ...
    to_rest = F.transform(F.sequence(F.lit(0), rest_parts - 1), lambda j: F.struct(F.greatest(j, rest_part).alias("part_a"), F.least(j, rest_part).alias("part_b"), F.when(j >= rest_part, 0).otherwise(1).alias("side")))
    to_main = F.transform(F.sequence(F.lit(0), main_parts - 1), lambda k: F.struct(rest_part.alias("part_a"), (-1 - k).alias("part_b"), F.lit(1).alias("side")))
    from_main = F.transform(F.sequence(F.lit(0), rest_parts - 1), lambda i: F.struct(i.alias("part_a"), (-1 - main_part).alias("part_b"), F.lit(0).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("part_a"), F.lit(0).alias("part_b"), F.lit(0).alias("side")))
    where = F.when(F.col("total") <= LIMIT, alone).when(F.col("label") == F.col("main"), from_main).otherwise(F.concat(to_rest, to_main))
    dealt = own.select("h", "set", "label", F.explode(where).alias("w")).select("h", F.col("w.part_a"), F.col("w.part_b"), F.col("w.side"), "label", "set")
    full = dealt.join(classes.select("set", "n", "fine"), "set").select("h", "part_a", "part_b", "side", "label", "n", "set", "fine")
    keys = ["h", "part_a", "part_b"]
    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _pairs(batches, rule.percent), "a long, b long").distinct()


def refs_of(docs: DataFrame, doc_id: str, text: str):
    """A column that tells rows apart (equal for rows with the same id and text), and whether the ids alone do."""
    ids = docs.agg(F.count("*").alias("n"), F.count(doc_id).alias("some"), F.count_distinct(doc_id).alias("d")).first()
    unique = ids["n"] == ids["some"] == ids["d"] and docs.schema[doc_id].dataType.simpleString() in ("bigint", "int")
    return (F.col(doc_id).cast("long") if unique else F.xxhash64(F.col(doc_id).cast("string"), F.col(text))), unique


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """ref, n, component (the least ref linked to it): a row for each row of docs. See refs_of()."""
    ref, _ = refs_of(docs, doc_id, text)
    own = docs.select(ref.alias("ref"), F.col(text).alias("text"))
    described = write_shared(_describe(own, rule), "ngram-docs")
    counts = described.filter("kind = 1").groupBy("ref").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    levels = np.zeros(SLOTS, np.uint8)
    levels[counts.column(0).to_numpy()] = np.ceil(np.log2(counts.column(1).to_numpy() + 1)).astype(np.uint8)
    rows = described.filter("kind = 0 AND n > 0")
    least = rows.groupBy("set").agg(F.min("ref").alias("ref"))
    classes = write_shared(rows.join(least.select("ref"), "ref", "left_semi").select("set", "ref", "n", "fine").dropDuplicates(["set"]), "ngram-classes")
    prefixes = Written(_prefixes(own, levels, rule), "ngram-prefixes")
    order = ["h", "place", "set"]
    blocks = write_shared(prefixes.read().repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, "h long, set long, n long, hub long, hub_n long"), "ngram-blocks")
    prefixes.drop()

    near = 100 * F.least("n", "hub_n") >= rule.percent * F.greatest("n", "hub_n")
    first = blocks.filter(near & (F.col("set") != F.col("hub"))).select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).distinct()
    links = write_shared(_verified(first, classes, own, rule), "ngram-links")
    labels = components(links).select(F.col("node").alias("set"), F.col("component").alias("label"))
    labels = write_shared(labels, "ngram-labels")
    more = write_shared(_verified(_second_round(blocks, classes, labels, rule), classes, own, rule), "ngram-more")

    found = components(links.unionByName(more))
    ids = classes.select("set", "ref").join(found.withColumnRenamed("node", "set"), "set")
    component = ids.groupBy("component").agg(F.min("ref").alias("low")).join(ids, "component").select("set", "low")
    class_low = classes.select("set", F.col("ref").alias("own")).join(component, "set", "left").select("set", F.coalesce("low", "own").alias("component"))
    class_low = write_shared(class_low, "ngram-components")
    held = rows.select("ref", "n", "set")
    found = _joined(held, "set", class_low, held).select("ref", "n", "component")  # a class may have a third of all rows
    return found.unionByName(described.filter("kind = 0 AND n = 0").select("ref", "n", F.col("ref").alias("component")))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the group): a row for each row of docs."""
    ref, unique = refs_of(docs, doc_id, text)
    found = groups(docs, doc_id, text, rule)
    if unique:
        return found.select(F.col("ref").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    found = write_shared(found.distinct(), "ngram-groups")
    rows = docs.select(F.col(doc_id).alias("doc_id"), ref.alias("ref")).join(found, "ref")
    low = rows.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("low"))
    return rows.join(low, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """One row of docs for each group, the one with the least id; rows without words stay."""
    ref, unique = refs_of(docs, doc_id, text)
    found = groups(docs, doc_id, text, rule).filter("n = 0 OR ref = component").select(F.col("ref").alias("__j_ref")).distinct()
    rows = docs if unique else docs.dropDuplicates([doc_id, text])
    return rows.withColumn("__j_own", ref).join(found, F.col("__j_own") == F.col("__j_ref"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Hard negatives by distributed radix selection.

An anchor's positives are the rows of its label with the highest scores. Each positive opens a window of scores, LOW to HIGH
percent of its own, in which rows of other labels are the anchor's hard negatives; the best KEEP of them are wanted. The
window is cut into at most 256 buckets by the leading digit of a score's distance from its lower end. All rows are counted
into them, and the sums tell which bucket holds the score of rank KEEP. That bucket is the next round's window, until a
bucket is one score wide: then the score of rank KEEP is known, and only rows that reach it are gathered.

Rows and anchors are packed into blocks of bounded size. A stated set of anchors meets all rows: blocks meet in the cells of
a grid, neither side is sent whole to any task, and no pair of an anchor and a row becomes a row of a table. A task keeps
the counts of one block of anchors at a time and passes on the buckets down to the one that holds the rank already by its own
rows, as no lower one can be chosen; of rows with the same score it passes on KEEP with the least ids.

A score is the integer inner product of floor(scale * x). Rows with a null id, label or vector or with a component that is
null or not finite take no part; nor do vectors of another length than the anchor's, for that anchor. Of rows that share an
id the one with the least label, then the least vector, counts. Sums are exact; scores beyond the range of a long are held
at its ends. Ties go to the smaller id. A window that no score can lie in (a negative positive) gives no rows, as does an
empty table. Very long vectors cost memory in proportion to BLOCK_BYTES or one vector. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import Written, spread

SCALE, LOW, HIGH, POSITIVES, KEEP = 256, 50, 95, 5, 3
#: Rows of a block at most, and bytes of its components.
ROWS, ANCHORS, BLOCK_BYTES = 2048, 512, 4 << 20
#: Blocks of either side in a cell of the grid, unless that leaves cores idle.
CELL = 32
DIGIT = 8

_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("dims", T.IntegerType()), *[T.StructField(x, T.BinaryType()) for x in ("ids", "labels", "matrix")]])
_LEAST, _MOST = -(2**63), 2**63 - 1


def _usable(rows: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """id, label, v of the rows that take part, one for an id."""
    whole = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    own = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
    own = own.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))
    twice = Written(own.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "negatives-repeated").read()
    if twice.isEmpty():
        return own
    fixed = own.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    return own.join(twice, "id", "left_anti").unionByName(fixed)


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of rows with vectors of one length, in the order of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, {}

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal block
            ids, labels, parts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*held.pop(dims), strict=True))
            order = np.argsort(ids, kind="stable")
            matrix = parts.reshape(len(ids), dims)[order]
            small = matrix.size == 0 or (matrix.min() >= -(2**31) and matrix.max() < 2**31)
            block += 1
            made = [[block], [dims], [ids[order].tobytes()], [labels[order].tobytes()], [matrix.astype(np.int32 if small else np.int64).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=_BLOCK.names)

        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            offsets = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            flat, sizes = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
            for dims in np.unique(sizes).tolist():
                own, step = np.flatnonzero(sizes == dims), max(1, min(most, BLOCK_BYTES // max(1, 8 * dims)))
                at = 0
                while at < len(own):
                    room = step - sum(len(x[0]) for x in held.get(dims, ()))
                    some = own[at : at + room]
                    at += len(some)
                    held.setdefault(dims, []).append((ids[some], labels[some], np.concatenate([flat[offsets[k] : offsets[k + 1]] for k in some])))
                    if len(some) == room:
                        yield flush(dims)
            if sum(len(x[2]) for own in held.values() for x in own) > BLOCK_BYTES:  # vectors of many lengths
                for dims in list(held):
                    yield flush(dims)
        for dims in list(held):
            yield flush(dims)

    return rows.select("id", "label", "v").mapInArrow(run, _BLOCK)


class _Grid:
    """The blocks of rows and of anchors, written once, and how they meet."""

    def __init__(self, usable: DataFrame, every: int) -> None:
        self.rows = Written(_packed(usable, ROWS), "negatives-rows")
        self.anchors = Written(_packed(usable.filter(F.col("id") % every == 0), ANCHORS), "negatives-anchors")
        cores = usable.sparkSession.sparkContext.defaultParallelism
        n, a = self.rows.read().count(), self.anchors.read().count()
        self.across, self.down = max(1, min(n, max(-(-n // CELL), 4 * cores))), max(1, -(-a // CELL))

    def meet(self, work, schema: str, windows: DataFrame | None = None) -> DataFrame:
        """What work makes of each block of anchors: work(anchor ids, labels, windows) gives an object with add(ids, labels, scores) and rows()."""
        anchors = self.anchors.read()
        if windows is not None:
            own = windows.groupBy("block").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in _WINDOW])).alias("w"))  # as many as a block's anchors have positives
            anchors = anchors.join(own, "block").select(*anchors.columns, *[F.col("w")[c].alias(c) for c in _WINDOW])
        else:
            anchors = anchors.select("*", *[F.array().cast("array<long>").alias(c) for c in _WINDOW])
        a = anchors.select("block", "dims", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("matrix").alias("a_matrix"), *_WINDOW)
        a = a.withColumn("down", F.pmod(F.xxhash64("block"), F.lit(self.down))).withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.across - 1).cast("long"))))
        r = self.rows.read().withColumnRenamed("block", "own").withColumn("across", F.pmod(F.xxhash64("own"), F.lit(self.across))).withColumn("down", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.down - 1).cast("long"))))
        both = r.join(a.hint("merge"), ["across", "down", "dims"]).select("block", "dims", "ids", "labels", "matrix", "a_ids", "a_labels", "a_matrix", *_WINDOW)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, state, names = None, None, schema_names
            for batch in batches:
                for k in range(batch.num_rows):
                    at, dims, *parts = (batch.column(c)[k].as_py() for c in range(8))
                    if at != block:
                        if state is not None:
                            yield from _rows(block, state, names)
                        block = at
                        _, _, _, a_ids, a_labels, a_matrix = parts
                        ids, labels = np.frombuffer(a_ids, np.int64), np.frombuffer(a_labels, np.int64)
                        asked = _matrix(a_matrix, len(ids), dims)
                        state = work(ids, labels, *(np.array(batch.column(8 + c)[k].as_py(), np.int64) for c in range(len(_WINDOW))))
                    ids, labels = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.int64)
                    state.add(ids, labels, _scores(asked, _matrix(parts[2], len(ids), dims)))
            if state is not None:
                yield from _rows(block, state, names)

        schema_names = ["block", *[x.split()[0] for x in schema.split(", ")]]
        return both.sortWithinPartitions("block").mapInArrow(run, f"block long, {schema}")


#: Columns of a window: the anchor's place in its block, the positive, the range of scores and how many are wanted of it.
_WINDOW = ("place", "positive_id", "low", "high", "need")


def _rows(block: int, state, names: list[str]) -> Iterator[pa.RecordBatch]:
    made = state.rows()
    if len(made[0]):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made[0]), block)), *[pa.array(np.asarray(x, np.int64)) for x in made]], names=names)


def _matrix(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int64 if dims and len(data) == 8 * n * dims else np.int32).reshape(n, dims)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b."""
    most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda x: min(max(x, _LEAST), _MOST), otypes=[np.int64])(wide)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the `most` of their group with the highest scores, then the least ids."""
    order = np.lexsort((ids, ~score, group))  # ~score falls as score rises, without overflow
    own = group[order]
    first = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    return order[np.arange(len(own)) - start < most]


class _Positives:
    """The best rows of each anchor's label."""

    def __init__(self, most: int, ids: np.ndarray, labels: np.ndarray, *_: np.ndarray) -> None:
        self.most, self.ids, self.labels = most, ids, labels
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))  # place, score, id

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        alike = (self.labels[:, None] == labels[None, :]) & (self.ids[:, None] != ids[None, :])
        if len(ids) > self.most:  # most rows are out by the block's own ranking
            shown = np.where(alike, scores, _LEAST)
            bar = np.partition(shown, len(ids) - self.most, axis=1)[:, len(ids) - self.most]
            alike &= scores >= bar[:, None]
        place, at = np.nonzero(alike)
        every = [np.concatenate(x) for x in zip(self.held, (place, scores[place, at], ids[at]), strict=True)]
        keep = _best(*every, self.most)
        self.held = tuple(x[keep] for x in every)

    def rows(self) -> list[np.ndarray]:
        return list(self.held)


class _Windowed:
    def __init__(self, labels: np.ndarray, place: np.ndarray, positive: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> None:
        self.labels, self.place, self.positive, self.low, self.high, self.need = labels, place, positive, low, high, need

    @staticmethod
    def step(labels: np.ndarray) -> int:
        """Windows that are looked at together."""
        return max(1, (1 << 20) // max(1, len(labels)))

    def inside(self, labels: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For some windows at once: the first of them, and window, row and score of the entries of other labels that lie in them."""
        step = self.step(labels)
        for first in range(0, len(self.place), step):
            own = slice(first, first + step)
            place = self.place[own]
            got = scores[place]
            ok = (got >= self.low[own, None]) & (got <= self.high[own, None]) & (self.labels[place][:, None] != labels[None, :])
            w, at = np.nonzero(ok)
            yield first, w + first, at, got[w, at]


def shifts(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By how many bits the distance from low is shifted to give a digit."""
    width = high.astype(object) - low.astype(object)
    return np.array([max(0, int(x).bit_length() - DIGIT) for x in width], np.int64)


class _Histogram(_Windowed):
    """Counts by the leading digit of a score's distance from its window's lower end."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, *windows: np.ndarray) -> None:
        super().__init__(labels, *windows)
        self.shift = shifts(self.low, self.high)
        self.counts = np.zeros((len(self.place), 1 << DIGIT), np.int64)

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        for first, w, _, score in self.inside(labels, scores):
            digit = (score.astype(np.uint64) - self.low[w].astype(np.uint64)) >> self.shift[w].astype(np.uint64)
            many = min(len(self.place) - first, self.step(labels))
            flat = np.bincount(((w - first) << DIGIT) + digit.astype(np.int64), minlength=many << DIGIT)
            self.counts[first : first + many] += flat.reshape(many, 1 << DIGIT)

    def rows(self) -> list[np.ndarray]:
        above = np.cumsum(self.counts[:, ::-1], axis=1)[:, ::-1] - self.counts
        w, digit = np.nonzero((self.counts > 0) & (above < self.need[:, None]))
        return [self.place[w], self.positive[w], digit, self.counts[w, digit]]


class _Gathered(_Windowed):
    """The rows that reach a window's lower end, which now is the score of the last rank wanted."""

    def __init__(self, keep: int, ids: np.ndarray, labels: np.ndarray, *windows: np.ndarray) -> None:
        super().__init__(labels, *windows)
        self.keep = keep
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))  # window, score, id

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        for _, w, at, score in self.inside(labels, scores):
            every = [np.concatenate(x) for x in zip(self.held, (w, score, ids[at]), strict=True)]
            kept = _best(*every, self.keep)
            self.held = tuple(x[kept] for x in every)

    def rows(self) -> list[np.ndarray]:
        w, score, ids = self.held
        return [self.place[w], self.positive[w], ids, score]


def _narrowed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows after a round: each is the bucket of the last rank wanted; with fewer rows than wanted it stays and is done."""
    keys = ["block", "place", "positive_id"]
    down = Window.partitionBy(*keys).orderBy(F.desc("digit"))
    seen = counts.groupBy(*keys, "digit").agg(F.sum("n").alias("n"))
    seen = seen.withColumn("reached", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    joined = windows.join(seen, keys)
    chosen = joined.filter((F.col("reached") >= F.col("need")) & (F.col("reached") - F.col("n") < F.col("need")))
    wide = F.col("high").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)")
    shift = F.greatest(F.lit(0), F.when(wide > 0, F.length(F.conv(wide.cast("string"), 10, 2))).otherwise(0) - DIGIT)
    size = F.expr("shiftleft(1L, shift)")
    chosen = chosen.withColumn("shift", shift).withColumn("at", F.col("low") + F.col("digit") * size)
    chosen = chosen.select(*keys, F.col("at").alias("to_low"), F.least(F.col("high"), F.col("at") + (size - 1)).alias("to_high"), (F.col("need") - (F.col("reached") - F.col("n"))).alias("to_need"), (F.col("shift") == 0).alias("last"))
    after = windows.join(chosen, keys, "left")
    return after.select(
        *keys,
        "anchor_id",
        "positive_score",
        "ceiling",
        F.coalesce("to_low", "low").alias("low"),
        F.coalesce("to_high", "high").alias("high"),
        F.coalesce("to_need", "need").alias("need"),
        F.coalesce("last", F.lit(True)).alias("done"),
    )


def mine(rows: DataFrame, every: int, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, keep: int = KEEP, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: the rows whose id is divisible by `every`."""
    grid = _Grid(_usable(spread(rows), vec_id, label, vector, scale), every)
    found = grid.meet(lambda *x: _Positives(positives, *x), "place long, score long, id long")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= positives)
    score = F.col("score").cast("decimal(38,0)")
    bounds = [F.ceil(score * low / F.lit(100).cast("decimal(3,0)")).cast("long").alias("low"), F.floor(score * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("high")]
    named = grid.anchors.read().select("block", "ids").mapInArrow(_names, "block long, place long, anchor_id long")
    windows = found.join(named, ["block", "place"]).select("block", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *bounds, F.lit(keep).cast("long").alias("need"), F.lit(False).alias("done"))
    windows = Written(windows.filter("low <= high").withColumn("ceiling", F.col("high")), "negatives-windows")
    while not (open_ := windows.read().filter("NOT done")).isEmpty():  # a round for each digit of the widest window
        counts = grid.meet(_Histogram, "place long, positive_id long, digit long, n long", open_)
        after = Written(_narrowed(open_, counts).unionByName(windows.read().filter("done")), "negatives-windows")
        windows.drop()
        windows = after
    ready = windows.read()
    got = grid.meet(lambda *x: _Gathered(keep, *x), "place long, positive_id long, negative_id long, negative_score long", ready.withColumn("high", F.col("ceiling")))
    order = Window.partitionBy("block", "place", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    got = got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return got.join(ready.select("block", "place", "positive_id", "anchor_id", "positive_score"), ["block", "place", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "place", "anchor_id"])

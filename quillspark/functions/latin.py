"""Latin words and numbers of many texts at once, by their bytes: the inside of Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGIT, HYPHEN, LETTER, DOT = 1, 2, 3, ord(".")
_KIND = np.zeros(256, np.uint8)
_KIND[ord("0") : ord("9") + 1], _KIND[ord("-")], _KIND[ord("a") : ord("z") + 1] = DIGIT, HYPHEN, LETTER


def words(texts: pa.StringArray, numbers: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The matches of [a-z][a-z0-9-]*, with numbers also of [0-9]+(\\.[0-9]+)?, in any order, and the text that each is of."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    kind = _KIND[data]
    start, end = _runs(kind > 0, bounds)
    letters = np.flatnonzero(kind == LETTER)
    first = np.append(letters, len(data))[np.searchsorted(letters, start)]
    start, end = first[first < end], end[first < end]
    found, owner = _taken(data, start, end), np.searchsorted(bounds, start, "right") - 1
    if not numbers:
        return found, owner
    start, end = _runs((kind == DIGIT) & ~_inside(len(data), start, end), bounds)
    own = np.searchsorted(bounds, start, "right") - 1
    after = np.zeros(len(start), bool)  # runs that a dot alone parts from the run before
    after[1:] = (start[1:] == end[:-1] + 1) & (own[1:] == own[:-1]) & (data[np.minimum(end[:-1], len(data) - 1)] == DOT)
    place = np.arange(len(start))
    place -= np.maximum.accumulate(np.where(after, 0, place))
    whole = place % 2 == 0  # of runs in a chain of dots every second one begins a number
    more = np.append(~whole[1:], False)[: len(whole)]
    end = np.where(more, np.append(end[1:], 0)[: len(end)], end)
    return pa.concat_arrays([found, _taken(data, start[whole], end[whole])]), np.concatenate([owner, own[whole]])


def _runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs; none goes on beyond a text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    out = np.concatenate([[True], ~inside, [True]])
    return np.flatnonzero(inside & (out[:-2] | edge[:-1])), np.flatnonzero(inside & (out[2:] | edge[1:])) + 1


def _inside(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int8)
    steps[start] += 1
    steps[end] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


def _taken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[_inside(len(data), start, end)]))

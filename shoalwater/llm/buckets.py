"""Groups of a sorted stream: members of one key, found link by link.

Rows (key, second key, member) arrive sorted; a key's members are compared only
with each other.  A key with more than ``most`` members is not held: its rows
are handed on as overflow, and the caller deals them into pairs of blocks so
that every pair of members still meets, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa


def breadth_first(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among n members; ``near(i, rest)`` says which of ``rest`` link to i."""
    open_, found = np.arange(n), []
    while len(open_):
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            hit = near(i, open_)
            reached = open_[hit]
            found.extend((i, int(j)) for j in reached)
            queue.extend(int(j) for j in reached)
            open_ = open_[~hit]
    return found


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end of the last."""
    if not len(keys[0]):
        return np.zeros(1, dtype=np.int64)
    change = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]])


def sorted_groups(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
    """(whole, run starts, columns) for chunks of a stream sorted by its first two columns.

    A whole chunk ends between keys; a chunk that is not whole belongs to one
    key with more than ``most`` members.
    """
    held: list[np.ndarray] | None = None
    over: tuple | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if over is not None:  # the rest of a large key
            same = (now[0] == over[0]) & (now[1] == over[1])
            n = int(same.sum())
            if n:
                yield False, np.array([0, n]), [c[:n] for c in now]
            if n == len(now[0]):
                continue
            now, over = [c[n:] for c in now], None
        if held is not None:
            now, held = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)], None
        starts = runs(now[0], now[1])
        last = int(starts[-2])
        yield from _split([c[:last] for c in now], most)
        held = [c[last:] for c in now]
        if len(held[0]) > most:
            over = (held[0][0], held[1][0])
            yield False, np.array([0, len(held[0])]), held
            held = None
    if held is not None:
        yield from _split(held, most)


def _split(columns: list[np.ndarray], most: int) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
    starts = runs(columns[0], columns[1])
    sizes = np.diff(starts)
    if not (sizes > most).any():
        if len(columns[0]):
            yield True, starts, columns
        return
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield b - a <= most, np.array([0, b - a]), [c[a:b] for c in columns]

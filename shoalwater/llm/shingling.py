"""Words and digests of word runs of whole texts, by array operations.

Words are runs of bytes other than space and the controls 09 to 0D, A-Z in lower
case.  The digest of a run of words is that of its bytes with single gaps, so
it does not depend on where the run stands.  Texts are hashed a quarter megabyte at
a time; a longer one goes in overlapping blocks, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from shoalwater.llm.buckets import breadth_first

#: Bytes of text that are hashed at once.
BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse (modulo two to the 64)."""
    if len(_POWERS.get("rise", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("rise", _BASE), ("fall", _INVERSE)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]))
    return _POWERS["rise"][:n], _POWERS["fall"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of ``h``."""
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(multiplier)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some bytes of text: where they are, and all of them with single gaps."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, dtype=np.uint8)
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
        self.raw, self.start, self.end = raw, edge[::2], edge[1::2]
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        norm = np.where(solid, _LOWER[raw], np.uint8(32))[keep]
        rise, self.fall = _powers(len(norm) + 1)
        self.total = np.zeros(len(norm) + 1, dtype=np.uint64)
        np.cumsum((norm + np.uint64(1)) * rise[:-1], out=self.total[1:])

    def cut(self, n: int) -> None:
        """Only the first ``n`` words."""
        self.start, self.end = self.start[:n], self.end[:n]

    def points(self) -> np.ndarray:
        """Code points up to and with each byte."""
        return np.cumsum((self.raw & 0xC0) != 0x80, dtype=np.int32)

    def digests(self, first: np.ndarray, count: int | np.ndarray) -> np.ndarray:
        """Of the runs of ``count`` words from each of ``first`` on."""
        size = self.end - self.start + 1
        begin = np.cumsum(size) - size
        last = first + count - 1
        return mixed((self.total[begin[last] + size[last] - 1] - self.total[begin[first]]) * self.fall[begin[first]])


def blocks(data: bytes, overlap: int) -> Iterator[tuple[Words, int, int, bool]]:
    """(words, number of the first word, bytes before, whether it is the last) of blocks that share ``overlap`` words."""
    at, base, size = 0, 0, BLOCK
    while True:
        words, done = Words(data[at : at + size]), at + size >= len(data)
        n = len(words.start) - (not done)  # the last word may go on
        if not done and n <= 2 * overlap:
            size *= 2
            continue
        words.cut(n)
        yield words, base, at, done
        if done:
            return
        back = n - overlap
        at, base, size = at + (int(words.start[back]) if overlap else int(words.end[-1])), base + back, BLOCK


def groups_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a block together; a longer text alone."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < BLOCK:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def shingle_digests(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, digests of shingles, how many each text has) for consecutive parts; a long text comes in several.

    Shingles are runs of ``width`` words, all words of a text that has fewer, none of one without words.
    """
    for a, b in groups_of(texts):
        if len(texts[a]) > BLOCK:
            for words, base, _, done in blocks(texts[a], width - 1):
                n = len(words.start)
                runs = max(n - width + 1, 0) or int(n > 0 and done and not base)
                yield a, words.digests(np.arange(runs), min(n, width)), np.array([runs])
            continue
        words = Words(b"\n".join(texts[a:b]) + b"\n")
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        count = np.bincount(np.searchsorted(begins, words.start, "right") - 1, minlength=b - a)
        runs = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
        first = np.arange(int(runs.sum())) + np.repeat(np.cumsum(count) - count - np.cumsum(runs) + runs, runs)
        yield a, words.digests(first, np.repeat(np.minimum(count, width), runs)), runs


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle digests of each text."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for a, h, runs in shingle_digests(texts, width):
        for i, own in enumerate(np.split(h, np.cumsum(runs)[:-1])):
            parts[a + i].append(own)
    return [np.unique(np.concatenate(p)) for p in parts]


def similar(texts: list[bytes], width: int, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of texts whose sets of shingles have at least this Jaccard similarity."""
    sets = shingle_sets(texts, width)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat, number = np.unique(np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), return_inverse=True)
    posting = owner[np.argsort(number, kind="stable")]
    many = np.bincount(number, minlength=len(flat))
    first = np.cumsum(many) - many
    begin = np.cumsum(size) - size

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        own = number[begin[i] : begin[i] + size[i]]
        n = many[own]
        at = np.arange(int(n.sum())) + np.repeat(first[own] - np.cumsum(n) + n, n)
        common = np.bincount(posting[at], minlength=len(sets))[rest]
        return (common > 0) & (common >= threshold * (size[i] + size[rest] - common) - 1e-9)

    return breadth_first(len(sets), near)

"""Repeated passages: paragraph MinHash banding, verified and clustered.

A paragraph is a line of at least ``min_words`` words, or as many shorter lines
in a row as reach that number (a blank line ends it), so hard-wrapped text
forms paragraphs too.  Equal paragraphs (in words, A-Z in lower case) collapse
first.  Each distinct one gets a MinHash signature over its word shingles; bands
of the signature, tuned for recall at the similarity threshold, are its keys.
Paragraphs that share a key are compared by exact Jaccard similarity of their
shingle sets, and links close to clusters by connected components.  Of a
cluster the first occurrence stays.

A passage may also repeat inside longer lines that differ.  There every run of
50 words is a unit, its shingles are its 26 runs of 25 words, and its MinHash
(one band of one value) is the least digest among them.  Neighbouring units
mostly share it, so few values are kept; equal runs of 50 words always collide.
Each collision joins to the first place of its value, is verified word by word
on both texts, and grows both ways to the whole of what they have in common; a
document's runs merge into passages.

Plan.  Copies are eliminated map-side before the first shuffle of text.  Band
rows are two integers; a key's members are found on a sorted stream, and keys
with the same members are one group, so a pair that collides in many bands is
compared once.  Only grouped paragraphs fetch their text.  Within a group links
are followed breadth first (a spanning forest, never all pairs); a group
beyond ``most`` members is dealt into pairs of blocks, so no link is lost.
Occurrences join their cluster on a digest between written tables.  Passages
are sought among distinct texts; pairs of them fetch only the stretch of text
around their collisions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwater.llm.buckets import sorted_groups
from shoalwater.llm.components import components
from shoalwater.llm.shingling import BLOCK, Words, blocks, groups_of, shingle_digests, similar
from shoalwater.scratch import Scratch
from shoalwater.session import small_batches


def tune_bands(threshold: float, recall: float = 0.999, permutations: int = 64) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``permutations`` that finds a pair at the threshold with probability ``recall``."""
    best = (permutations, 1)
    for rows in range(1, permutations + 1):
        at = threshold**rows
        bands = 1 if at >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - at))
        if bands * rows <= permutations:
            best = (bands, rows)
    return best


def paragraphs(text: str, min_words: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(number of the first line, start, end, words, normalised) of the paragraphs of a text; offsets are code points."""
    at, held, first, start, end = 0, [], 0, 0, 0
    for no, line in enumerate(text.split("\n")):
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= min_words or not words:
            held = []
            if words:
                yield no, at, at + len(line), len(words), b" ".join(words)
        else:
            if not held:
                first, start = no, at
            held += words
            end = at + len(line)
            if len(held) >= min_words:
                yield first, start, end, len(held), b" ".join(held)
                held = []
        at += len(line) + 1


def _digest(norm: bytes) -> bytes:
    return hashlib.blake2b(norm, digest_size=16).digest()


def _rows(columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _occurrences(min_words: int):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["doc", "no", "start", "end", "n_words", "digest", "norm"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in names]
                seen: set[bytes] = set()
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    for no, start, end, n, norm in paragraphs(text.as_py() or "", min_words):
                        digest = _digest(norm)
                        own = None if digest in seen else norm  # contents once for each slice of the stream
                        seen.add(digest)
                        for column, x in zip(out, (doc, no, start, end, n, digest, own), strict=True):
                            column.append(x)
                yield _rows(out, kinds, names)

    return run


def signatures(texts: list[bytes], width: int, salts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits), one row per text (each has a word)."""
    out = np.full((len(texts), len(salts)), 0xFFFFFFFF, dtype=np.uint32)
    for a, h, runs in shingle_digests(texts, width):
        if not len(h):
            continue
        h, own = (h >> np.uint64(32)).astype(np.uint32), out[a : a + len(runs)]
        at = np.cumsum(runs) - runs
        for j, (salt, odd) in enumerate(zip(salts, odds, strict=True)):
            own[:, j] = np.minimum(own[:, j], np.minimum.reduceat((h ^ salt) * odd, at))
    return out


def _bands(width: int, bands: int, rows: int, seed: int):
    rng = np.random.Generator(np.random.Philox(key=seed))
    salts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    odds = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sig = signatures(part.column(1).to_pylist(), width, salts, odds).reshape(part.num_rows, bands, rows).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (part.num_rows, bands)).copy()
                for j in range(rows):
                    key = (key ^ sig[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                pid = np.repeat(part.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.zeros(len(pid), dtype=np.int64)), pa.array(pid)], names=["key", "block", "pid"])

    return run


def _groups(most: int):
    """Members of keys with two or more, under a name that depends on the set of members; over-large keys under their own."""
    kinds, names = [pa.bool_(), pa.int64(), pa.int64()], ["over", "key", "pid"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts, (key, _, pid) in sorted_groups(batches, most):
            if not whole:
                yield _rows([np.ones(len(pid), dtype=bool), key, pid], kinds, names)
                continue
            sizes = np.diff(starts)
            shared = np.repeat(sizes > 1, sizes)
            name = np.zeros(len(pid), dtype=np.int64)
            for a, n in zip(starts[:-1][sizes > 1], sizes[sizes > 1], strict=True):
                name[a : a + n] = np.uint64(xxhash.xxh64_intdigest(pid[a : a + n].tobytes())).view(np.int64)
            if shared.any():
                yield _rows([np.zeros(int(shared.sum()), dtype=bool), name[shared], pid[shared]], kinds, names)

    return run


def _verify(width: int, threshold: float, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, starts, (_, _, pid, norm) in sorted_groups(batches, most):
            a: list[int] = []
            b: list[int] = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                for i, j in similar(list(norm[s:e]), width, threshold):
                    a.append(int(pid[s + i]))
                    b.append(int(pid[s + j]))
            if a:
                yield _rows([a, b], [pa.int64(), pa.int64()], ["a", "b"])

    return run


def paragraph_links(distinct: DataFrame, work: Scratch, width: int, threshold: float, most: int, seed: int = 11) -> DataFrame:
    """Verified links (a, b) that connect similar paragraphs of ``distinct`` (pid, norm)."""
    bands, rows = tune_bands(threshold)
    keys = distinct.select("pid", "norm").mapInArrow(_bands(width, bands, rows, seed), "key long, block long, pid long")
    keys = keys.repartition("key").sortWithinPartitions("key", "block", "pid")
    found = work.put(keys.mapInArrow(_groups(most), "over boolean, key long, pid long"), "groups")
    group = found.where("not over").select("key", F.lit(0).cast("long").alias("block"), "pid").distinct()
    large = found.where("over").select("key", "pid")
    if not large.isEmpty():
        n = large.groupBy("key").agg(F.ceil(F.count("*") / (most // 2)).cast("long").alias("n"))
        dealt = large.join(n, "key").withColumn("own", F.pmod(F.xxhash64("pid"), F.col("n"))).withColumn("other", F.explode(F.expr("sequence(0L, n - 1)")))
        block = F.lit(1) + F.least("own", "other") * F.col("n") + F.greatest("own", "other")
        group = group.union(dealt.select("key", block.cast("long").alias("block"), "pid"))
    group = work.put(group, "members")
    full = group.join(distinct.select("pid", "norm"), "pid").select("key", "block", "pid", "norm")
    full = full.repartition("key", "block").sortWithinPartitions("key", "block", "pid")
    return full.mapInArrow(_verify(width, threshold, 1 << 40), "a long, b long")


_WINDOW, _NEIGHBOURS = 25, 26
#: A unit: every run of so many words has a pick.
_UNIT = _WINDOW + _NEIGHBOURS - 1
#: Words on either side of a collision that its verification needs: a longer common run has a further collision.
_AROUND = _UNIT + 1
_ANCHOR = pa.struct([("h", pa.int64()), ("g", pa.int32()), ("w", pa.int32()), ("c0", pa.int32()), ("c1", pa.int32())])
_UNITS = "doc long, t1 long, t2 long, n_words int, first int, last int, found array<struct<h:long,g:int,w:int,c0:int,c1:int>>"


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values, size = best(values[:-step], values[step:]), size + step
    return values


def picks(words: Words, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first words of picked windows, and their digests; ``text`` numbers the text of each word."""
    n = len(text) - _WINDOW + 1
    none = np.zeros(0, dtype=np.int64)
    if n < 1:
        return none, none.astype(np.uint64)
    inside = text[:n] == text[_WINDOW - 1 :]
    h = words.digests(np.arange(n), _WINDOW)
    # Equal windows next to each other differ in the last bits, so one of them is picked.
    key = np.where(inside, h & ~np.uint64(63) | (np.arange(n, dtype=np.uint64) & np.uint64(63)), np.uint64(0xFFFFFFFFFFFFFFFF))
    chosen = none
    if n >= _NEIGHBOURS:
        least = _sliding(key, _NEIGHBOURS, np.minimum)
        least = np.where(text[: len(least)] == text[_UNIT - 1 :], least, np.uint64(0))
        edge = np.zeros(_NEIGHBOURS - 1, dtype=np.uint64)
        chosen = np.flatnonzero((_sliding(np.concatenate([edge, least, edge]), _NEIGHBOURS, np.maximum)[:n] == key) & inside)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]])
    short = [a + int(key[a : b - _WINDOW + 1].argmin()) for a, b in zip(starts[:-1], starts[1:], strict=True) if _WINDOW <= b - a < _UNIT]
    chosen = np.sort(np.concatenate([chosen, np.array(short, dtype=np.int64)]))
    return chosen, h[chosen]


def _around(words: Words, points: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points where the stretch around each picked window begins and ends."""
    begins = np.searchsorted(text, text[at], "left")
    ends = np.searchsorted(text, text[at], "right")
    low, high = np.maximum(at - _AROUND, begins), np.minimum(at + _WINDOW + _AROUND, ends)
    return points[words.start[low]] - 1, points[words.end[high - 1] - 1]


def _second(words: Words, at: np.ndarray) -> np.ndarray:
    """A further digest of each picked window."""
    return (words.digests(at, _WINDOW // 2) >> np.uint64(33)).astype(np.int64)


def _long(data: bytes) -> tuple[int, int, int, list[np.ndarray]]:
    """(words, first and last code point, columns of picks) of one text, in overlapping blocks."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    before = seen = first = last = n = base = 0
    for words, base, at, done in blocks(data, 4 * _AROUND):
        n = len(words.start)
        before += int(np.count_nonzero((np.frombuffer(data[seen:at], dtype=np.uint8) & 0xC0) != 0x80))
        seen = at
        if not n:
            continue
        text, points = np.zeros(n, dtype=np.int64), words.points()
        chosen, h = picks(words, text)
        mine = (chosen >= (_AROUND if base else 0)) & (chosen <= (n if done else n - _AROUND - _WINDOW))
        chosen, h = chosen[mine], h[mine]
        c0, c1 = _around(words, points, text, chosen)
        for column, x in zip(out, (h.view(np.int64), _second(words, chosen), chosen + base, c0 + before, c1 + before), strict=True):
            column.append(x)
        if not base:
            first = int(points[words.start[0]]) - 1
        last = before + int(points[words.end[-1] - 1])
    none = np.zeros(0, dtype=np.int64)
    columns = [np.concatenate([none, *c]) for c in out]
    once = np.unique(columns[2], return_index=True)[1]
    return base + n, first, last, [c[once] for c in columns]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words, first and last code point of each text, the number of its picks, and all picks as columns (h, g, w, c0, c1)."""
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        n, first, last, found = _long(texts[0])
        return np.array([n]), np.array([first]), np.array([last]), np.array([len(found[0])]), found
    words = Words(b"\n".join(texts) + b"\n")
    points = words.points()
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])  # in bytes
    text = np.searchsorted(begins, words.start, "right") - 1
    count = np.bincount(text, minlength=len(texts))
    before = np.concatenate([[0], points])[begins[:-1]]  # code points before each text
    edge = np.cumsum(count)
    some = count > 0
    first, last = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    first[some] = points[words.start[(edge - count)[some]]] - 1 - before[some]
    last[some] = points[words.end[edge[some] - 1] - 1] - before[some]
    chosen, h = picks(words, text)
    own = text[chosen] if len(text) else chosen
    c0, c1 = _around(words, points, text, chosen) if len(chosen) else (chosen, chosen)
    g = _second(words, chosen) if len(chosen) else chosen
    return count, first, last, np.bincount(own, minlength=len(texts)), [h.view(np.int64), g, chosen - (edge - count)[own], c0 - before[own], c1 - before[own]]


def _unit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [f.type for f in _ANCHOR]
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(3)]
        for at, to in groups_of(texts):
            count, first, last, n, found = anchors(texts[at:to])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], fields=list(_ANCHOR)))
            yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:3]), *(pa.array(x, pa.int32()) for x in (count, first, last)), listed], names=["doc", "t1", "t2", "n_words", "first", "last", "found"])


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points) of every word of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid = np.concatenate([[False], ~((codes == 32) | ((codes >= 9) & (codes <= 13))), [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def _agree(a: list[bytes], b: list[bytes], i: int, j: int) -> int:
    """How many words from ``a[i]`` and ``b[j]`` on are equal."""
    n, step = 0, 64
    while step:
        x = a[i + n : i + n + step]
        if len(x) == step and x == b[j + n : j + n + step]:
            n += step
        else:
            step //= 2
    return n


def matches(words: list[bytes], other: list[bytes], seeds: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(word, other's word, words, times) of the longest common runs around shared windows (word, other's word, times)."""
    back, other_back = words[::-1], other[::-1]
    found: dict[tuple[int, int], list[int]] = {}
    last: dict[int, tuple[int, int]] = {}  # the run last found at each distance
    for i, j, n in sorted(seeds):
        start, end = last.get(i - j, (0, 0))
        if i >= end:
            after = _agree(words, other, i, j)
            if after < _WINDOW:  # digests that only look alike
                continue
            before = _agree(back, other_back, len(words) - i, len(other) - j)
            start, end = last[i - j] = (i - before, i + after)
        run = found.setdefault((start, start - i + j), [end - start, n])
        run[1] = max(run[1], n)
    for (i, j), (size, n) in found.items():
        yield i, j, size, n


_SPANS = "t1 long, t2 long, doc long, start int, end int, keep_doc long, n long, removed boolean"


def _extended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both sides' spans of the runs that the stretches of two texts have in common."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["t1", "t2", "doc", "start", "end", "keep_doc", "n", "removed"]
    split = lambda t: t.encode("utf-8", "surrogatepass").lower().split()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out: list[list] = [[] for _ in names]
            for t1, t2, doc, k1, k2, keep_doc, seeds, w0, c0, keep_w0, keep_c0, text, keep_text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                same = (t1, t2) == (k1, k2)
                (starts, ends), (keep_starts, keep_ends) = word_places(text), word_places(keep_text)
                for i, j, n, times in matches(split(text), split(keep_text), [(s["w"] - w0, s["keep_w"] - keep_w0, s["n"]) for s in seeds]):
                    kept = n
                    if same:  # of a run that overlaps itself the first period stays
                        kept = min(n, i + w0 - j - keep_w0)
                    for span in (
                        (t1, t2, doc, c0 + int(starts[i]), c0 + int(ends[i + n - 1]), keep_doc, times, True),
                        (k1, k2, keep_doc, keep_c0 + int(keep_starts[j]), keep_c0 + int(keep_ends[j + kept - 1]), keep_doc, times, False),
                    ):
                        for column, x in zip(out, span, strict=True):
                            column.append(x)
            yield _rows(out, kinds, names)


def repeated_passages(rows: DataFrame, work: Scratch) -> DataFrame:
    """(doc, start, end, keep_doc, cluster_size, removed): passages of ``rows`` (doc, text) that occur more than once.

    Of equal windows the first (by document, then place) stays.  Each other one
    is a seed: from it the two texts are compared word by word both ways, to the
    ends of what they have in common.  A document's passages that stay and
    those that go merge separately where they overlap.  What a document shares
    with a later one only, beyond what both share with the first, is found from
    26 words on; ``cluster_size`` counts the copies of the commonest window.  Of
    equal texts of 25 words or more, all but the first document's go whole.
    """
    small_batches(rows.sparkSession)
    rows = rows.select("doc", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")  # equal texts have equal numbers
    units = work.put(rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(_unit_rows, _UNITS), "units")
    whole = F.struct("doc", "first", "last", "n_words", "found")
    texts = work.put(units.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min(whole).alias("x")).select("t1", "t2", "copies", "x.*"), "texts")
    several = work.put(texts.where(f"copies > 1 and n_words >= {_WINDOW}").select("t1", "t2", "copies", F.col("doc").alias("keep_doc")), "several")
    copies = units.select("t1", "t2", "doc", "first", "last").join(several, ["t1", "t2"]).where(~F.col("doc").eqNullSafe(F.col("keep_doc")))
    copies = work.put(copies.select("doc", F.col("first").alias("start"), F.col("last").alias("end"), "keep_doc", F.col("copies").alias("cluster_size"), F.lit(True).alias("removed")), "copies")
    work.drop("units")

    found = texts.select("t1", "t2", "doc", "copies", F.inline("found"))
    place = F.struct("doc", "t1", "t2", "w", "c0", "c1")
    times = found.groupBy("h", "g").agg(F.sum("copies").alias("n"), F.count("*").alias("places"), F.min(place).alias("keep")).where("places > 1").drop("places")
    shared = found.join(work.put(times, "anchor-times"), ["h", "g"])
    first = (F.col("t1") == F.col("keep.t1")) & (F.col("t2") == F.col("keep.t2")) & (F.col("w") == F.col("keep.w"))
    pairs = shared.where(~first).groupBy("t1", "t2", "doc", F.col("keep.t1").alias("k1"), F.col("keep.t2").alias("k2"), F.col("keep.doc").alias("keep_doc")).agg(
        F.collect_set(F.struct("w", F.col("keep.w").alias("keep_w"), "n")).alias("seeds"), F.greatest(F.min("w") - _AROUND, F.lit(0)).alias("w0"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
        F.greatest(F.min("keep.w") - _AROUND, F.lit(0)).alias("keep_w0"), F.min("keep.c0").alias("keep_c0"), F.max("keep.c1").alias("keep_c1"),
    )
    pairs = work.put(pairs, "pairs")
    need = pairs.select("t1", "t2").union(pairs.select("k1", "k2")).distinct()
    held = work.put(rows.select("t1", "t2", "text").join(need, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]), "pair-texts")
    clip = lambda a, b: F.substring("text", F.col(a) + 1, F.col(b) - F.col(a))
    one = pairs.join(held, ["t1", "t2"]).withColumn("clip", clip("c0", "c1")).drop("text")
    both = one.join(held.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "text"), ["k1", "k2"]).withColumn("keep_clip", clip("keep_c0", "keep_c1"))
    both = both.select("t1", "t2", "doc", "k1", "k2", "keep_doc", "seeds", "w0", "c0", "keep_w0", "keep_c0", "clip", "keep_clip")
    spans = both.mapInArrow(_extended, _SPANS)
    least = F.min(F.struct("keep_doc"))["keep_doc"].alias("keep_doc")  # null comes first
    stays = texts.join(several.select("t1", "t2"), ["t1", "t2"]).select("t1", "t2", "doc", F.col("first").alias("start"), F.col("last").alias("end"), F.col("doc").alias("keep_doc"), F.col("copies").alias("n"), F.lit(False).alias("removed"))
    spans = spans.unionByName(stays).groupBy("t1", "t2", "doc", "removed", "start", "end").agg(least, F.max("n").alias("n"))
    spans = work.put(spans, "spans")
    work.drop("pairs", "pair-texts", "anchor-times", "texts", "several")
    order = Window.partitionBy("t1", "t2", "removed").orderBy("start", "end")
    begins = F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    each = spans.withColumn("begins", begins).withColumn("no", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = each.groupBy("t1", "t2", "doc", "removed", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"), least, F.max("n").alias("cluster_size"))
    # What stays for one window may go for another: then it goes.
    gone = F.max(F.when(F.col("removed"), F.col("end"))).over(Window.partitionBy("t1", "t2").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("gone", F.coalesce(gone, F.lit(-1))).where(F.col("removed") | (F.col("gone") < F.col("end")))
    return each.select("doc", "start", "end", "keep_doc", "cluster_size", "removed").unionByName(copies)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, width: int = 5, threshold: float = 0.8, most: int = 512) -> DataFrame:
    """Repeated paragraphs (``kind`` paragraph, exact or near) and repeated passages inside lines (``kind`` passage, exact) in one table.

    Columns as of ``repeated_paragraphs``, with para_no, n_words and
    keep_para_no null for passages.  Passages of 50 words or more are always
    found, shorter ones of 25 or more sometimes; what is found is the whole
    passage.  The same rules for nulls,
    empty and long texts, ties, repeated rows and other columns.
    """
    work = Scratch(docs.sparkSession, "passages")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    lines = repeated_paragraphs(docs, id_col, text_col, min_words, width, threshold, most).withColumn("kind", F.lit("paragraph"))
    inside = repeated_passages(rows, work).select(
        F.col("doc").alias(id_col), F.lit(None).cast("int").alias("para_no"), "start", "end", F.lit(None).cast("int").alias("n_words"), F.col("keep_doc").alias("keep_doc_id"),
        F.lit(None).cast("int").alias("keep_para_no"), "cluster_size", "removed", F.lit("passage").alias("kind"),
    )
    return lines.unionByName(inside)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, width: int = 5, threshold: float = 0.8, most: int = 512) -> DataFrame:
    """One row for each paragraph that occurs, exactly or nearly, more than once.

    Columns: id, para_no (line number), start, end (code points), n_words,
    keep_doc_id and keep_para_no (the cluster's first occurrence, by id and
    line), cluster_size (occurrences), removed (all but the first).  Documents
    without repeats don't appear.  Null and empty texts have no paragraphs;
    very long ones are read whole.  Identifiers are integers, a null identifier
    sorts first.  A row repeated whole repeats its paragraphs; if the first
    occurrence itself is such a row, its twins are kept too.  An empty table
    gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession, "paragraphs")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = work.put(rows.mapInArrow(_occurrences(min_words), "doc long, no int, start int, end int, n_words int, digest binary, norm binary"), "occurrences")
    contents = found.where("norm is not null").groupBy("digest", "norm").agg(F.lit(1).alias("one"))
    found = found.drop("norm")
    distinct = work.put(contents.select(F.monotonically_increasing_id().alias("pid"), "digest", "norm"), "distinct")
    member = work.put(components(paragraph_links(distinct, work, width, threshold, most), work), "member")
    times = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "no")).alias("first"))
    rooted = distinct.select("pid", "digest").join(member, F.col("pid") == F.col("node"), "left").select("digest", F.coalesce("root", "pid").alias("root"))
    rooted = work.put(rooted.join(times, "digest"), "rooted")
    cluster = rooted.groupBy("root").agg(F.sum("n").alias("cluster_size"), F.min("first").alias("keep")).where("cluster_size > 1")
    cluster = work.put(cluster, "cluster")
    named = work.put(rooted.join(cluster, "root").select("digest", "cluster_size", "keep"), "named")
    work.drop("groups", "members", "distinct", "rooted", "member", "cluster")
    first = F.col("doc").eqNullSafe(F.col("keep.doc")) & (F.col("no") == F.col("keep.no"))
    return found.join(named, "digest").select(
        F.col("doc").alias(id_col), F.col("no").alias("para_no"), "start", "end", "n_words",
        F.col("keep.doc").alias("keep_doc_id"), F.col("keep.no").alias("keep_para_no"), "cluster_size", (~first).alias("removed"),
    )

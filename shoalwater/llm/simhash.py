"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  If two fingerprints
differ in at most three bits, one of the segments differs in at most one, so
the two share a variant of that segment with one bit left open.  Each distinct
fingerprint is indexed under its 2 x 32 one-wildcard variants; an equality join
brings those that share a variant together and the full distance is verified.
Inside a variant the links are followed breadth first, which yields a spanning
forest of the links, never all pairs; a variant with more than ``most``
members is compared in pairs of blocks, so no link is lost there either.

``similar_groups`` finds documents by similarity instead of by bits.  Texts with
a Jaccard similarity of 0.8 differ in about 15 % of a fingerprint's bits, far
more than three of 64, so it takes 126 bits in seven segments of 18: up to 13
differing bits leave some segment with at most one for certain, more with the
probability that the tests measure.  Candidates are verified by exact
similarity of their texts before they link.

Plan.  Texts are read once, by Arrow batches, and leave as (id, fingerprint).
Copies collapse into one fingerprint before anything is joined.  The index
rows of a fingerprint are a few integers each; their keys are dealt evenly since
a fingerprint appears once.  Components are found on fingerprints and joined
back to documents from written tables, so a fingerprint that a third of all
documents share is split.  Only candidates fetch their texts, each once for
every block that it is compared in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwater.llm.buckets import breadth_first, sorted_groups
from shoalwater.llm.components import components
from shoalwater.llm.shingling import mixed, shingle_digests, shingle_sets, similar
from shoalwater.scratch import Scratch
from shoalwater.session import small_batches

SEED = 42
#: Bytes of text whose shingles are hashed together.
_CHUNK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Space-joined runs of ``width`` of the words; all words if there are fewer."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def _parts(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The shingles of a text, A-Z in lower case, a chunk at a time."""
    held: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        gap = _GAP.search(text, at + _CHUNK)
        to = gap.start() if gap else len(text)
        held += text[at:to].lower().split()
        at = to
        if len(held) >= width:
            yield shingles(held, width)
            some, held = True, held[len(held) - width + 1 :]
    if held and not some:
        yield shingles(held, width)


def fingerprint(text: bytes, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values; no words: zero."""
    digest, n = xxhash.xxh64_intdigest, 0
    counts = np.zeros(64, dtype=np.int64)
    for part in _parts(text, width):
        h = np.fromiter((digest(s, SEED) for s in part), dtype="<u8", count=len(part))
        for a in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprints(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc", "fp"])

    return run


_OUT = "over boolean, key long, block long, a long, b long"
_NAMES = ["over", "key", "block", "a", "b"]


def _emit(over: bool, key: np.ndarray, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), over)), *(pa.array(x, pa.int64()) for x in (key, block, a, b))], names=_NAMES)


def _links(bits: int, most: int):
    """From rows (key, block, fp) sorted by key: verified links, and the rows of keys that are too large."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts, (key, block, fp) in sorted_groups(batches, most):
            if not whole:
                yield _emit(True, key, block, fp, fp)
                continue
            sizes = np.diff(starts)
            at = starts[:-1][sizes == 2]
            a, b = [fp[at]], [fp[at + 1]]
            near = np.bitwise_count((a[0] ^ b[0]).view(np.uint64)) <= bits
            a, b = [a[0][near]], [b[0][near]]
            for s, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                own = fp[s : s + n]
                pairs = breadth_first(int(n), lambda i, rest, own=own: np.bitwise_count((own[rest] ^ own[i]).view(np.uint64)) <= bits)
                if pairs:
                    i, j = np.array(pairs).T
                    a.append(own[i])
                    b.append(own[j])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                none = np.zeros(len(a), dtype=np.int64)
                yield _emit(False, none, none, np.minimum(a, b), np.maximum(a, b))

    return run


def fingerprint_links(distinct: DataFrame, work: Scratch, bits: int = 3, most: int = 4096) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints ``fp`` of ``distinct`` lie within ``bits`` <= 3 of each other."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments find at most three differing bits")
    half = "(fp >>> (32 * (v div 32))) & 4294967295"
    keys = distinct.select("fp", F.explode(F.expr("sequence(0L, 63L)")).alias("v"))
    keys = keys.selectExpr(f"(v << 32) | (({half}) & ~(1L << cast(v % 32 as int))) as key", "0L as block", "fp")

    def linked(rows: DataFrame, most: int) -> DataFrame:
        return rows.repartition("key", "block").sortWithinPartitions("key", "block", "fp").mapInArrow(_links(bits, most), _OUT)

    found = work.put(linked(keys, most), "found")
    links = found.where("not over").select("a", "b")
    large = found.where("over").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return links
    # Blocks of about `most` members; every two blocks of a key meet in one group.
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / (most // 2)).alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    dealt = large.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, n - 1)")))
    pair = F.least("own", "other") * F.col("n") + F.greatest("own", "other")
    dealt = dealt.select("key", pair.cast("long").alias("block"), "fp")
    return links.union(linked(dealt, 1 << 40).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3, most: int = 4096) -> DataFrame:
    """One row per row of ``docs``: (id, fingerprint, component_id).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    id reachable over fingerprints that differ in at most ``bits`` bits, itself
    included.  A null, empty or blank text has fingerprint zero and links like
    any other.  Repeated rows give repeated results; identifiers are integers,
    and a null identifier is never the smallest unless all are null.  Texts are
    read whole.  Extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    prints = work.put(rows.mapInArrow(_fingerprints(width), "doc long, fp long"), "prints")
    distinct = work.put(prints.groupBy("fp").agg(F.min("doc").alias("first")), "distinct")
    member = work.put(components(fingerprint_links(distinct.select("fp"), work, bits, most), work), "member")
    rooted = distinct.join(member, distinct["fp"] == member["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = work.put(rooted, "rooted")
    least = work.put(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = work.put(rooted.join(least, "root").select("fp", "component_id"), "named")
    work.keep("prints", "named")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select(F.col("doc").alias(id_col), text.alias("fingerprint"), "component_id")


#: Segments and bits of a segment of the wide fingerprint, and how far apart candidates may be: four deviations beyond the mean at a similarity of 0.8.
SEGMENTS, SEGMENT_BITS, FARTHEST = 7, 18, 35


def wide_fingerprints(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 63 bits of SimHash for each text, and its number of shingles."""
    counts, n = np.zeros((len(texts), 128), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for a, h, runs in shingle_digests(texts, width):
        bits = np.unpackbits(np.stack([h, mixed(h ^ np.uint64(SEED))], axis=1).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        some = np.flatnonzero(runs)
        if len(some):
            counts[a + some] += np.add.reduceat(bits, (np.cumsum(runs) - runs)[some], axis=0, dtype=np.int32)
            n[a : a + len(runs)] += runs
    words = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view("<u8") & np.uint64((1 << 63) - 1)
    return words.view(np.int64), n


def _wide_rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words, n = wide_fingerprints([t.as_py() or b"" for t in part.column(2)], width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(n)], names=["k1", "k2", "high", "low", "n"])

    return run


def _variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint under each of its segments with each bit of it left open."""
    segment, bit = (x.reshape(-1).astype(np.int64) for x in np.meshgrid(np.arange(SEGMENTS), np.arange(SEGMENT_BITS), indexing="ij"))
    none = np.zeros(len(segment), dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            high, low = (c.to_numpy() for c in batch.slice(at, 4096).columns)
            joined = [(high >> (SEGMENT_BITS * i)) if i < 3 else (low >> (SEGMENT_BITS * (i - 3))) if i < 6 else (high >> 54) | ((low >> 54) << 9) for i in range(SEGMENTS)]
            value = np.stack(joined, axis=1)[:, segment] & ((1 << SEGMENT_BITS) - 1) & ~(1 << bit)
            key = (segment * SEGMENT_BITS + bit) << SEGMENT_BITS | value
            size = len(segment)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.tile(none, len(high))), pa.array(np.repeat(high, size)), pa.array(np.repeat(low, size))], names=["key", "block", "high", "low"])


def _wide_links(most: int):
    """Links within ``FARTHEST`` bits of rows sorted by key; the rows of keys that are too large."""
    names = ["over", "key", "high", "low", "high2", "low2"]

    def apart(high, low, i, j):
        return np.bitwise_count(high[i] ^ high[j]).astype(np.int16) + np.bitwise_count(low[i] ^ low[j])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts, (key, _, high, low) in sorted_groups(batches, most):
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), dtype=bool)), *map(pa.array, (key, high, low, high, low))], names=names)
                continue
            sizes = np.diff(starts)
            # Rows are sorted, so the first of a group is its least: most link to it, which is the same in many groups.
            head = np.repeat(starts[:-1], sizes)
            own = np.arange(len(key))
            near = (own != head) & (apart(high, low, head, own) <= FARTHEST)
            left, right = [head[near]], [own[near]]
            settled = near | (own == head)
            small = np.repeat(sizes <= 8, sizes)
            for step in range(1, 8):  # the others of small groups: neighbours at every distance, for all groups together
                i = np.flatnonzero((key[:-step] == key[step:]) & small[:-step] & ~(settled[:-step] & settled[step:])) if len(key) > step else np.zeros(0, dtype=np.int64)
                i = i[apart(high, low, i, i + step) <= FARTHEST]
                left.append(i)
                right.append(i + step)
            for s, n in zip(starts[:-1][sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                if not settled[s : s + n].all():
                    found = breadth_first(n, lambda i, rest, s=s: apart(high, low, np.array([s + i]), s + rest) <= FARTHEST)
                    found = [(s + i, s + j) for i, j in found if not (settled[s + i] and settled[s + j])]
                    if found:
                        i, j = np.array(found).T
                        left.append(i)
                        right.append(j)
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                if len(i):
                    zero = np.zeros(len(i), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(zero.astype(bool)), *map(pa.array, (zero, high[i], low[i], high[j], low[j]))], names=names)

    return run


def _against_leader(width: int, threshold: float):
    """(root, rid, size, near) of rows (root, rid, text, leader): whether the two texts are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                roots, texts = part.column(0).to_pylist(), [t.as_py() or b"" for t in part.column(2)]
                near = []
                for i, (root, own) in enumerate(zip(roots, shingle_sets(texts, width), strict=True)):
                    if last[0] != root:
                        last = (root, shingle_sets([part.column(3)[i].as_py() or b""], width)[0])
                    common = len(np.intersect1d(own, last[1], assume_unique=True))
                    near.append(common > 0 and common >= threshold * (len(own) + len(last[1]) - common) - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(near, pa.bool_())], names=["root", "rid", "size", "near"])

    return run


def _verified(width: int, threshold: float):
    """Links of rows (key, block, id, text) sorted by key and block whose texts are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, starts, (_, _, rid, text) in sorted_groups(batches, 1 << 40):
            pairs = [(int(rid[s + i]), int(rid[s + j])) for s, e in zip(starts[:-1], starts[1:], strict=True) for i, j in similar([t or b"" for t in text[s:e]], width, threshold)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

    return run


def similar_groups(rows: DataFrame, work: Scratch, width: int = 5, threshold: float = 0.8, most: int = 4096, together: int = 1 << 23) -> DataFrame:
    """(k1, k2, root): group of each row of ``rows`` (k1, k2, text) that is similar, over others or directly, to another row.

    (k1, k2) identifies a row; rows with the same pair count once.  Similar are
    texts whose sets of ``width``-word shingles have at least the Jaccard
    similarity ``threshold``.  Texts without words are in no group.  In a group of
    candidates all are verified against the first; those that are not similar
    to it meet the whole group, in blocks of ``together`` bytes of text.
    """
    small_batches(rows.sparkSession)
    text = F.col("text").cast("binary")
    prints = rows.select("k1", "k2", text.alias("text")).mapInArrow(_wide_rows(width), "k1 long, k2 long, high long, low long, n long").where("n > 0").drop("n")
    prints = work.put(prints.groupBy("k1", "k2").agg(F.first("high").alias("high"), F.first("low").alias("low")).withColumn("rid", F.monotonically_increasing_id()), "prints")
    distinct = work.put(prints.groupBy("high", "low").agg(F.min("rid").alias("rep")), "distinct")

    def linked(frame: DataFrame, most: int) -> DataFrame:
        return frame.repartition("key", "block").sortWithinPartitions("key", "block", "high", "low").mapInArrow(_wide_links(most), "over boolean, key long, high long, low long, high2 long, low2 long")

    found = work.put(linked(distinct.select("high", "low").mapInArrow(_variants, "key long, block long, high long, low long"), most).distinct(), "found")
    large = found.where("over").select("key", "high", "low")
    if not large.isEmpty():
        n = large.groupBy("key").agg(F.ceil(F.count("*") / (most // 2)).cast("long").alias("n"))
        dealt = large.join(n, "key").withColumn("own", F.pmod(F.xxhash64("high", "low"), "n")).withColumn("other", F.explode(F.expr("sequence(0L, n - 1)")))
        dealt = dealt.select("key", (F.least("own", "other") * F.col("n") + F.greatest("own", "other")).cast("long").alias("block"), "high", "low")
        found = found.where("not over").unionByName(linked(dealt, 1 << 40))
    near = found.where("not over").select("high", "low", "high2", "low2").distinct()
    near = near.join(distinct, ["high", "low"]).select(F.col("rep").alias("a"), F.col("high2").alias("high"), F.col("low2").alias("low")).join(distinct.withColumnRenamed("rep", "b"), ["high", "low"]).select("a", "b")
    alike = prints.join(distinct, ["high", "low"]).where("rid <> rep").select(F.col("rep").alias("a"), F.col("rid").alias("b"))
    candidate = work.put(components(near.union(alike), work), "candidate").withColumnRenamed("node", "rid")
    work.drop("found")
    need = prints.join(candidate.select("rid"), "rid").select("k1", "k2", "rid")
    held = work.put(rows.join(need, ["k1", "k2"]).dropDuplicates(["rid"]).select("rid", text.alias("text")), "held")
    # Every member against the first of its group; linear, and in a group of near copies it settles nearly all.
    leader = held.select(F.col("rid").alias("root"), F.col("text").alias("leader"))
    against = candidate.where("rid <> root").join(held, "rid").join(leader, "root").select("root", "rid", "text", "leader")
    starred = work.put(against.mapInArrow(_against_leader(width, threshold), "root long, rid long, size long, near boolean"), "starred")
    links = starred.where("near").select(F.col("root").alias("a"), F.col("rid").alias("b"))
    strangers = starred.where("not near")
    if not strangers.isEmpty():
        # The others against all: their blocks meet the blocks of the whole group.
        count = lambda frame, name: frame.groupBy("root").agg(F.ceil(F.sum("size") / together).cast("long").alias(name))
        counts = work.put(count(strangers, "n").join(count(starred, "m"), "root"), "counts")
        dealt = lambda frame, own, other: frame.join(counts, "root").withColumn(own, F.pmod(F.xxhash64("rid"), "n" if own == "i" else "m")).withColumn(other, F.explode(F.expr(f"sequence(0L, {'m' if own == 'i' else 'n'} - 1)")))
        both = dealt(strangers, "i", "j").unionByName(dealt(starred, "j", "i"))
        member = both.select(F.col("root").alias("key"), (F.col("i") * F.col("m") + F.col("j")).alias("block"), "rid").distinct()
        full = member.join(held, "rid").select("key", "block", "rid", "text").repartition("key", "block").sortWithinPartitions("key", "block", "rid")
        links = links.union(full.mapInArrow(_verified(width, threshold), "a long, b long"))
    verified = components(links, work)
    groups = work.put(verified.join(prints.select("k1", "k2", "rid"), F.col("node") == F.col("rid")).select("k1", "k2", "root"), "groups")
    work.drop("prints", "distinct", "candidate", "held", "starred", "counts")
    return groups

"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary (hash and displace, no
empty slot) sends a whole pre-token to the one slot it could have; comparing
the stored bytes tells a hit from a miss.  Second tier, for misses: a heap of
candidate merges over a linked list of byte pieces, always merging the lowest
rank, leftmost on ties, in O(n log n) for a pre-token of n bytes.

Plan.  Both directions are narrow Arrow maps without a shuffle.  The vocabulary
(a fixed file of about 50,000 entries, under a megabyte) is read on the driver
and broadcast, so executors open no file.  A worker remembers recent
pre-tokens in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.session import small_batches


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: base64 bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class PerfectHash:
    """Minimal perfect hash of byte strings to (slot, value); n slots for n keys."""

    def __init__(self, values: dict[bytes, int]):
        n = len(values)
        self.n, self.buckets = n, max(1, n // 3)
        self.keys: list[bytes] = [b""] * n
        self.values: list[int] = [0] * n
        self.shift: list[int] = [0] * self.buckets
        grouped: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in values:
            grouped[xxhash.xxh3_64_intdigest(key) % self.buckets].append(key)
        free = bytearray(b"\x01") * n
        order = sorted(range(self.buckets), key=lambda b: -len(grouped[b]))
        single = []
        for b in order:
            own = grouped[b]
            if len(own) < 2:
                single += [b] * len(own)
                continue
            shift = 1
            while True:
                slots = {xxhash.xxh3_64_intdigest(k, shift) % n for k in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                shift += 1
            self.shift[b] = shift
            for k in own:
                self._place(k, xxhash.xxh3_64_intdigest(k, shift) % n, values, free)
        empty = iter([s for s in range(n) if free[s]])
        for b in single:  # a lone key is sent straight to a free slot
            slot = next(empty)
            self.shift[b] = -1 - slot
            self._place(grouped[b][0], slot, values, free)

    def _place(self, key: bytes, slot: int, values: dict[bytes, int], free: bytearray) -> None:
        self.keys[slot], self.values[slot], free[slot] = key, values[key], 0

    def get(self, key: bytes) -> int | None:
        """The key's value, or None if it is not one of the keys."""
        if not self.n:
            return None
        shift = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -1 - shift if shift < 0 else xxhash.xxh3_64_intdigest(key, shift) % self.n
        return self.values[slot] if self.keys[slot] == key else None


def joins(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id x size + right id -> id of the joined bytes, for every way to cut an entry into two entries."""
    size = max(ranks.values(), default=0) + 1
    return {
        ranks[token[:i]] * size + ranks[token[i:]]: rank
        for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
    }


def merge(piece: list[int], rank: list[int | None], right: list[dict[int, int]]) -> list[int]:
    """Merge neighbouring ids (at first one for each byte) until no two neighbours join.

    ``right[a][b]`` is the id of a and b joined; ``rank`` has it for each piece and the next, None for the last.
    """
    n = len(piece)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    heap = [r << shift | i for i, r in enumerate(rank) if r is not None]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r = heappop(heap)
        i = r & mask
        r >>= shift
        if rank[i] != r:
            continue  # one of the two has been merged since
        j, h = after[i], before[i]
        after[i] = k = after[j]
        piece[i], piece[j], rank[j] = r, -1, None
        if k < n:
            before[k] = i
            rank[i] = s = right[r].get(piece[k])
            if s is not None:
                heappush(heap, s << shift | i)
        else:
            rank[i] = None
        if h >= 0:
            rank[h] = s = right[piece[h]].get(r)
            if s is not None:
                heappush(heap, s << shift | h)
    return [x for x in piece if x >= 0]


#: Letters and numbers of Unicode versions after 16.0, which the tiktoken library takes for other characters (fixed values).
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Neither letter, number nor white space in any version.
_OTHER = "\ue000"


#: Parts of a pattern: classes of characters, escapes, brackets, single characters.
_PARTS = re.compile(r"\\p\{[LN]\}|\\.|\[\^?|.", re.S)
_WIDE = re.compile("[\U00010000-\U0010ffff]")


def spelled(pattern: str, top: int) -> str | None:
    r"""The pattern with \p{L}, \p{N}, \s and \S as the ranges they have below ``top``, for the faster engine; None if it has other escapes or flags.

    Letters and numbers of LATER are left out, so they count as other characters.
    """
    if re.search(r"\(\?(?![!=:])|\[\^?\]", pattern):
        return None
    later, chars = re.compile(f"[{LATER}]"), [chr(c) for c in range(top) if not 0xD800 <= c < 0xE000]

    def ranges(name: str) -> str:
        out: list[list[int]] = []
        hit = regex.compile(name).match
        for c in chars:
            if hit(c) and (name == r"\s" or not later.match(c)):
                if out and out[-1][1] == ord(c) - 1:
                    out[-1][1] += 1
                else:
                    out.append([ord(c), ord(c)])
        return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in out)

    known = {name: ranges(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    made, inside = [], False
    for part in _PARTS.findall(pattern):
        if part in known:
            part = known[part] if inside else f"[{known[part]}]"
        elif part == r"\S" and not inside:
            part = f"[^{known[chr(92) + 's']}]"
        elif part[0] == "\\":
            return None
        elif part[0] == "[":
            if inside:
                return None
            inside = True
        elif part == "]":
            inside = False
        made.append(part)
    return "".join(made)


#: Pre-tokens that a worker remembers, twice, beside other stages or alone; just below what Python's tables of 2**17 and 2**19 places take before they double.
REMEMBER, REMEMBER_MORE = 87_000, 349_000


class _Memory(dict):
    """Ids by pre-token; what is missing is found by ``one``."""

    def __init__(self, one):
        self.one = one

    def __missing__(self, token: str) -> bytes:
        return self.one(token)


class Encoder:
    """Text to token ids; twice ``remember`` bounds the table of recent pre-tokens.

    Ids are remembered as packed 32-bit numbers, so a text's ids are one join of
    bytes.
    """

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pair: dict[int, int], pattern: str, remember: int = REMEMBER, quick: tuple[str | None, str | None] | None = None):
        self.table, self.size, self.remember = table, max(ranks.values()) + 1, remember
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        none: dict[int, int] = {}
        self.right = [none] * self.size
        for both, rank in pair.items():
            a, b = divmod(both, self.size)
            if self.right[a] is none:
                self.right[a] = {}
            self.right[a][b] = rank
        self.two = [self.right[a].get(b) for a in self.bytes for b in self.bytes]
        self.pattern, self.later = regex.compile(pattern), re.compile(f"[{LATER}]")
        narrow, plane = quick or (spelled(pattern, 0x80), spelled(pattern, 0x10000))
        self.narrow, self.plane = (re.compile(p).findall if p else None for p in (narrow, plane))
        self.recent, self.older = _Memory(self.one), {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if self.narrow and text.isascii():
            return self.narrow(text)
        if self.plane and not _WIDE.search(text):
            return self.plane(text)
        if text.isascii() or not self.later.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.later.sub(_OTHER, text))]

    def one(self, token: str) -> bytes:
        """Packed ids of a pre-token that is not among the recent ones (or was not when its text began)."""
        ids = self.recent.get(token) or self.older.get(token)
        if ids is None:
            data = token.encode("utf-8", "surrogatepass")
            rank = self.table.get(data)
            ids = array("i", self.merged(data) if rank is None else [rank]).tobytes()
        if len(token) <= 64:
            if len(self.recent) >= self.remember:
                self.older, self.recent = self.recent, _Memory(self.one)
            self.recent[token] = ids
        return ids

    def merged(self, data: bytes) -> list[int]:
        """Ids of bytes that are no entry."""
        byte, two = self.bytes, self.two
        return merge([byte[b] for b in data], [*[two[a << 8 | b] for a, b in zip(data, data[1:])], None], self.right)

    def packed(self, text: str) -> np.ndarray:
        """The token ids of a text."""
        return np.frombuffer(b"".join(map(self.recent.__getitem__, self.split(text))), dtype=np.int32)

    def __call__(self, text: str) -> list[int]:
        return self.packed(text).tolist()


def _encoded(texts: pa.Array, encode: Encoder) -> pa.ListArray:
    return _lists([encode.packed(t.as_py() or "") for t in texts])


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *ids])))


def _decoded(lists: pa.Array, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    start, size, blob = table
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
        raise ValueError("an id outside the vocabulary")
    end = np.cumsum(size[ids])
    data = blob[np.arange(end[-1] if len(end) else 0) + np.repeat(start[ids] - end + size[ids], size[ids])]
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(data.tobytes())])


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of what arrives: a few long texts at a time are held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Tokenizer:
    """Driver-side handle: reads the rank file once and ships it to executors."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, remember: int = REMEMBER):
        small_batches(spark)
        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every byte")
        name = hashlib.sha256(repr((sorted(ranks.items()), pattern, remember)).encode()).hexdigest()
        self.shared = spark.sparkContext.broadcast((name, (ranks, PerfectHash(ranks), joins(ranks), pattern, remember), (spelled(pattern, 0x80), spelled(pattern, 0x10000))))
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.pieces = spark.sparkContext.broadcast((np.cumsum(size) - size, size, np.frombuffer(b"".join(pieces), dtype=np.uint8)))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows (id, ids): the token ids of each row's whole text.

        A null or empty text has no tokens.  Rows are mapped one by one, so
        repeats and ties change nothing; an empty table stays empty; extra
        columns are dropped.  No special tokens exist: their strings are text.
        """
        shared = self.shared
        kind = docs.schema[id_col].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = _worker(shared)
            for part in _slices(batches):
                yield pa.RecordBatch.from_arrays([part.column(0), _encoded(part.column(1), encode)], names=["doc", "ids"])

        found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc {kind}, ids array<int>")
        return found.withColumnRenamed("doc", id_col)

    def decode(self, tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """Rows (id, ids, data): the bytes that the ids stand for.

        Null ids give empty bytes; an id outside the vocabulary raises an error.
        """
        shared = self.pieces
        kind = tokens.schema[id_col].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _decoded(part.column(1), shared.value)], names=["doc", "ids", "data"])

        found = tokens.select(F.col(id_col).alias("doc"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc {kind}, ids array<int>, data binary")
        return found.withColumnRenamed("doc", id_col)

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
        """Rows (id, ids, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again in one pass.

        The same functions as ``encode`` and ``decode``, run on a few texts at a
        time, so that tokens and decoded bytes need not travel between processes;
        without ``keep_ids`` only their counts and digests leave the worker.
        """
        shared, pieces = self.shared, self.pieces
        kind = docs.schema[id_col].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = _worker(shared)
            decimal = list(map(str, range(encode.size)))
            for part in _slices(batches):
                ids = [encode.packed(t.as_py() or "") for t in part.column(1)]
                lists = _lists(ids)
                columns = [part.column(0), *([lists] if keep_ids else []), pc.cast(pc.list_value_length(lists), pa.int64())]
                listed = [hashlib.sha256(",".join([decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in ids]
                data = [hashlib.sha256(x.as_buffer()).hexdigest() for x in _decoded(lists, pieces.value)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(listed), pa.array(data)], names=["doc", *(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

        form = f"doc {kind}, {'ids array<int>, ' if keep_ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string"
        found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, form)
        return found.withColumnRenamed("doc", id_col)


_ENCODERS: dict[str, Encoder] = {}


def _worker(shared) -> Encoder:
    """The encoder of a vocabulary, named by its digest, kept from task to task of a worker process."""
    name, parts, quick = shared.value
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(*parts, quick=quick)
    return _ENCODERS[name]


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of decoded tokens."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))

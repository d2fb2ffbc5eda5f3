"""Lossless WebP media columns: a decoder of the whole VP8L format, and an encoder for payloads.

The decoder reads prefix codes (simple, normal, and groups chosen by an entropy
image), back-references with the two-dimensional distance codes, and the colour
cache, then inverts the predictor, cross-colour, subtract-green and palette
transforms (with packed pixels) and writes pixel arrays (height x width, four
bytes R, G, B, A).  A stream whose green code has literals only and whose other
codes have one symbol each is decoded with array operations: the symbol and
the next position are looked up for every bit position at once.

Payload images are grey: one payload byte is the sample of a pixel, 192 pixels
a row.  A payload too high for one image becomes several in a row.  Every image
can be written as literals after the subtract-green transform, which decode with
array operations.  A small image, and a large one that mostly repeats itself, is
also written with back-references; the smallest with a colour cache instead of
the transform, those of few different samples with a palette and packed pixels, small ones that a neighbour predicts well with predictions.  The shortest file is
kept.  (Cross-colour can't shorten a grey image.)
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwater.session import small_batches

#: Order in which code length code lengths are stored (fixed values of the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Offsets (x, y) of the first 120 distance codes (fixed values of the format).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICT, CROSS, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
ROW, MOST_ROWS = 192, 16384


# ---------------------------------------------------------------- bits and codes


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.padded = data + b"\0" * 8

    def peek(self) -> int:
        """At least 24 bits from here."""
        byte = self.at >> 3
        return int.from_bytes(self.padded[byte : byte + 4], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image data ends early")
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        return int.from_bytes(self.padded[byte : byte + 5], "little") >> shift & ((1 << n) - 1)


class Code:
    """A canonical prefix code as one table: window of ``width`` bits to symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lengths = lengths
        self.only = int(used[0]) if len(used) == 1 else None
        self.width = 0
        if self.only is not None or not len(used):
            if not len(used):
                raise ValueError("a prefix code without symbols")
            return
        own = lengths[used]
        if (2.0 ** -own.astype(float)).sum() != 1.0:
            raise ValueError("a prefix code that is not complete")
        self.width = int(own.max())
        symbol = np.empty(1 << self.width, dtype=np.int32)
        length = np.empty(1 << self.width, dtype=np.int32)
        for s, n, code in zip(used.tolist(), own.tolist(), canonical(lengths)[used].tolist(), strict=True):
            symbol[code :: 1 << n] = s
            length[code :: 1 << n] = n
        self.symbol, self.length = symbol, length
        self.symbols: list[int] = []
        self.sizes: list[int] = []

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if not self.symbols:
            self.symbols, self.sizes = self.symbol.tolist(), self.length.tolist()
        window = bits.peek() & ((1 << self.width) - 1)
        bits.at += self.sizes[window]
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
        return self.symbols[window]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its bits in stream order."""
    out, code = np.zeros(len(lengths), dtype=np.int64), 0
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    before = 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - before
        before = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


def read_code(bits: Bits, size: int) -> Code:
    """A prefix code from its description."""
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):  # simple: one or two symbols
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise ValueError("a symbol beyond the alphabet")
        lengths[symbols] = 1
        return Code(lengths)
    own = np.zeros(19, dtype=np.int64)
    for i in range(bits.read(4) + 4):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        n = bits.read(2) + 3 if s == 16 else bits.read(3) + 3 if s == 17 else bits.read(7) + 11
        if at + n > size:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + n] = last if s == 16 else 0
        at += n
    return Code(lengths)


def _extra(bits: Bits, prefix: int) -> int:
    """The value of a length or distance prefix, at least 1."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


# ---------------------------------------------------------------- entropy-coded images


def _literals(bits: Bits, code: Code, n: int) -> np.ndarray:
    """n symbols of one code, in pieces of bounded size.

    The table is consulted at every bit position at once, which gives where the
    next symbol would begin; doubling that map steps over sixteen symbols, and
    the positions between are filled in from the maps for eight, four, two, one.
    """
    out, done = np.empty(n, dtype=np.uint8), 0
    while done < n:
        want = min(n - done, 1 << 16)
        byte = bits.at >> 3
        raw = np.frombuffer(bits.padded, dtype=np.uint8, count=min(len(bits.padded) - byte, (want * code.width >> 3) + 8), offset=byte).astype(np.uint32)
        words = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.width) - 1)).reshape(-1)
        step = np.arange(len(window), dtype=np.int32)
        step += code.length[window]
        np.minimum(step, len(window) - 1, out=step)
        steps = [step]
        for _ in range(4):
            steps.append(steps[-1][steps[-1]])
        far, at = steps[-1].item, bits.at & 7
        path = [at]
        for _ in range((want - 1) >> 4):
            path.append(at := far(at))
        place = np.array(path, dtype=np.int32)
        for level in (3, 2, 1, 0):
            place = np.stack([place, steps[level][place]], axis=1).reshape(-1)
        place = place[:want]
        last = int(place[-1])
        found = window[place]
        out[done : done + want] = code.symbol[found]
        done += want
        bits.at = 8 * byte + last + int(code.length[window[last]])
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
    return out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as width * height ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    groups, choice, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tiles = (width + (1 << tile) - 1) >> tile
        choice = (read_image(bits, tiles, (height + (1 << tile) - 1) >> tile, False) >> 8 & 0xFFFF).tolist()
        groups = max(choice) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if groups == 1:
        green, red, blue, alpha, _ = codes[0]
        if None not in (red.only, blue.only, alpha.only) and not green.lengths[256:].any():
            out8 = np.empty((n, 4), dtype=np.uint8)
            out8[:] = (blue.only, 0, red.only, alpha.only)
            out8[:, 1] = green.only if green.only is not None else _literals(bits, green, n)
            return out8.view("<u4").reshape(-1)
    out: list[int] = [0] * n
    cache = [0] * cache_size
    shift, cached, at, own = 32 - cache_bits, 0, 0, codes[0]
    while at < n:
        if choice is not None:
            own = codes[choice[(at // width >> tile) * tiles + (at % width >> tile)]]
        s = own[0].read(bits)
        if s < 256:
            red = own[1].read(bits)
            blue = own[2].read(bits)
            out[at] = own[3].read(bits) << 24 | red << 16 | s << 8 | blue
            at += 1
            continue
        if cache_size:  # colours enter the cache in order, before it is next used
            while cached < at:
                cache[(out[cached] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
        if s >= 280:
            out[at] = cache[s - 280]
            at += 1
            continue
        length = _extra(bits, s - 256)
        code = _extra(bits, own[4].read(bits))
        if code > 120:
            distance = code - 120
        else:
            x, y = NEAR[code - 1]
            distance = max(1, x + y * width)
        if distance > at or at + length > n:
            raise ValueError("a back-reference outside the image")
        if distance >= length:
            out[at : at + length] = out[at - distance : at - distance + length]
        else:
            out[at : at + length] = (out[at - distance : at] * (length // distance + 1))[:length]
        at += length
    return np.array(out, dtype="<u4")


# ---------------------------------------------------------------- inverse transforms


def _channels(argb: np.ndarray) -> np.ndarray:
    """Rows of B, G, R, A: the bytes of little-endian ARGB values."""
    return np.ascontiguousarray(argb, dtype="<u4").view(np.uint8).reshape(-1, 4)


def _values(channels: np.ndarray) -> np.ndarray:
    """ARGB values of rows of B, G, R, A."""
    return np.ascontiguousarray(channels, dtype=np.uint8).view("<u4").reshape(-1)


def _predicted(mode: int, left, top, top_right, top_left) -> tuple:
    """Prediction of a pixel (each argument four channel values) by modes 0 to 13."""
    mean = lambda a, b: tuple((x + y) >> 1 for x, y in zip(a, b))
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    match mode:
        case 0:
            return (0, 0, 0, 255)
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return mean(mean(left, top_right), top)
        case 6:
            return mean(left, top_left)
        case 7:
            return mean(left, top)
        case 8:
            return mean(top_left, top)
        case 9:
            return mean(top, top_right)
        case 10:
            return mean(mean(left, top_left), mean(top, top_right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, top_left))
            to_top = sum(abs(a - c) for a, c in zip(left, top_left))
            return left if to_left < to_top else top
        case 12:
            return tuple(clamp(a + t - c) for a, t, c in zip(left, top, top_left))
        case 13:
            half = mean(left, top)
            return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half, top_left))
    return (0, 0, 0, 255)


def unpredict(argb: np.ndarray, width: int, height: int, tile: int, modes: list[int]) -> np.ndarray:
    """Add the predictions back, pixel by pixel."""
    rest = _channels(argb).tolist()
    out: list[tuple] = []
    tiles = (width + (1 << tile) - 1) >> tile
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                guess = out[i - 1] if x else (0, 0, 0, 255)
            elif not x:
                guess = out[i - width]
            else:  # the pixel right of the last one above is the first of this row
                guess = _predicted(modes[(y >> tile) * tiles + (x >> tile)], out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
            out.append(tuple((a + b) & 255 for a, b in zip(rest[i], guess)))
    return _values(np.array(out))


def _spread(values: np.ndarray, width: int, height: int, tile: int) -> np.ndarray:
    """A value per tile to a value per pixel."""
    tiles = (width + (1 << tile) - 1) >> tile
    return values.reshape(-1, tiles)[np.arange(height)[:, None] >> tile, np.arange(width)[None, :] >> tile].reshape(-1)


def uncross(argb: np.ndarray, width: int, height: int, tile: int, elements: np.ndarray) -> np.ndarray:
    """Add back what was predicted of red and blue from green, and of blue from red."""
    green_red, green_blue, red_blue, _ = _channels(_spread(elements, width, height, tile)).view(np.int8).T.astype(np.int16)
    out = _channels(argb).copy()
    green = out[:, 1].copy().view(np.int8).astype(np.int16)
    out[:, 2] += (green_red * green >> 5).astype(np.uint8)
    red = out[:, 2].copy().view(np.int8).astype(np.int16)
    out[:, 0] += ((green_blue * green >> 5) + (red_blue * red >> 5)).astype(np.uint8)
    return _values(out)


def add_green(argb: np.ndarray) -> np.ndarray:
    """Red and blue were stored less green."""
    out = _channels(argb).copy()
    out[:, 0] += out[:, 1]
    out[:, 2] += out[:, 1]
    return _values(out)


def unpalette(argb: np.ndarray, width: int, height: int, packing: int, colours: np.ndarray) -> np.ndarray:
    """Indices (several to a pixel's green sample for small palettes) to colours; unknown ones to transparent black."""
    packed = _channels(argb)[:, 1].astype(np.int64).reshape(height, -1)
    n = 8 >> packing
    index = packed[:, np.arange(width) >> packing] >> n * (np.arange(width) & (1 << packing) - 1) & (1 << n) - 1
    table = np.zeros(256, dtype="<u4")
    table[: len(colours)] = colours
    return table[index].reshape(-1)


def decode(data: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file: height x width x (R, G, B, A), bytes."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # alpha hint
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICT, CROSS):
            tile = bits.read(3) + 2
            extra = read_image(bits, (now + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False)
            undo.append((kind, now, tile, extra))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _channels(read_image(bits, n, 1, False))
            colours = _values(np.cumsum(steps, axis=0, dtype=np.uint8))
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, now, packing, colours))
            now = (now + (1 << packing) - 1) >> packing
        else:
            undo.append((kind, now, 0, None))
    argb = read_image(bits, now, height, True)
    for kind, wide, size, extra in reversed(undo):
        if kind == PREDICT:
            argb = unpredict(argb, wide, height, size, (extra >> 8 & 15).tolist())
        elif kind == CROSS:
            argb = uncross(argb, wide, height, size, extra)
        elif kind == PALETTE:
            argb = unpalette(argb, wide, height, size, extra)
        else:
            argb = add_green(argb)
    return _channels(argb).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]


# ---------------------------------------------------------------- encoding


class Writer:
    """A bit stream under construction, least significant bit first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def array(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes(self.n // 8 + 1, "little"), dtype=np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits for the symbols that occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    weights, floor = counts[used].tolist(), 1
    while True:
        heap = [(max(w, floor), i, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, node = [0] * (2 * len(weights)), len(weights)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[2]] = parent[b[2]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node, node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(weights)]) <= most:
            lengths[used] = depth[: len(weights)]
            return lengths
        floor = floor * 2 if floor > 1 else max(2, sum(weights) >> most)


#: A complete code for the nineteen code length symbols: thirteen of 4 bits, six of 5 (our choice).
_META_LENGTHS = np.array([4] * 13 + [5] * 6, dtype=np.int64)
_META = [(int(c), int(n)) for c, n in zip(canonical(_META_LENGTHS), _META_LENGTHS, strict=True)]


def write_code(out: Writer, lengths: np.ndarray) -> None:
    """The description of a prefix code."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        s = int(used[0])
        out.put(1, 1)
        out.put(0, 1)
        out.put(int(s > 1), 1)
        out.put(s, 8 if s > 1 else 1)
        return
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(int(_META_LENGTHS[s]), 3)
    out.put(0, 1)
    at, values = 0, lengths.tolist()
    while at < len(values):
        n = 0
        while not values[at] and at + n < len(values) and n < 138 and not values[at + n]:
            n += 1
        if n >= 11:
            out.put(*_META[18])
            out.put(n - 11, 7)
        elif n >= 3:
            out.put(*_META[17])
            out.put(n - 3, 3)
        else:
            out.put(*_META[values[at]])
            n = 1
        at += n


def _file(bits: np.ndarray) -> bytes:
    chunk = np.packbits(bits, bitorder="little").tobytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_grey(samples: np.ndarray, width: int = ROW) -> bytes:
    """One file of grey pixels; ``samples`` fills its rows exactly."""
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(len(samples) // width - 1, 14)
    out.put(0, 4)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    return _file(_literal_image(out, samples))


def _literal_image(out: Writer, samples: np.ndarray) -> np.ndarray:
    """The bits so far and those of a last image of green samples, as literals by array operations."""
    out.put(0, 3)  # no further transform, no colour cache, one group of codes
    lengths = np.zeros(280, dtype=np.int64)
    lengths[:256] = code_lengths(np.bincount(samples, minlength=256), 12)  # short tables decode faster
    write_code(out, lengths)
    for symbol in (0, 0, 255, 0):
        one = np.zeros(256, dtype=np.int64)
        one[symbol] = 1
        write_code(out, one)
    head = out.array()
    if (lengths > 0).sum() == 1:
        return head
    size = lengths[samples]
    start = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    body = np.repeat(canonical(lengths)[samples].astype(np.uint16), size) >> place.astype(np.uint16) & np.uint16(1)
    return np.concatenate([head, body.astype(np.uint8)])


#: Pixels of an image for which several ways of writing are tried, and how well a larger one must compress for back-references to be.
SMALL, REPETITIVE = 4 * ROW, 12
_CODES = {(max(1, x + y * ROW)): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    return 2 * (n + 1) + ((value - 1) >> n & 1), (value - 1) & (1 << n) - 1, n


def copies(data: bytes, least: int = 4) -> Iterator[tuple[int, int, int]]:
    """(position, length, distance) of repeats, greedily, from a table of the last place of every four bytes."""
    seen: dict[bytes, int] = {}
    at, n = 0, len(data)
    while at + least <= n:
        key = data[at : at + least]
        from_ = seen.get(key)
        seen[key] = at
        if from_ is None:
            at += 1
            continue
        size, step = least, 256
        while step:  # as far as both agree, in ever smaller steps
            if at + size + step <= n and size + step <= 4096 and data[at + size : at + size + step] == data[from_ + size : from_ + size + step]:
                size += step
            else:
                step >>= 1
        yield at, size, at - from_
        for k in range(at + 1, min(at + size, n - least), 1 if size < 32 else 8):
            seen[data[k : k + least]] = k
        at += size


def _tokens(samples: np.ndarray, cache_bits: int, references: bool, near: dict[int, int] = _CODES) -> list[tuple[int, ...]]:
    """(sample), (cache index, -1) or (length, distance code, 0) in order."""
    data, out, at = samples.tobytes(), [], 0
    cache: dict[int, int] = {}

    def literals(to: int) -> None:
        nonlocal at
        for g in data[at:to]:
            if cache_bits:
                k = ((0xFF000000 | g * 0x10101) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
                if cache.get(k) == g:
                    out.append((k, -1))
                    continue
                cache[k] = g
            out.append((g,))
        at = to

    for place, size, distance in copies(data) if references else ():
        literals(place)
        if cache_bits:  # copied colours enter the cache too
            for g in data[place : place + size]:
                cache[((0xFF000000 | g * 0x10101) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = g
        out.append((size, near.get(distance, distance + 120), 0))
        at = place + size
    literals(len(data))
    return out


def _put_image(out: Writer, tokens: list[tuple[int, ...]], main: bool, cache_bits: int = 0, colours: list[tuple[int, int, int, int]] | None = None, fixed: tuple[int, int, int] = (0, 0, 255)) -> None:
    """An entropy-coded image: ``colours`` gives (green, red, blue, alpha) of sample i; without it a sample is green and the rest ``fixed``."""
    counts = [np.zeros(n, dtype=np.int64) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    of = (lambda g: (g, *fixed)) if colours is None else colours.__getitem__
    for t in tokens:
        if len(t) == 1:
            for c, v in zip(counts, of(t[0])):
                c[v] += 1
        elif len(t) == 2:
            counts[0][280 + t[0]] += 1
        else:
            counts[0][256 + _prefix(t[0])[0]] += 1
            counts[4][_prefix(t[1])[0]] += 1
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    ways = []
    for c in counts:
        if not c.any():
            c[0] = 1
        lengths = code_lengths(c)
        write_code(out, lengths)
        single = (lengths > 0).sum() == 1
        ways.append(([0] * len(lengths), [0] * len(lengths)) if single else (canonical(lengths).tolist(), lengths.tolist()))
    put = lambda i, v: out.put(ways[i][0][v], ways[i][1][v])
    for t in tokens:
        if len(t) == 1:
            for i, v in enumerate(of(t[0])):
                put(i, v)
        elif len(t) == 2:
            put(0, 280 + t[0])
        else:
            for i, base, value in ((0, 256, t[0]), (4, 0, t[1])):
                symbol, extra, n = _prefix(value)
                put(i, base + symbol)
                out.put(extra, n)


def _begun(samples: np.ndarray) -> Writer:
    out = Writer()
    out.put(0x2F, 8)
    out.put(ROW - 1, 14)
    out.put(len(samples) // ROW - 1, 14)
    out.put(0, 4)
    return out


def encode_references(samples: np.ndarray) -> bytes:
    """Back-references over the green samples."""
    out = _begun(samples)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(0, 1)
    _put_image(out, _tokens(samples, 0, True), True)
    return _file(out.array())


def encode_cached(samples: np.ndarray, cache_bits: int = 7) -> bytes:
    """No transform: a colour is written once and then taken from the cache."""
    out = _begun(samples)
    out.put(0, 1)
    _put_image(out, _tokens(samples, cache_bits, True), True, cache_bits, [(g, g, g, 255) for g in range(256)])
    return _file(out.array())


def encode_palette(samples: np.ndarray) -> bytes:
    """Up to sixteen samples as indices, two to eight of them in a pixel."""
    colours, index = np.unique(samples, return_inverse=True)
    n = len(colours)
    packing = 3 if n <= 2 else 2 if n <= 4 else 1
    bits, each = 8 >> packing, 1 << packing
    rows = index.reshape(-1, ROW // each, each)
    packed = (rows << np.arange(each) * bits).sum(axis=2).astype(np.uint8).reshape(-1)
    out = _begun(samples)
    out.put(1 | PALETTE << 1, 3)
    out.put(n - 1, 8)
    steps = np.diff(colours.astype(np.int64), prepend=0) & 255
    _put_image(out, [(i,) for i in range(n)], False, 0, [(int(d), int(d), int(d), 0 if i else 255) for i, d in enumerate(steps)])
    if len(samples) > SMALL:
        return _file(_literal_image(out, packed))
    out.put(0, 1)
    _put_image(out, _tokens(packed, 0, True, {}), True)  # rows are shorter: no near distances
    return _file(out.array())


def _residual(samples: np.ndarray, mode: int) -> np.ndarray:
    """What is left of the samples after prediction from the left, top, top right or top left (modes 1 to 4)."""
    i = np.arange(len(samples))
    back = np.where(i < ROW, 1, np.where(i % ROW == 0, ROW, (1, ROW, ROW - 1, ROW + 1)[mode - 1]))
    guess = np.where(i == 0, 0, samples[np.maximum(i - back, 0)])
    return (samples.astype(np.int16) - guess & 255).astype(np.uint8)


def encode_predicted(samples: np.ndarray) -> bytes:
    """Differences from the neighbour that leaves the fewest kinds of difference, over one tile."""
    mode = min(range(1, 5), key=lambda m: (_entropy(_residual(samples, m)), m))
    out = _begun(samples)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(1 | PREDICT << 1, 3)
    out.put(7, 3)
    tiles = (ROW + 511 >> 9) * ((len(samples) // ROW) + 511 >> 9)
    _put_image(out, [(mode,)] * tiles, False)
    out.put(0, 1)
    _put_image(out, _tokens(_residual(samples, mode), 0, True), True, fixed=(0, 0, 0))
    return _file(out.array())


def _entropy(samples: np.ndarray) -> float:
    p = np.bincount(samples)
    p = p[p > 0] / len(samples)
    return float(-(p * np.log2(p)).sum())


def encode_best(samples: np.ndarray) -> bytes:
    """The shortest way of writing that is worth trying; plain literals if none is shorter."""
    ways = [encode_grey(samples)]
    if len(samples) <= SMALL:
        ways.append(encode_references(samples))
        if len(samples) == ROW:
            ways.append(encode_cached(samples))
        if min(_entropy(_residual(samples, m)) for m in range(1, 5)) < 0.8 * _entropy(samples):
            ways.append(encode_predicted(samples))
    elif len(zlib.compress(samples.tobytes(), 1)) * REPETITIVE <= len(samples):
        ways.append(encode_references(samples))
    if np.count_nonzero(np.bincount(samples)) <= 16:
        ways.append(encode_palette(samples))
    return min(ways, key=len)


def payload_of(text: bytes) -> bytes:
    """The bytes followed by spaces up to a positive multiple of the row."""
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def store(payload: bytes) -> bytes:
    """A payload as one or more files in a row."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(encode_best(samples[at : at + ROW * MOST_ROWS]) for at in range(0, len(samples), ROW * MOST_ROWS))


def files(media: bytes) -> Iterator[bytes]:
    """The files in a stored form."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield media[at : at + size]
        at += size


def grey_pixels(media: bytes) -> np.ndarray:
    """The grey samples (rows x width) of a stored form; an image with colour or transparency raises an error."""
    parts = []
    for one in files(media):
        pixels = decode(one)
        grey = pixels[:, :, 1]
        if (pixels[:, :, 0] != grey).any() or (pixels[:, :, 2] != grey).any() or (pixels[:, :, 3] != 255).any():
            raise ValueError("not a grey image")
        parts.append(grey)
    return np.concatenate(parts)


def features(pixels: np.ndarray) -> str:
    """width x height, sum of samples, sum of horizontal steps, number of different samples."""
    steps = np.abs(np.diff(pixels.astype(np.int16), axis=1)).sum(dtype=np.int64)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{pixels.sum(dtype=np.int64)}:{steps}:{np.count_nonzero(np.bincount(pixels.reshape(-1), minlength=256))}"


# ---------------------------------------------------------------- columns


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each text's UTF-8 bytes, padded, as lossless WebP.

    A null text counts as empty and is stored as one row of spaces.  Equal
    texts get equal media; rows are mapped one by one, so repeats and ties
    change nothing; an empty table stays empty; extra columns are dropped.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts = [t.as_py() or b"" for t in part.column(1)]
                media = pa.array([store(payload_of(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), media], names=["doc", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, n_bytes long, media binary").withColumnRenamed("doc", id_col)


def decode_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows (id, n_bytes, media, width, height, pixels, feature): grey pixel arrays (row by row) read back from the media.

    Null media give null pixels; damaged or coloured media raise an error.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["doc", "n_bytes", "media", "width", "height", "pixels", "feature"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = [None if m is None else grey_pixels(m) for m in part.column(2).to_pylist()]
                columns = [
                    pa.array([None if p is None else p.shape[1] for p in found], pa.int32()), pa.array([None if p is None else p.shape[0] for p in found], pa.int32()),
                    pa.array([None if p is None else p.tobytes() for p in found], pa.binary()), pa.array([None if p is None else features(p) for p in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=names)

    rows = media.select(F.col(id_col).alias("doc"), "n_bytes", F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"doc {kind}, n_bytes long, media binary, width int, height int, pixels binary, feature string").withColumnRenamed("doc", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and digests of decoded media."""
    return decoded.select(
        id_col, "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )

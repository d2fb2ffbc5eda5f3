import random

import numpy as np
import pytest
from brute import sha

from shoalwater.llm import webp_lossless as webp


def pack(width, height, put_body):
    """A file around a hand-written stream."""
    out = webp.Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    put_body(out)
    return webp._file(out.array())


def prefix(value):
    """Prefix symbol, extra bits and their number, of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & (1 << n) - 1, n


def put_image(out, argb, width, main, cache_bits=0, backward=False, groups=None):
    """An entropy-coded image with optional colour cache, back-references and an entropy image of two groups."""
    tokens, i, cache = [], 0, {}
    hashed = lambda p: (p * webp.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
    done = 0
    while i < len(argb):
        while cache_bits and done < i:
            cache[hashed(argb[done])] = argb[done]
            done += 1
        best = 0
        if backward:
            for d in range(1, i + 1):
                n = 0
                while i + n < len(argb) and argb[i + n] == argb[i + n - d] and n < 4000:
                    n += 1
                if n > best:
                    best, dist = n, d
        if best >= 3:
            code = next((k + 1 for k, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == dist), dist + 120)
            tokens.append((i, "copy", best, code))
            i += best
        elif cache_bits and cache.get(hashed(argb[i]), 0) == argb[i]:
            tokens.append((i, "cache", hashed(argb[i]), 0))
            i += 1
        else:
            tokens.append((i, "lit", argb[i], 0))
            i += 1
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    choose = lambda i: 0
    n_groups = 1
    if main:
        out.put(1 if groups else 0, 1)
        if groups:
            n_groups, tile = 2, 2
            out.put(tile - 2, 3)
            tiles, rows = (width + 3) >> 2, (len(argb) // width + 3) >> 2
            pick = [(k % 2) << 8 | 0xFF000000 for k in range(tiles * rows)]
            put_image(out, pick, tiles, False)
            choose = lambda i: pick[(i // width >> 2) * tiles + (i % width >> 2)] >> 8 & 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, dtype=np.int64) for n in sizes] for _ in range(n_groups)]
    for i, kind, a, b in tokens:
        c = counts[choose(i)]
        if kind == "lit":
            for k, s in ((0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)):
                c[k][s] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + prefix(a)[0]] += 1
            c[4][prefix(b)[0]] += 1
    codes = []
    for c in counts:
        own = []
        for k in c:
            if not k.any():
                k[0] = 1
            lengths = webp.code_lengths(k)
            webp.write_code(out, lengths)
            own.append((lengths, webp.canonical(lengths), (lengths > 0).sum() == 1))
        codes.append(own)

    def emit(code, s):
        lengths, bits, only = code
        if not only:
            out.put(int(bits[s]), int(lengths[s]))

    for i, kind, a, b in tokens:
        own = codes[choose(i)]
        if kind == "lit":
            for k, s in ((0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)):
                emit(own[k], s)
        elif kind == "cache":
            emit(own[0], 280 + a)
        else:
            s, extra, n = prefix(a)
            emit(own[0], 256 + s)
            out.put(extra, n)
            s, extra, n = prefix(b)
            emit(own[4], s)
            out.put(extra, n)


def rgba(argb, width):
    a = np.array(argb, dtype="<u4")
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255, a >> 24], axis=1).astype(np.uint8).reshape(-1, width, 4)


def image(seed, n, colours=None):
    rng = random.Random(seed)
    table = [rng.getrandbits(32) for _ in range(colours)] if colours else None
    out = []
    while len(out) < n:
        out += out[-7:] * 3 if out and rng.random() < 0.2 else [rng.choice(table) if table else rng.getrandbits(32)]
    return out[:n]


@pytest.mark.parametrize("cache_bits,backward,groups", [(0, False, None), (4, False, None), (0, True, None), (6, True, None), (5, True, True), (0, False, True)])
def test_entropy_coding(cache_bits, backward, groups):
    width, height = 13, 11
    argb = image(cache_bits + 10 * backward, width * height, 40)

    def body(out):
        out.put(0, 1)
        put_image(out, argb, width, True, cache_bits, backward, groups)

    assert (webp.decode(pack(width, height, body)) == rgba(argb, width)).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    """Differences to a straightforward prediction decode to the image."""
    width, height = 9, 7
    argb = image(mode, width * height)
    px = [tuple(p >> s & 255 for s in (24, 16, 8, 0)) for p in argb]
    avg = lambda a, b: tuple((x + y) // 2 for x, y in zip(a, b))
    clip = lambda v: max(0, min(255, v))

    def guess(i):
        x, y = i % width, i // width
        if not i:
            return (255, 0, 0, 0)
        if not y:
            return px[i - 1]
        if not x:
            return px[i - width]
        left, top, right, corner = px[i - 1], px[i - width], px[i - width + 1], px[i - width - 1]
        if mode == 11:
            est = [left[k] + top[k] - corner[k] for k in range(4)]
            return left if sum(abs(e - a) for e, a in zip(est, left)) < sum(abs(e - a) for e, a in zip(est, top)) else top
        if mode == 12:
            return tuple(clip(left[k] + top[k] - corner[k]) for k in range(4))
        if mode == 13:
            half = avg(left, top)
            return tuple(clip(half[k] + int((half[k] - corner[k]) / 2)) for k in range(4))
        return [(255, 0, 0, 0), left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right))][mode]

    rest = [sum(((a - b) & 255) << s for a, b, s in zip(px[i], guess(i), (24, 16, 8, 0))) for i in range(len(px))]

    def body(out):
        out.put(1 | webp.PREDICT << 1, 3)
        out.put(0, 3)
        put_image(out, [0xFF000000 | mode << 8] * (3 * 2), 3, False)
        out.put(0, 1)
        put_image(out, rest, width, True)

    assert (webp.decode(pack(width, height, body)) == rgba(argb, width)).all()


def test_colour_transforms():
    width, height = 9, 7
    argb = image(3, width * height)
    signed = lambda v: (v & 255 ^ 128) - 128
    gr, gb, rb = 37, 200, 91

    def forward(p):
        a, r, g, b = (p >> s & 255 for s in (24, 16, 8, 0))
        b2 = (b - (signed(gb) * signed(g) >> 5) - (signed(rb) * signed(r) >> 5)) & 255
        r2 = (r - (signed(gr) * signed(g) >> 5)) & 255
        return a << 24 | ((r2 - g) & 255) << 16 | g << 8 | ((b2 - g) & 255)

    def body(out):
        out.put(1 | webp.CROSS << 1, 3)
        out.put(0, 3)
        put_image(out, [0xFF000000 | rb << 16 | gb << 8 | gr] * 6, 3, False)
        out.put(1 | webp.SUBTRACT_GREEN << 1, 3)
        out.put(0, 1)
        put_image(out, [forward(p) for p in argb], width, True)

    assert (webp.decode(pack(width, height, body)) == rgba(argb, width)).all()


@pytest.mark.parametrize("colours,bits", [(2, 1), (3, 2), (13, 4), (40, 8)])
def test_palette(colours, bits):
    width, height = 11, 5
    argb = image(colours, width * height, colours)
    table = sorted(set(argb))
    steps, before = [], 0
    for c in table:
        steps.append(sum((((c >> s & 255) - (before >> s & 255)) & 255) << s for s in (24, 16, 8, 0)))
        before = c
    used = {2: 1, 4: 2, 16: 4}.get(next((k for k in (2, 4, 16) if len(table) <= k), 0), 8)
    per = 8 // used
    index = [table.index(p) for p in argb]
    packed = [0xFF000000 | sum(v << used * k for k, v in enumerate(index[y * width + x : min(y * width + x + per, (y + 1) * width)])) << 8 for y in range(height) for x in range(0, width, per)]

    def body(out):
        out.put(1 | webp.PALETTE << 1, 3)
        out.put(len(table) - 1, 8)
        put_image(out, steps, len(table), False)
        out.put(0, 1)
        put_image(out, packed, -(-width // per), True)

    assert (webp.decode(pack(width, height, body)) == rgba(argb, width)).all()


def test_payloads():
    rng = random.Random(1)
    for data in (b"", b"a", b" " * 500, bytes(rng.randrange(256) for _ in range(5000)), b"ab" * 400_000, b"x" * (webp.ROW * webp.MOST_ROWS + 5)):
        payload = webp.payload_of(data)
        media = webp.store(payload)
        assert payload.startswith(data) and len(payload) % 192 == 0 and webp.grey_pixels(media).tobytes() == payload
    assert len(list(webp.files(media))) == 2


def test_skewed_counts_stay_within_limits():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946], dtype=np.int64)
    for most in (12, 15):
        lengths = webp.code_lengths(counts, most)
        assert lengths.max() <= most and (2.0 ** -lengths).sum() == 1


def test_damage():
    media = webp.store(webp.payload_of(b"some text " * 50))
    with pytest.raises(ValueError):
        webp.decode(media[:60] + media[90:120])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF")


def test_columns(spark):
    import zlib

    rows = [(1, None), (2, ""), (3, "é" * 300), (3, "é" * 300), (None, "plain")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, media string")
    got = webp.digests(webp.decode_column(webp.encode_column(docs))).collect()
    assert len(got) == 5
    for r in got:
        payload = webp.payload_of((dict(rows)[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), sha(payload), zlib.crc32(payload[-16:]))
    assert webp.encode_column(docs.limit(0)).count() == 0


def test_every_way_of_writing():
    """All encoders against the decoder, and which of them is kept where."""
    rng = random.Random(8)
    texts = [b"", b"a", b"ab" * 300, b"x" * 10_000, bytes(rng.randrange(256) for _ in range(700)), b"0101100111" * 60, ("é die und " * 70).encode(), b"a line that repeats\n" * 900, bytes(range(256)) * 3]
    texts += [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    for t in texts:
        payload = webp.payload_of(t)
        samples = np.frombuffer(payload, dtype=np.uint8)
        few = len(np.unique(samples)) <= 16
        ways = {f.__name__: f(samples) for f in (webp.encode_grey, webp.encode_references, webp.encode_cached, webp.encode_predicted, *([webp.encode_palette] if few else []))}
        assert all(webp.grey_pixels(m).tobytes() == payload for m in ways.values())
        assert webp.store(payload) == webp.encode_best(samples) and len(webp.encode_best(samples)) <= len(ways["encode_grey"])
    assert len(webp.store(webp.payload_of(b"a line that repeats\n" * 900))) < 300
    slope = bytes(i * 7 % 256 for i in range(192))  # every sample differs from the one before by the same
    assert webp.encode_best(np.frombuffer(slope, dtype=np.uint8)) != webp.encode_grey(np.frombuffer(slope, dtype=np.uint8))
    rare = np.frombuffer(bytes(98 if rng.random() < 0.05 else 97 for _ in range(192 * 100)), dtype=np.uint8)
    assert webp.encode_best(rare) == webp.encode_palette(rare) and webp.grey_pixels(webp.encode_palette(rare)).tobytes() == rare.tobytes()

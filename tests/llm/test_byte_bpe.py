import random

import pytest
import public_tokenizers as P
import tiktoken
from brute import sha

from shoalwater.llm import byte_bpe as bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x2028, 0x323B5, 0x16EA7]))
    made = ["".join(pick() for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    return ["", " ", "<|endoftext|>", "the the  the\n\n the", "a" * 50_000, "ab" * 30_000, "I'll we've", *made]


def test_perfect_hash(ranks):
    table = bpe.PerfectHash(ranks)
    assert table.n == len(ranks) and all(table.get(k) == v for k, v in ranks.items())
    assert all(table.get(k + b"\x00\x01zz") is None for k in ranks)
    assert bpe.PerfectHash({}).get(b"a") is None


def test_encoder(ranks, reference):
    encode = bpe.Encoder(ranks, bpe.PerfectHash(ranks), bpe.joins(ranks), P.PATTERN, remember=50)
    for t in texts():
        assert encode(t) == reference.encode_ordinary(t)


def test_splitter_by_ranges(ranks):
    """The faster engine splits every character, alone and between others, as the pattern's own does."""
    encode = bpe.Encoder(ranks, bpe.PerfectHash({}), {}, P.PATTERN)
    assert encode.narrow and encode.plane
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    made = [f"{a} {c}{c}a{c}1 {c}\n{c}{b} '{c} 's{c}" for a, b, c in zip(chars[7:], chars[3:], chars)] + texts()
    own = lambda t: [t[m.start() : m.end()] for m in encode.pattern.finditer(encode.later.sub(bpe._OTHER, t))]
    assert all(encode.split(t) == own(t) for t in made)
    assert bpe.spelled(r"\p{Lu}+", 0x80) is None and bpe.spelled(r"(?i)a", 0x80) is None and bpe.spelled(r"[a[b]]", 0x80) is None


def test_invented_words_are_remembered(ranks):
    """A text of more words than the vocabulary has: the second time none is merged anew, also where the memory is small."""
    merged = []
    encode = bpe.Encoder(ranks, bpe.PerfectHash(ranks), bpe.joins(ranks), P.PATTERN, bpe.REMEMBER_MORE)
    get = encode.table.get
    encode.table.get = lambda data: merged.append(data) or get(data)
    text = " ".join(f"{bpe.base64.b32encode(str(i * 7919).encode()).decode().rstrip('=').lower()}" for i in range(150_000))
    first, n = encode(text), len(merged)
    assert encode(text) == first and len(merged) == n
    small = bpe.Encoder(ranks, bpe.PerfectHash(ranks), bpe.joins(ranks), P.PATTERN, remember=1000)
    assert small(text) == first and len(small.recent) + len(small.older) <= 2000


def test_round_trip(spark, reference):
    rows = [(None, None), *enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    tokenizer = bpe.Tokenizer(spark, PATH, P.PATTERN)
    got = sorted(map(tuple, bpe.digests(tokenizer.decode(tokenizer.encode(docs))).collect()), key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, tokenizer.round_trip(docs, keep_ids=False).collect()), key=str) == got
    assert {r.doc_id: len(r.ids) for r in tokenizer.round_trip(docs).collect()} == {w[0]: w[1] for w in want}
    assert tokenizer.encode(docs.limit(0)).count() == 0 and tokenizer.round_trip(docs.limit(0)).count() == 0

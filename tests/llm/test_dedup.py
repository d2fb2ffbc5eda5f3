import random

from brute import components, sha, simhash

from shoalwater.llm import exact_dedup, simhash as near
from shoalwater.scratch import Scratch
from shoalwater.llm.components import components as spark_components

SCHEMA = "doc_id long, text string, name string, block string"


def texts():
    rng = random.Random(3)
    base = ["", None, " \t\n", "abc", "a b c", "a bc", "é" * 40, "é" * 40 + " ", "x" * 700, "x" * 701, "x" * 350 + " " + "x" * 350]
    base += ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    return base + base[:40]


def check(rows, got):
    import re

    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    groups = {}
    for i, t, n in norm:
        groups.setdefault(n, []).append((-len(t), i))
    want = sorted((i, min(groups[n])[1], len(groups[n]), min(groups[n])[1] == i, sha(n)) for i, t, n in norm)
    assert sorted(tuple(r) for r in got) == want


def test_exact(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "n", "b") for i, t in rows], SCHEMA).repartition(3)
    check(rows, exact_dedup.exact_duplicates(docs, block_bytes=16).collect())
    check(rows, exact_dedup.exact_duplicates(docs).collect())
    check(rows, exact_dedup.exact_duplicates(docs, block_bytes=8, digest_bits=3).collect())  # digests collide
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (2, "ab", "", "")], SCHEMA)
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_duplicates(docs).collect()) == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    links = set(pairs) | {(b, a) for a, b in pairs}
    root = components({x for p in pairs if p[0] != p[1] for x in p}, lambda a, b: (a, b) in links)
    got = spark_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()
    assert dict((r.node, r.root) for r in got) == root and len(got) == len(root)


def test_simhash(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "A b"), (3, "a B c"), (4, "É b c d")]
    for g in range(12):
        t = [rng.choice(words) for _ in range(120)]
        for _ in range(6):
            u = t[:]
            for _ in range(rng.randrange(0, 3)):
                u[rng.randrange(len(u))] = rng.choice(words)
            rows.append((len(rows), " ".join(u)))
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(3)
    fp = {i: simhash(t) for i, t in rows}
    root = components(fp, lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    for most in (4096, 4):
        got = near.near_duplicates(docs, most=most).collect()
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{fp[i]:016x}", root[i]) for i in fp)
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(63)
    prints = {centre}
    for _ in range(300):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(63)
        prints.add(x)
    root = components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for most in (4096, 6):
        work = Scratch(spark, "test")
        links = near.fingerprint_links(df, work, most=most)
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in links.collect())
        got = {r.node: r.root for r in spark_components(links, work).collect()}
        assert {p: got.get(p, p) for p in prints} == root


def test_names_follow_the_contents(spark):
    """Names are distinct and in the order of the blocks inside each partition, and long texts go through many levels."""
    from pyspark.sql import functions as F

    from shoalwater.llm.exact_dedup import _numbered, exact_duplicates

    rows = [(r.name, r.b) for r in _numbered(spark.range(500).select(F.md5(F.col("id").cast("string")).alias("b")).repartition(4, "b"), ["b"]).collect()]
    assert len({n for n, _ in rows}) == 500
    for part in range(4):
        own = [b for n, b in sorted(rows) if n >> 33 == part]
        assert own == sorted(own)
    long = "abcdefgh" * 2000
    rows = [(1, long, "x"), (2, long[:8000] + " \n" + long[8000:], "x"), (3, long[:-1], "x"), (None, long, "x"), (None, None, "x"), (4, "", "x")]
    got = {(r.doc_id, r.group_size, r.keep_id, r.kept) for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, name string"), block_bytes=16).collect()}
    assert got == {(1, 3, 2, False), (2, 3, 2, True), (3, 1, 3, True), (None, 3, 2, False), (None, 2, None, True), (4, 2, None, False)}

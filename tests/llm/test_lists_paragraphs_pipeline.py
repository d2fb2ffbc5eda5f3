import random
from datetime import date, timedelta

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from brute import components, sha

from shoalwater.llm import byte_bpe, paragraph_dedup as para
from shoalwater.llm import simhash, url_lists


def test_lists_as_of(spark):
    rng = random.Random(2)
    start = date(2024, 1, 1)
    keys = ["host:a.example.com", "domain:example.com", "domain:com", "path:a.example.com/x", "host:b.org"]
    events = [("l%d" % (i % 3), "allow" if i % 3 == 2 else "block", rng.choice(keys), start + timedelta(rng.randrange(200)), rng.choice(["add", "add", "remove"])) for i in range(60)] + [("l0", "block", None, start, "add")]
    captures = [(i, rng.choice(["http://a.example.com/x/y", "https://u@A.Example.com:80", "http://b.org/", "http://c.net/q", "no url", None]), start + timedelta(rng.randrange(250)) if i % 17 else None) for i in range(300)]
    ev = spark.createDataFrame(events, "list string, verdict string, key string, day date, action string")
    cap = spark.createDataFrame([(*c, "s") for c in captures], "page_id long, url string, fetched date, status string")

    def active(name, verdict, key, day):
        state = False
        for d in sorted({e[3] for e in events if e[:3] == (name, verdict, key)}):
            if d > day:
                break
            state = not any(e[:4] == (name, verdict, key, d) and e[4] == "remove" for e in events)
        return state

    wants = {"http://a.example.com/x/y": ("a.example.com", {"host:a.example.com", "domain:a.example.com", "domain:example.com", "domain:com", "path:a.example.com/x"}), "https://u@A.Example.com:80": ("a.example.com", {"host:a.example.com", "domain:a.example.com", "domain:example.com", "domain:com"}), "http://b.org/": ("b.org", {"host:b.org", "domain:b.org", "domain:org"}), "http://c.net/q": ("c.net", set())}
    for most in (200_000, 0):
        got = {r.page_id: r for r in url_lists.judge_captures(cap, ev, broadcast_rows=most).collect()}
        assert len(got) == 300
        for i, url, day in captures:
            host, asks = wants.get(url, (None, set()))
            entries = {(n, v, k) for n, v, k, _, _ in events if k in asks and day and active(n, v, k, day)}
            want = "unparsed" if host is None else "undated" if day is None else "clear" if not entries else "allowed" if any(v == "allow" for _, v, _ in entries) else "blocked"
            assert (got[i].status, got[i].n_active, got[i].lists) == (want, len(entries), ",".join(sorted({n for n, _, _ in entries}))), (i, url, day)
    assert {r.status for r in url_lists.judge_captures(cap, ev.limit(0)).collect()} == {"clear", "unparsed", "undated"}
    assert url_lists.judge_captures(cap.limit(0), ev).count() == 0


def test_hosts(spark):
    urls = {"http://[::1]:80/x": "[::1]", "https://u:p@[2001:DB8::7]/": "[2001:db8::7]", "HTTP://A.b./": "a.b", "http:///x": None, "a.b": None, None: None, "ftp://x:1": "x", "http://[::1": None}
    got = {r.u: r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_lists.host_of(url_lists.F.col("u")).alias("h")).collect()}
    assert got == urls


def test_bands():
    bands, rows = para.tune_bands(0.8)
    assert bands * rows <= 64 and 1 - (1 - 0.8**rows) ** bands >= 0.999 and rows >= 3


def passages():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(15)]
    docs = [(0, None), (1, ""), (2, "short line\nshort line")]
    for i in range(70):
        lines = []
        for _ in range(3):
            p = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(words) for _ in range(40)]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed" + str(i)
            lines.append(" ".join(p) if rng.random() < 0.8 else " ".join(p).upper())
        docs.append((10 + i, "é\n" + "\n".join(lines)))
    return docs


def test_paragraphs(spark):
    docs = passages()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, no int, digest string").repartition(3)
    units = {}
    for i, t in docs:
        for no, a, b, n, norm in para.paragraphs(t or "", 20):
            assert t[a:b].lower().split() == norm.decode().split() and len(norm.split()) == n
            units[i, no] = norm.decode().split()
    sets = {u: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for u, w in units.items()}
    root = components(units, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    size = {r: sum(x == r for x in root.values()) for r in set(root.values())}
    want = {u: (root[u], size[root[u]], u != root[u]) for u in units if size[root[u]] > 1}
    for most in (2048, 4):
        got = {(r.doc_id, r.para_no): ((r.keep_doc_id, r.keep_para_no), r.cluster_size, r.removed) for r in para.repeated_paragraphs(df, most=most).collect()}
        assert got == want
    assert para.repeated_paragraphs(df.limit(0)).count() == 0


def test_passages_inside_lines(spark):
    rng = random.Random(8)
    word = lambda: "v%d" % rng.randrange(100_000)
    passage = [[word() for _ in range(n)] for n in (50, 51, 70)]
    rows, want = [], {}
    for i in range(40):
        own = [word() for _ in range(rng.randrange(0, 120))]
        k = i % 4
        if k < 3:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[k]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(own), "x"))
        want[i] = k < 3
    rows += [(100, None, "x"), (101, "", "x"), (102, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = para.repeats(df).where("kind = 'passage'").collect()
    texts = {i: t for i, t, _ in rows}
    assert {r.doc_id for r in got} == {i for i, w in want.items() if w}
    for r in got:
        words = [w for w in texts[r.doc_id][r.start : r.end].split()]
        assert 25 <= len(words) <= 70 and words[0] in passage[r.doc_id % 4] and words[-1] in passage[r.doc_id % 4] and r.keep_doc_id % 4 == r.doc_id % 4
    assert para.repeats(df.limit(0)).count() == 0


def test_passages_are_whole(spark):
    """Passages in random contexts come out from their first word to their last."""
    rng = random.Random(12)
    word = lambda: "v%d" % rng.randrange(100_000_000)
    passage = [[word() for _ in range(n)] for n in (50, 60, 100, 300)]
    rows, want = [], set()
    for i in range(24):
        k, before, after = i % 4, [word() for _ in range(rng.randrange(60))], [word() for _ in range(rng.randrange(60))]
        head, inside = "é ".join(before + [""]), "  ".join(passage[k])
        rows.append((i, head + inside + "\n" + " ".join(after)))
        want.add((i, len(head), len(head) + len(inside), k, 6, i >= 4))
    period = [word() for _ in range(60)]
    rows += [(50, " ".join(period * 3)), (60, "x y " + " ".join(passage[0])), (60, " ".join(passage[1])), (None, "z " + " ".join(passage[3]))]
    n = len(" ".join(period))
    want |= {(50, 0, n, 50, 3, False), (50, n + 1, 3 * n + 2, 50, 3, True)}
    sizes = [len(" ".join(p)) for p in passage]
    want |= {(60, 4, 4 + sizes[0], 0, 7, True), (60, 0, sizes[1], 1, 7, True), (None, 2, 2 + sizes[3], None, 7, False)}
    # One more copy of three passages; the one with a null id comes first.
    more = {0: 0, 1: 1, 3: None}
    want = {w if w[4] != 6 or w[0] % 4 == 2 else (*w[:3], more[w[0] % 4], 7, w[5] or w[0] == 3) for w in want}
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    got = [tuple(r) for r in para.repeated_passages(df, para.Scratch(spark, "test")).select("doc", "start", "end", "keep_doc", "cluster_size", "removed").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def near_copy(rng, text, n):
    """The text with ``n`` words of its end exchanged."""
    words = text.split()
    for k in range(n):
        words[-1 - k] = f"other{rng.randrange(10**6)}"
    return " ".join(words)


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_similar_groups(spark):
    """Groups against all pairs, with groups beyond a block; recall by similarity."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(50_000)}"
    rows, sets = [], {}
    for g in range(120):
        text = [word() for _ in range(rng.choice([40, 120, 400]))]
        for c in range(rng.choice([1, 2, 2, 3, 40 if g == 7 else 2])):
            own = list(text)
            for _ in range(rng.randrange(0, max(1, len(own) // 50)) if c else 0):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), 0, " ".join(own)))
    rows += [(10_000, 0, None), (10_001, 0, ""), (10_002, 0, " \n "), (10_003, 0, "one two"), (10_004, 0, "One  two")]
    sets = {i: shingle_set(t) for i, _, t in rows}
    df = spark.createDataFrame(rows, "k1 long, k2 long, text string").repartition(4)
    pairs = [(a, b) for a, _, _ in rows for b, _, _ in rows if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for together in (1 << 23, 3000):
        root = {r.k1: r.root for r in simhash.similar_groups(df, simhash.Scratch(spark, "test"), together=together).collect()}
        found = sum(a in root and root[a] == root.get(b) for a, b in pairs)
        assert found >= 0.95 * len(pairs) and len(pairs) > 100
        assert set(root) <= {x for p in pairs for x in p} and root[10_003] == root[10_004]
    assert simhash.similar_groups(df.limit(0), simhash.Scratch(spark, "test")).count() == 0


def test_wide_fingerprints_find_similar_texts():
    """Measured recall of the seven segments, by similarity of the texts."""
    rng = random.Random(15)
    for least, recall in ((0.8, 0.8), (0.85, 0.88), (0.9, 0.95), (0.95, 0.99)):
        hits = n = 0
        while n < 300:
            a = [f"w{rng.randrange(10**5)}" for _ in range(rng.choice([60, 200, 600]))]
            b = list(a)
            while True:
                b[rng.randrange(len(b))] = f"y{rng.randrange(10**6)}"
                x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
                j = len(x & y) / len(x | y)
                if j < least + 0.03:
                    break
            if j < least:
                continue
            words, _ = simhash.wide_fingerprints([" ".join(a).encode(), " ".join(b).encode()], 5)
            d = [int(words[0][i] ^ words[1][i]) for i in (0, 1)]
            parts = [d[0] >> 18 * i & 0x3FFFF for i in range(3)] + [d[1] >> 18 * i & 0x3FFFF for i in range(3)] + [d[0] >> 54 | d[1] >> 54 << 9]
            hits += any(p.bit_count() <= 1 for p in parts) and d[0].bit_count() + d[1].bit_count() <= simhash.FARTHEST
            n += 1
        assert hits >= recall * n, (least, hits / n)


def test_pipeline(spark):
    """Each stage against a plain version, on its own input."""
    rng = random.Random(9)
    words = "the and of with that for they have this from nicht und der die das les des pour dans que".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 80))) for _ in range(150)]
    texts += [texts[3], texts[3] + " ", texts[4].replace(" ", "\n"), None, "", "12 34 !!"] + [near_copy(rng, texts[i], n) for i in range(6, 60) for n in (1, 2)]
    docs = spark.createDataFrame([(i, t, ["en", "de", None][i % 3], f"s{i % 4}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = {r.doc_id: r for r in before.collect()}
        after = corpus_pipeline.Scratch(spark, "test").put(stage(spark, before, ""), name)
        assert after.columns == docs.columns
        rows = after.collect()
        kept = {r.doc_id for r in rows}
        assert all(own[r.doc_id] == r for r in rows)
        if name == "language_id":
            assert kept == {i for i, r in own.items() if r.text and any(map(str.isalpha, r.text))}
        elif name == "exact_dedup":
            groups = {}
            for i, r in own.items():
                groups.setdefault("".join(r.text.split()), []).append((-len(r.text), i))
            assert kept == {min(g)[1] for g in groups.values()}
        elif name == "simhash":
            sets = {i: shingle_set(r.text) for i, r in own.items()}
            alike = lambda a, b: bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            want = set(components(own, alike).values())
            assert want <= kept and len(own) - len(want) >= 40  # nothing goes that is near no other; few copies are missed
            assert len(kept - want) <= 0.1 * (len(own) - len(want))
        else:
            words = {i: len(r.text.split()) for i, r in own.items()}
            copies = {i: sum(r.doc_id == i for r in rows) for i in own}
            decided = {r.doc_id: r for r in corpus_pipeline.source_mix.mix_sources(before).collect()}
            assert copies == {i: r.copies for i, r in decided.items()}
            by = {}
            for i, r in own.items():
                by.setdefault(r.source, []).append(i)
            target = corpus_pipeline.source_mix.mix_targets([(k, sum(words[i] for i in v)) for k, v in by.items()], (3, 1, 2), 1.5, 2.0)
            for k, v in by.items():
                assert abs(sum(words[i] * copies[i] for i in v) - target[k]) <= 2 * max(words[i] for i in v) and max(copies[i] for i in v) <= 2
        before = after
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = {r.doc_id: r.text for r in before.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, before, "").collect():
        assert list(r.ids) == plain.encode_ordinary(own[r.doc_id]) and r.decoded_sha256 == sha(own[r.doc_id])


def test_pipeline_ids(spark):
    """Null and repeated ids, and rows repeated whole."""
    text = lambda n: " ".join(f"word{n}x{i}" for i in range(60))
    rows = [(5, "a b", "s"), (5, "ab", "s"), (None, "c d", "s"), (None, "cd", "t"), (6, "e", "s"), (6, "e", "s"), (None, "f", "s"), (7, "f", "s"), (8, None, "s"), (8, None, "s")]
    schema = "doc_id long, text string, source string"
    run = lambda stage, some, parts=3: sorted(map(tuple, stage(spark, spark.createDataFrame(some, schema).repartition(parts), "").collect()), key=repr)
    for parts in (1, 3):
        got = run(corpus_pipeline.exact, rows, parts)
        assert got == sorted([(5, "a b", "s"), (None, "c d", "s"), (6, "e", "s"), (None, "f", "s"), (8, None, "s")], key=repr)
    rows = [(9, text(1), "s"), (None, text(1), "s"), (9, text(2), "s"), (None, text(3), "s"), (None, text(3), "s"), (4, text(4), "s"), (4, text(4), "s"), (3, text(2).upper(), "s")]
    assert run(corpus_pipeline.near, rows) == sorted([(9, text(1), "s"), (3, text(2).upper(), "s"), (None, text(3), "s"), (4, text(4), "s")], key=repr)
    # The mix takes 150 % of the words; of each source the whole part for every row, the rest for some.
    rows = [(None if i % 3 == 0 else i // 4, f"{i} " * (5 + i % 3), "st"[i % 2]) for i in range(60)] + [(1, "r r r", "s")] * 6
    want = corpus_pipeline.source_mix.mix_sources(spark.createDataFrame(rows, schema)).groupBy("doc_id", "source", "size").agg(corpus_pipeline.F.sum("copies")).collect()
    got = run(corpus_pipeline.mix, rows)
    assert got == run(corpus_pipeline.mix, rows, 7) and set(got) <= set(rows)
    for doc, source, size, n in want:
        alike = [r for r in rows if (r[0], r[2], len(r[1].split())) == (doc, source, size)]
        assert sum((r[0], r[2], len(r[1].split())) == (doc, source, size) for r in got) == n
        assert {g: got.count(g) for g in alike} and all(got.count(g) <= 2 * alike.count(g) for g in alike)

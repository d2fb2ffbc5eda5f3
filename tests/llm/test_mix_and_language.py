import random

import pytest

from shoalwater.llm import language_id, source_mix

SF = "/root/testdata/sf0.01"


def test_targets():
    got = source_mix.mix_targets([("b", 100), ("a", 100), (None, 1000), ("c", 0)], (3, 1, 2), 1.5, 2.0)
    assert got["a"] == 200 and got["c"] == 0 and got["b"] == 200 and got[None] == pytest.approx(1400)
    assert source_mix.mix_targets([], (3, 1, 2), 1.5, 2.0) == {}


def test_flight_keeps_totals():
    rng = random.Random(0)
    rows = [(i, float(rng.randrange(1, 400)), 0.3) for i in range(5000)]
    out = dict(source_mix.flight(rows, random.Random(1), True))
    assert set(out.values()) == {0.0, 1.0} and len(out) == 5000
    assert abs(sum(out.values()) - 1500) <= 1
    assert abs(sum(s * out[i] for i, s, _ in rows) - 0.3 * sum(s for _, s, _ in rows)) <= 800


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = source_mix.mix_sources(docs, block_rows=16).collect()
    again = source_mix.mix_sources(docs.repartition(7), block_rows=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == docs.count()
    by = {}
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        size, target = sum(r.size for r in rows), rows[0].target
        assert rows[0].source_size == size
        assert abs(sum(r.taken for r in rows) - target) <= 2 * max(r.size for r in rows)
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))


def test_mix_odd_rows(spark):
    rows = [(1, None, None), (None, "a b", None), (2, "", "s"), (2, "", "s"), (3, "x y z", "t"), (3, "x y z", "t")] + [(9, "w w", "u")] * 50
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, block int")
    got = source_mix.mix_sources(docs, block_rows=8).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    assert source_mix.mix_sources(docs.limit(0)).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 100 < len(held) < 300
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    again = language_id.identify(docs.repartition(5)).collect()
    assert {r.doc_id: r.lang_pred for r in again} == {r.doc_id: r.lang_pred for r in got}


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 3!", "en"), (4, "hello the world", "en"), (4, "hello the world", "en"), (5, "字" * 3000 + "".join(chr(0x4E00 + i) for i in range(3000)), "zh"), (None, "das und der", None), (7, "the hello", None), (6, "漢字", "zh"), (9, "das und die", "de"), (10, "der und das", "de")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert (by[4].lang_pred, by[5].lang_pred, by[7].lang_pred, by[None].lang_pred) == ("en", "zh", "en", "de")
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}


def test_language_against_plain_vectors(spark):
    """Predictions against the definition, letter by letter."""
    import numpy as np

    rng = random.Random(3)
    words = {"en": "the and of with that", "de": "nicht und der die das über", "fr": "les des pour dans été où"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "!", " 12"]), lang) for i in range(60) for lang in [rng.choice(sorted(words))]]
    rows += [(100, "Über1the", None), (101, "a", None), (102, "", None)]
    letter = lambda c: np.random.Generator(np.random.Philox(key=[7, ord(c) if c else 0])).integers(0, 2, 1024, dtype=np.int8).astype(int) * 2 - 1

    def vector(text):
        out = np.zeros(1024, dtype=np.int64)
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = ["", *word, ""]
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return out

    proto = {k: sum(vector(t) for _, t, lang in rows if lang == k) for k in words}
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    for i, t, _ in rows:
        v = vector(t)
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in proto.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(max(0, cosine[best]), abs=1e-9)


def test_long_text_in_pieces():
    """A text of many pieces has the sum of all its trigrams; memory does not grow with it."""
    import numpy as np

    space, rng = language_id.Space(64, 7), random.Random(5)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(4000))
    whole, n = space.bundle([text])
    for most in (100, 1000):
        v, times = language_id.bundled(space, [text, "", text], 3, most)
        assert (v[0] == whole[0]).all() and (v[2] == whole[0]).all() and list(times) == [n[0], 0, n[0]] and not v[1].any()
    assert all(len(p) <= 100 for p in language_id._cut("a" * 1000 + text, 100))


def test_rejects_noise(spark):
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    noise = ["".join(rng.choice("абвгдежзийклмнопрстуфхцчшщ   ") for _ in range(400)), rng.randbytes(300).hex(), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300)), "12 3", "", None]
    both = docs.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language_id.keep_identified(both, language_id.fit(docs)).select("doc_id").collect()}
    assert not kept & set(range(-10, 0)) and len(kept) >= 0.99 * docs.count()


def test_mix_against_brute_force(spark):
    """Decisions against a plain cube method: the same steps, block by block, with the same draws."""
    rows = [(i, " ".join("w" * (1 + i * 7 % 23)), f"s{i % 3}") for i in range(90)]
    got = {r.doc_id: r for r in source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_rows=1000).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    for n, source in enumerate(("s0", "s1", "s2")):
        own = [i for i, _, s in rows if s == source]
        target = 1.5 * sum(size.values()) * (3, 1, 2)[n] / 6
        target = source_mix.mix_targets([(s, sum(size[i] for i, _, x in rows if x == s)) for s in ("s0", "s1", "s2")], (3, 1, 2), 1.5, 2.0)[source]
        ratio = target / sum(size[i] for i in own)
        whole, chance = int(ratio), ratio - int(ratio)
        rng, held, taken = random.Random(f"42/0/{n}/0"), [], {}

        def settle():
            for x in list(held):
                if x[1] <= 1e-9 or x[1] >= 1 - 1e-9:
                    held.remove(x)
                    taken[x[0]] = int(x[1] > 0.5)

        def move(step):
            up = min(((1 - x[1]) / m if m > 0 else x[1] / -m) for x, m in zip(held, step) if m)
            down = min((x[1] / m if m > 0 else (1 - x[1]) / -m) for x, m in zip(held, step) if m)
            by = up if rng.random() * (up + down) < down else -down
            for x, m in zip(held, step):
                x[1] += by * m
            settle()

        for i in own:
            held.append([i, chance])
            settle()
            while len(held) == 3:  # the null space of (documents, words) of three documents
                a, b, c = (size[x[0]] for x in held)
                move((c - b, a - c, b - a) if len({a, b, c}) > 1 else (1, -1, 0))
        while len(held) == 2:
            move((1, -1))
        if held:
            taken[held[0][0]] = int(rng.random() < held[0][1])
        assert {i: got[i].copies for i in own} == {i: whole + taken[i] for i in own}
        assert all(got[i].target == pytest.approx(target) and got[i].taken == size[i] * got[i].copies for i in own)

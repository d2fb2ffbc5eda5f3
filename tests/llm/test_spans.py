import random

import pytest
from brute import listed, pii_base, secrets_base, sha

from shoalwater.llm import pii, secrets

SF = "/root/testdata/sf0.001"
PIECES = [
    "a@b.co", "x.y%z@d-e.f.g._h@k.l ", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111111", "+1 (743) 555-3824", "+49-151", "+1..2 ", "++12345678",
    "password=abc123", "TOKEN : 'x1y2z3'", "api_key=", "apikey=\"QWErty12+/=\"", "secret=abc", "AKIA" + "A1" * 9, "AKIA12", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "é", "\U0001f600", "ſ", "K", "@handle_1", "5500 0000 0000 0004 12", "ghp_" + "aB3" * 8, "aB3" * 9, ".", "-", "=", "\"", "token", "9" * 30,
]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    return [None, "", "   ", *made, "1" * 60_000, "a1" * 60_000, "x@" * 30_000, "+1 " * 20_000, "a@b.c " * 100_000, "token=abcdef1 " * 100_000, "1.2.3.4 +1 743 5553824 4111111111111111," * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}", "clash", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, found string, start int").repartition(4)


def test_pii_base_spans(docs):
    got = {r.doc_id: r for r in pii.find_personal(docs).collect()}
    for i, t in enumerate(texts()):
        want = pii_base(t)
        assert got[i].base_sha256 == sha(listed(want)), (i, (t or "")[:200], want[:5], got[i].spans[:200])
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(listed(want).split(",")) - {""} <= set(got[i].spans.split(","))


def test_secret_base_spans(docs):
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for i, t in enumerate(texts()):
        want = secrets_base(t)
        assert got[i].base_sha256 == sha(listed(want)), (i, (t or "")[:200], want[:5], got[i].spans[:200])
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert set(listed(want).split(",")) - {""} <= set(got[i].spans.split(","))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = {r.doc_id: r.text for r in docs.collect()}
    for op, base in ((pii.find_personal, pii_base), (secrets.find_secrets, secrets_base)):
        got = {r.doc_id: r.base_sha256 for r in op(docs).collect()}
        assert got == {k: sha(listed(base(t))) for k, t in own.items()}


def test_ownership(spark):
    live, shared = "aB3dE5fG7hJ9kL1mN3pQ", "Zx9Yw8Vu7Ts6Rq5Po4Nm"
    rows = [(0, f"key {live} end", "a"), (1, f"key {live} end", "a"), *[(10 + i, f"key {shared} end", f"o{i}") for i in range(5)], (30, f"key {shared[:-1]}X end", None)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].spans == got[1].spans == "opaque:4:24" and (got[0].n_live, got[0].n_example) == (1, 0)
    assert all((got[10 + i].spans, got[10 + i].n_example) == ("", 1) for i in range(5))
    assert got[30].n_live == 1


def test_repositories(spark):
    """A value that one owner has copied into many repositories is an example; in many files of one repository it is not."""
    copied, own, late = "aB3dE5fG7hJ9kL1mN3pQ", "Zx9Yw8Vu7Ts6Rq5Po4Nm", "a" * 300 + "Bc1Df2Gh3"
    rows = [(i, f"key {copied} end", "a", f"r{i}") for i in range(9)] + [(20 + i, f"key {own} end", "a", "r0") for i in range(30)] + [(60, f"key {late}", None, None), (61, "token=" + " " * 80 + own, "a", "r0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r for r in secrets.find_secrets(docs, repo_col="repo").collect()}
    assert all((got[i].spans, got[i].n_live, got[i].n_example) == ("", 0, 1) for i in range(9))
    assert all((got[20 + i].spans, got[20 + i].n_live) == ("opaque:4:24", 1) for i in range(30))
    assert got[60].n_live == 1 and got[61].spans == "assign:0:106"
    by_document = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert by_document[20].spans == "" and by_document[20].n_example == 1


def test_secrets_of_null_rows(spark):
    rows = [(None, "token=abcdef1", None), (None, "token=abcdef1", None), (None, None, None), (3, "", "s")]
    got = sorted(map(tuple, secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "n_assign", "spans", "n_example").collect()), key=repr)
    assert got == sorted([(None, 1, "assign:0:13", 0)] * 2 + [(None, 0, "", 0), (3, 0, "", 0)], key=repr)


def test_estimates():
    good, bad, odd = (pii.packed(v, 0, 0) for v in ((2, 2, 2, 2), (1, 0, 1, 1), (2, 0, 0, 2)))
    p = pii.train({(4, good): 100, (4, bad): 300, (4, odd): 20})
    assert p[4, good] > 0.9 and p[4, bad] < 0.1 and p[4, odd] > 0.5


def em_brute(counts, rounds=50):
    """The same estimates, candidate by candidate."""
    start = {0: (0.4, 0.4, 0.2), 1: (0.4, 0.1, 0.5)}
    out = {}
    for kind in {k for k, _ in counts}:
        expected = 0.5 if kind < 4 else 0.2
        items = [pii._unpack(c)[:4] for (k, c), n in counts.items() if k == kind for _ in range(n)]
        share, says = expected, [{y: list(start[y]) for y in (0, 1)} for _ in range(4)]

        def chance(votes):
            p, q = share, 1 - share
            for j, v in enumerate(votes):
                p, q = p * says[j][1][v], q * says[j][0][v]
            return p / (p + q)

        for _ in range(rounds):
            w = [chance(v) for v in items]
            share_next = (sum(w) + 10 * expected) / (len(items) + 10)
            table = [{y: [(sum((x if y else 1 - x) for x, votes in zip(w, items) if votes[j] == v) + 10 * start[y][v]) / (sum(x if y else 1 - x for x in w) + 10) for v in range(3)] for y in (0, 1)} for j in range(4)]
            share, says = share_next, table
        out.update({(kind, c): chance(pii._unpack(c)[:4]) for k, c in counts if k == kind})
    return out


def test_expectation_maximisation():
    rng = random.Random(4)
    counts = {}
    for _ in range(300):
        kind = rng.choice([0, 4, 7])
        true = rng.random() < 0.4
        votes = tuple(rng.choice([0, 2, 2] if true else [0, 0, 1]) if rng.random() < 0.9 else rng.randrange(3) for _ in range(4))
        key = (kind, pii.packed(votes, rng.randrange(4), rng.randrange(4)))
        counts[key] = counts.get(key, 0) + 1
    share, says = pii.reliabilities(counts)
    want = em_brute(counts)
    for key in counts:
        assert pii.posterior(*key, share, says) == pytest.approx(want[key], abs=1e-9)
    assert all(pii._unpack(c)[:4] == v and pii.packed(v, *pii._unpack(c)[4:]) == c for _, c in counts for v in [pii._unpack(c)[:4]])


LABELLED = [  # text, kind, votes of shape, gazetteer and context (0 abstain, 1 no, 2 yes), touch
    ("ask Mr. John Smith, hello", "name", (0, 2, 2, 2)), ("the General Public License", "name", (0, 1, 0, 2)), ("Sich Sich geht", "name", (1, 0, 0, 2)),
    ("follow @foo_bar9 now", "handle", (2, 0, 2, 2)), ("see @media screen", "handle", (0, 1, 0, 2)),
    ("IBAN DE89 3704 0044 0532 0130 00 ok", "iban", (2, 2, 2, 2)), ("order XX12 3456 7890 1234", "iban", (1, 1, 1, 2)),
    ("lives at 12 Baker Street, London now", "address", (2, 2, 2, 2)), ("wohnt Hauptstraße 5 dort", "address", (2, 0, 2, 2)),
    ("4465758382889437 1111111111111111", "number", (2, 2, 0, 2)),
]


def test_votes(spark):
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LABELLED)], "i int, text string")
    for r in rows.select("i", pii.candidates("text").alias("found")).collect():
        _, kind, votes = LABELLED[r.i]
        assert votes in [pii._unpack(c.code)[:4] for c in r.found if pii.KINDS[c.kind] == kind], (LABELLED[r.i], [(pii.KINDS[c.kind], pii._unpack(c.code)) for c in r.found])


def test_classifier_adds_spans(spark):
    """What the base patterns miss is added where labelers agree; what they doubt is not, and base columns don't change."""
    texts = [x[0] for x in LABELLED] * 20 + [None, ""]
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, code string")).collect()}
    assert [got[i].spans for i in range(10)] == ["name:8:18", "", "", "handle:7:16", "", "iban:5:32", "", "address:9:24", "address:6:19", "number:0:16"]
    assert sum(r.n_added for r in got.values()) == 120
    assert all(got[i].base_sha256 == sha(listed(pii_base(t))) for i, t in enumerate(texts))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pii.find_personal(none).count() == 0 and secrets.find_secrets(none).count() == 0

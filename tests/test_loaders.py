import json

import pytest
from pyspark.sql import functions as F

from shoalwater.functions import stats
from shoalwater.functions.weights import Weights
from shoalwater.operators import evaluate, ngram, prompting, reporting
from shoalwater.plans import file_queries
from shoalwater.plans.file_queries import MANIFEST, weights_toml
from shoalwater.sources import feeds, loaders, snapshots

TOML = weights_toml(Weights())


def test_weights_round_trip():
    own, got = Weights(), loaders.parse_weights(TOML)
    assert got.signals == own.signals and dict(got.thresholds) == dict(own.thresholds) and got.categories == own.categories


@pytest.mark.parametrize("a,b,says", [
    ('basis = "placeholder"\ninherited_from', 'basis = "guess"\ninherited_from', "basis"), ("value = 0.6\n", "value = 0.7\n", "no measurement"), ("value = 0.6\n", 'value = 0.6\np_hit_given_ham = 0.1\n', "no probabilities"),
    ("value = 4.351698", "value = 4.5", "is not ln"), ("strong = true", "strong = 1", "strong is 1"), ('hard_capable = true\nstrong = false', 'hard_capable = true\nstrong = true', "both hard and strong"),
    ('hard_capable = true', 'hard_capable = false', "weight_hard"), ("[group_rationale]\n", "[group_rationale]\nx = \"y\"\n[other]\n", "rationale"), ('quotation = "quotation"', 'quotation = "nothing"', "unknown signals"),
    ('relationship = "relationship_building"\n', "", "roles without"), ("value = 1.0", "value = 0.0", "must be positive"), ("cases = 999", "cases = 2000", "descending"), ('name = "FAKE_PARCEL"', 'name = "FAKE_OTHER"', "unknown categories"), ('[[type_priority]]\nname = "FAKE_PARCEL"\ncases = 983\nsource = "statistics"\n', "", "missing"),
])
def test_weight_guards(a, b, says):
    assert a in TOML
    with pytest.raises(ValueError, match=says):
        loaders.parse_weights(TOML.replace(a, b, 1))


def test_model_guards():
    text = loaders.render_model(ngram.Model((("a", 1.0, 2.0),), 0.5), MANIFEST)
    assert loaders.parse_model(text).terms == (("a", 1.0, 2.0),)
    for change, says in (({"norm": "l1"}, "formula"), ({"lowercase": False}, "formula")):
        loaded = json.loads(text)
        loaded["manifest"] |= change
        with pytest.raises(ValueError, match=says):
            loaders.parse_model(json.dumps(loaded))
    for drop in ("manifest", "intercept", "terms"):
        with pytest.raises(ValueError, match="lacks"):
            loaders.parse_model(json.dumps({k: v for k, v in json.loads(text).items() if k != drop}))
    loaded = json.loads(text)
    del loaded["manifest"]["threshold"]
    with pytest.raises(ValueError, match="manifest lacks"):
        loaders.parse_model(json.dumps(loaded))
    with pytest.raises(ValueError, match="without terms"):
        loaders.parse_model(json.dumps({**json.loads(text), "terms": {}}))


def test_allowlist_guards(spark, tmp_path):
    def load(line, threshold=10, as_of="2024-01-10"):
        (tmp_path / "entries.jsonl").write_text(line + "\n\n")
        (tmp_path / "manifest.json").write_text(json.dumps({"threshold": threshold, "data_through": "2024-01-01"}))
        return [tuple(r) for r in loaders.load_allowlist(spark, str(tmp_path), as_of, 30).collect()]

    assert load('{"domain": "a.com", "rank": 3}') == [("a.com", 3)]
    for line in ('{"domain": "a.com", "rank": 11}', '{"domain": "a.com", "rank": true}', '{"domain": "a.com", "rank": 1.5}', '{"rank": 1}', "no json"):
        with pytest.raises(Exception, match="allowlist entry"):
            load(line)
    with pytest.raises(ValueError, match="not an integer"):
        load('{"domain": "a.com", "rank": 1}', "10")
    with pytest.raises(ValueError, match="days old"):
        load('{"domain": "a.com", "rank": 1}', as_of="2024-06-01")


def test_pages_of_articles():
    page = lambda ids, cursors: (200, json.dumps({"data": {"ListArticles": {"edges": [{"node": {"id": i}, "cursor": c} for i, c in zip(ids, cursors)]}}}).encode())
    answers = {None: page("ab", "12"), "2": page("c", "3"), "3": page("", "")}
    fetch = lambda answers, **more: [[n["id"] for n in p] for p in feeds.article_pages("q", {}, "u", lambda url, body: answers[json.loads(body)["variables"]["after"]], **more)]
    assert fetch(answers) == [["a", "b"], ["c"]] and fetch(answers, most=1) == [["a"]]
    with pytest.raises(ValueError, match="twice"):
        fetch({None: page("ab", "12"), "2": page("a", "3")})
    with pytest.raises(ValueError, match="advance"):
        fetch({None: page("ab", "12"), "2": page("c", "2")})
    with pytest.raises(RuntimeError, match="status 500"):
        fetch({None: (500, b"")})


def test_articles_pass_the_driver_in_pieces(spark, tmp_path):
    text = F.concat(*(F.sha2(F.concat_ws("-", "doc_id", F.lit(k)), 512) for k in range(64)))
    docs = spark.range(0, 4100, 1, 8).withColumnRenamed("id", "doc_id").select("doc_id", F.when(F.col("doc_id") != 7, text).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "20m")  # 33 MB of texts
    try:
        got = file_queries.article_pages(spark, str(tmp_path))
        assert got.count() == 4100 and got.where("text is null").count() == 1
        want = docs.selectExpr("cast(doc_id as string) id", "text", "if(doc_id % 2 = 0, 'c1', '') categories", "if(doc_id % 3 = 0, 'RUMOR', '') replies")
        assert got.exceptAll(want).count() == 0
    finally:
        conf.remove("spark.driver.maxResultSize")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert file_queries.article_pages(spark, f"{tmp_path}/none").count() == 0


def test_downloads():
    assert feeds.fetch_all({"a": "u1", "b": "u2"}, lambda url, body: (200, url.encode())) == {"a": b"u1", "b": b"u2"}
    for answer, says in (((404, b"x"), "status 404"), ((200, b""), "empty")):
        with pytest.raises(RuntimeError, match=says):
            feeds.download("u", "list", lambda url, body: answer)


def test_archive_without_member(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as out:
        out.writestr("other.csv", "1,a\n")
    with pytest.raises(Exception, match="other.csv"):
        feeds.read_ranked_zip(spark, str(tmp_path / "x.zip"), "top.csv")
    assert [tuple(r) for r in feeds.read_ranked_zip(spark, str(tmp_path / "x.zip"), "other.csv").collect()] == [("a", 1)]


def test_swap_refuses_to_shrink(spark, tmp_path):
    path = str(tmp_path / "list")
    frame = lambda n: spark.range(n).selectExpr("cast(id as string) as host")
    assert snapshots.write_snapshot(frame(10), path) == 10
    with pytest.raises(ValueError, match="10 before"):
        snapshots.write_snapshot(frame(4), path, 10)
    assert spark.read.schema("host string").json(path).count() == 10
    assert snapshots.write_snapshot(frame(5), path, 10) == 5 and spark.read.schema("host string").json(path).count() == 5


def test_tokens():
    tokens = prompting.Tokens(2)
    a, b, c = (tokens.issue(x, "s") for x in "abc")
    assert tokens.redeem(c) == "c" and tokens.redeem(b) == "b"
    for token, why in ((a, "evicted"), (b, "used"), ("x", "unknown")):
        with pytest.raises(KeyError, match=why):
            tokens.redeem(token)


def test_running_totals(spark):
    rows = [(i * 37 % 101, i % 5, "ab"[i % 2]) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v int, g string").repartition(6)
    for descending in (False, True):
        for by in (None, "g"):
            got = {r.k: r.before_v for r in evaluate.running(df, ["k"], ["v"], descending, by).collect()}
            assert got == {k: sum(w for j, w, h in rows if (j > k if descending else j < k) and (by is None or h == g)) for k, v, g in rows}
    assert evaluate.running(df.limit(0), ["k"], ["v"]).count() == 0


def test_guards_of_reports(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "id string, text string")
    assert {tuple(r) for r in reporting.unique_records(rows).collect()} == {("1", "a", 2), ("2", "b", 1)}
    with pytest.raises(Exception, match="two texts"):
        reporting.unique_records(rows.union(spark.createDataFrame([("2", "c")], rows.schema))).collect()
    with pytest.raises(Exception, match="without a label"):
        spark.createDataFrame([("other",)], "s string").select(reporting.label_of(F.col("s"))).collect()
    with pytest.raises(Exception, match="of split holdout"):
        reporting.require_split(spark.createDataFrame([("1", "holdout")], "id string, split string"), "tune").collect()
    with pytest.raises(ValueError, match="target"):
        stats.smallest_sample(spark, [0.0])
    assert stats.smallest_sample(spark, [1e-7]).first().n > 30_000_000


def test_folds_are_even(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(103)], "req_id long, label int")
    got = ngram.folds(labels, 5).groupBy("label", "fold").count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 1


def test_runtime_failures(spark):
    calls = spark.createDataFrame([(1, "good"), (2, "bad")], "req_id long, prompt string")

    def runtime(prompt):
        if prompt == "bad":
            raise TimeoutError
        return prompt.upper()

    assert {tuple(r) for r in prompting.answered(calls, runtime).collect()} == {(1, "GOOD", None), (2, None, "TimeoutError")}

import pytest
from pyspark.sql import functions as F

from shoalwater.functions.weights import Weights
from shoalwater.operators import ngram, presentation


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_states(spark):
    r = one(
        spark, a=presentation.check_state(F.lit(True), F.lit(True), F.lit("x")), b=presentation.check_state(F.lit(False), F.lit(False), F.lit("未命中")), c=presentation.source_of(F.lit("url_brand")),
        d=presentation.source_of(F.lit("llm_scam")), e=presentation.confidence_band(F.lit(0.55), Weights()), f=presentation.confidence_band(F.lit(0.3), Weights()), g=presentation.verdict_state(F.lit(0.9), F.lit(False)),
    )
    assert tuple(r) == ("conclusive", "clear", "url", "semantic", "medium", None, "signals")
    with pytest.raises(Exception, match="unknown kind"):
        one(spark, a=presentation.check_state(F.lit(False), F.lit(False), F.lit("?")))


def test_lines(spark):
    r = one(spark, p=presentation.evidence_parts(F.lit("標題；註一；註二：「原文」")), t=presentation.masked_title(F.lit("連結 https://a.b/c 佔 12.5%：「x」")))
    assert (r.p.title, list(r.p.notes), r.p.quote) == ("標題", ["註一", "註二"], "原文")
    assert r.t == "連結 [網址已省略] 佔 [比率已省略]"


def test_recommendations(spark):
    rows = [("a", False, 5, 0, True, -0.1), ("b", True, 0, 0, True, -0.1), ("c", True, 4, 4, True, -0.1), ("d", True, 4, 0, False, -0.1), ("e", True, 4, 0, True, 0.0), ("f", True, 4, 1, None, -0.1)]
    got = presentation.recommendations(spark.createDataFrame(rows, "name string, registered boolean, hits long, shadowed long, separable boolean, delta_recall double")).collect()
    assert {r.name: r.advice for r in got} == {"a": "insufficient", "b": "remove", "c": "regroup", "d": "insufficient", "e": "insufficient", "f": "keep"}


def test_decision_interval(spark):
    rows = [("measured", 1.0, False), ("measured", 3.0, True), ("wide", 9.0, False)]
    df = spark.createDataFrame(rows, "exit string, weight double, hard boolean")
    assert tuple(presentation.decision_interval(df, 1.5).first()) == (2.0, True, 1.0, 3.0)
    assert presentation.decision_interval(df.where("hard"), 1.5).first().value == 1.5


def test_lookups(spark):
    services = spark.createDataFrame([(0, ["Com", "tw"], ["http://x", "https://a"]), (1, ["com"], ["https://b"]), (2, ["zz"], ["http://c"])], "position int, tlds array<string>, urls array<string>")
    assert {r.tld: r.url for r in presentation.lookup_endpoints(services).collect()} == {"com": "https://a", "tw": "https://a"}
    r = one(spark, a=presentation.registration(F.lit('{"events":[{"eventAction":"expiration","eventDate":"2030-01-01T00:00:00Z"},{"eventAction":"registration","eventDate":"2020-02-03T04:05:06Z"}]}')), b=presentation.registration(F.lit('{"events":[]}')), c=presentation.registration(F.lit("x")))
    assert (r.a.outcome, str(r.a.registered_on), r.b.outcome, r.c.outcome) == ("KNOWN", "2020-02-03", "NO_DATA", "NO_DATA")
    old = spark.createDataFrame([("s", "2024-01-01", False, 30), ("t", "2020-01-01", True, None)], "source string, data_through string, retired boolean, max_age_days int")
    assert {r.source: r.stale for r in presentation.freshness(old, "2024-03-01").collect()} == {"s": True, "t": False}


def test_grid_search(spark):
    rows = [(i, ("win money now" if i % 2 else "see you at lunch")) for i in range(20)]
    texts = spark.createDataFrame(rows, "req_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "req_id long, label int")
    best = ngram.grid_search(texts, labels, [((1, 1), 50)], 2, max_iter=10).first()
    assert best.f1 == 1.0 and best.max_features == 50

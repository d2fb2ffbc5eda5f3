import pytest
from pyspark.sql import functions as F

from shoalwater.functions.weights import Weights
from shoalwater.operators import document, fuse, replay, rules, urls
from shoalwater.plans.detect import Dimensions, detect

SUFFIXES = "// ===BEGIN ICANN DOMAINS===\ncom\ntw\ngov.tw\n*.ck\n!www.ck\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nblogspot.com\n// ===END PRIVATE DOMAINS==="
SCHEMA = "req_id long, msg_idx int, sender string, text string"


def signals(spark, rows):
    made = [(r, n, i, True, h, False, "d", [(0, 0)], t) for i, (r, n, h, t) in enumerate(rows)]
    return spark.createDataFrame(made, rules.SIGNAL_SCHEMA)


def fused(spark, hits, truncated=False):
    requests = spark.createDataFrame([(1, 1, 1 if truncated else 0, truncated)], "req_id long, n_messages long, dropped long, truncated boolean")
    sentences = spark.createDataFrame([(1, 0, 0, "t", "t", [0, 1])], "req_id long, m int, s int, text string, raw string, offsets array<int>")
    return fuse.fuse(requests, sentences, signals(spark, [(1, *h) for h in hits]), Weights()).first()


CASES = [
    ([], 0.0, None, 0.05, None, False),
    ([("solicit_otp", True, ["ACCOUNT_TAKEOVER"])], 2.5, 0.924142, 0.9, "ACCOUNT_TAKEOVER", True),
    ([("safe_account", True, ["FAKE_AUTHORITY"]), ("atm_operation", True, ["ORDER_ANOMALY"]), ("secrecy_demand", True, ["FAKE_AUTHORITY"])], 2.5, 0.924142, 0.9, "FAKE_AUTHORITY", True),
    ([("safe_account", True, ["FAKE_AUTHORITY"]), ("guaranteed_return", False, ["FAKE_INVESTMENT"])], 3.1, 0.956893, 0.9, "FAKE_AUTHORITY", True),
    ([("safe_account", True, ["FAKE_AUTHORITY"]), ("quotation", False, [])], 2.5, None, 0.3, "FAKE_AUTHORITY", False),
    ([("url_blocklist", True, ["PHISHING_LINK"]), ("quotation", False, [])], 2.5, 0.924142, 0.9, "PHISHING_LINK", True),
    ([("guaranteed_return", False, ["FAKE_INVESTMENT"]), ("quotation", False, [])], 0.0, 0.5, 0.55, "FAKE_INVESTMENT", False),
    ([("ngram_classifier", False, [])], 4.351698, None, 0.35, None, False),
    ([("ngram_classifier", False, []), ("llm_scam", False, ["FAKE_LOAN"])], 4.951698, 0.992978, 0.7, "FAKE_LOAN", True),
    ([("guaranteed_return", False, ["FAKE_INVESTMENT"]), ("relationship_building", False, [])], 1.2, 0.768525, 0.55, "ROMANCE_INVESTMENT", False),
]


@pytest.mark.parametrize("hits,score,probability,confidence,category,decided", CASES)
def test_fusion(spark, hits, score, probability, confidence, category, decided):
    v = fused(spark, hits)
    assert v.score == pytest.approx(score) and v.confidence == confidence and v.scam_type == category and v.decided == decided
    assert v.scam_probability == (None if probability is None else pytest.approx(probability, abs=1e-6))


def test_unweighted_signal_fails(spark):
    with pytest.raises(Exception, match="no weight"):
        fused(spark, [("guaranteed_return", True, [])])
    with pytest.raises(KeyError):
        Weights().validate_against({"unheard_of"})
    assert Weights().with_overrides({"quotation": 0.0}, {"decision_score": 1.0}).threshold("decision_score") == 1.0


def test_truncation_cap(spark):
    v = fused(spark, [("guaranteed_return", False, ["FAKE_INVESTMENT"]), ("parcel_notice", False, ["FAKE_PARCEL"])], truncated=True)
    assert v.confidence == 0.5 and v.evidence[-1].startswith("前 1 則")


HITS = {
    "solicit_otp": "請提供驗證碼給客服", "solicit_card_secret": "請回覆信用卡號與末三碼", "deliver_bank_instrument": "請把提款卡寄送給專員", "atm_operation": "請到提款機操作解除分期", "safe_account": "請匯款到安全帳戶",
    "secrecy_demand": "不要告訴家人", "remote_control_tool": "請下載AnyDesk", "guaranteed_return": "保證獲利", "identity_docs": "請提供身分證正反面", "identity_reset": "猜猜我是誰", "loan_no_check": "免聯徵", "high_pay_no_skill": "徵兼職日領",
}


def test_rules(spark):
    rows = [(i, 0, None, t) for i, t in enumerate(HITS.values())] + [(100, 0, None, "不要提供驗證碼給任何人"), (101, 0, None, "請告知驗證碼給客服 1234"), (102, 0, None, "可以告訴家人"), (103, 0, None, None), (104, 0, None, "請輸入驗證碼")]
    found = detect(spark.createDataFrame(rows, SCHEMA)).signals.collect()
    by = {}
    for s in found:
        by.setdefault(s.req_id, {})[s.name] = s
    for i, name in enumerate(HITS):
        assert name in by[i], name
    assert by[0]["solicit_otp"].hard and not by[101]["solicit_otp"].hard and "自帶碼" in by[101]["solicit_otp"].detail
    assert 100 not in by and 102 not in by and 103 not in by
    assert not by[104]["solicit_otp"].hard and "祈使" in by[104]["solicit_otp"].detail


def test_rule_guards():
    with pytest.raises(ValueError):
        rules.Rule("x", "", ("a",), hard=True)
    with pytest.raises(ValueError):
        rules.Rule("Not snake", "", ("a",))


def test_links(spark):
    texts = ["見 https://user@Evil.COM:80/a?b=c。", "www.post.gov.tw/x）後", "到bit.com、看", "http://1.2.3.4/", "a.py 不是", "網址foo.ck 與 www.ck", "https://中国.com/路徑"]
    own = spark.createDataFrame([(i, 0, 0, t, t, [0]) for i, t in enumerate(texts)], "req_id long, m int, s int, text string, raw string, offsets array<int>")
    found = {}
    for r in urls.extract_urls(own, urls.Suffixes.parse(SUFFIXES)).collect():
        found.setdefault(r.req_id, []).append((r.url, r.host, r.registrable_domain, r.is_ip, r.has_userinfo))
    assert found[0] == [("https://evil.com:80/a?b=c", "evil.com", "evil.com", False, True)]
    assert found[1] == [("post.gov.tw/x", "post.gov.tw", "post.gov.tw", False, False)]
    assert found[3] == [("http://1.2.3.4/", "1.2.3.4", None, True, False)]
    assert 4 not in found and found[6][0][1] == "xn--fiqs8s.com"


def test_suffixes(spark):
    rules_ = urls.Suffixes.parse(SUFFIXES).frame(spark)
    hosts = ["com", "a.com", "b.a.com", "x.blogspot.com", "blogspot.com", "foo.ck", "b.foo.ck", "www.ck", "a.www.ck", "post.gov.tw", "unknown.zz", "zz", "a..b", "1.2.3.4"]
    got = {r.host: r.registrable_domain for r in urls.registrable_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), rules_).collect()}
    assert got == {"com": None, "a.com": "a.com", "b.a.com": "a.com", "x.blogspot.com": "x.blogspot.com", "blogspot.com": None, "foo.ck": None, "b.foo.ck": "b.foo.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "post.gov.tw": "post.gov.tw", "unknown.zz": "unknown.zz", "zz": None, "a..b": None, "1.2.3.4": None}


def test_url_signals_and_gate(spark):
    dims = Dimensions(
        suffixes=urls.Suffixes.parse(SUFFIXES), as_of="2024-06-30",
        blocklist=spark.createDataFrame([("bad.evil.com", "evil.com", "176455", "名單", "2024-05", "投資", None, True)], "host string, registrable_domain string, source string, title string, last_seen string, nature string, target string, domain_level boolean"),
        allowlist=spark.createDataFrame([], "domain string, rank int"), shorteners=spark.createDataFrame([("bit.com", "svc")], "domain string, service string"),
        tld_risks=spark.createDataFrame([("tw", 300.0, "src", "2024")], "tld string, value double, source string, as_of string"),
        ages=spark.createDataFrame([("young.com", "KNOWN", "2024-06-20")], "domain string, outcome string, registered_on string").withColumn("registered_on", F.to_date("registered_on")),
    )
    rows = [(1, 0, None, "看 http://bad.evil.com/x"), (2, 0, None, "看 http://ok.evil.com/x"), (3, 0, None, "看 bit.com/x"), (4, 0, None, "看 http://foo.tw/ 玉山銀行"), (5, 0, None, "看 http://young.com/"), (6, 0, None, "看 http://esunbamk.com/")]
    found = detect(spark.createDataFrame(rows, SCHEMA), dims=dims)
    by = {(s.req_id, s.name): s for s in found.signals.collect()}
    assert by[1, "url_blocklist"].hard and "投資" in by[1, "url_blocklist"].detail and not by[2, "url_blocklist"].hard
    assert (3, "url_shortener") in by and (4, "url_tld_risk") in by and (4, "url_brand") in by
    assert by[5, "domain_age"].hit and (1, "domain_age") not in by and by[2, "domain_age"].indeterminate
    assert "編輯距離為 1" in by[6, "url_brand"].detail


def test_replayed_judgements(spark):
    own = spark.createDataFrame([(i, 0, 0, "t", "t", [0, 1]) for i in range(6)], "req_id long, m int, s int, text string, raw string, offsets array<int>")
    answer = lambda ids, cat, label: f'{{"analysis_notes":"n","evidence_sentence_ids":{ids},"category_165":{cat},"label":"{label}"}}'
    raw = [(0, answer("[[0,0]]", '"假投資"', "scam")), (1, answer("[[3,0]]", "null", "scam")), (2, "not json"), (3, answer("[]", "null", "scam")), (4, answer("[]", "null", "not_scam")), (5, answer("[[true,0]]", "null", "scam"))]
    got = {r.req_id: r for r in replay.validated(spark.createDataFrame(raw, "req_id long, raw string"), own).collect()}
    assert [got[i].outcome for i in range(6)] == ["ok", "out_of_window", "malformed", "inconsistent", "ok", "malformed"]
    assert got[0].category == "FAKE_INVESTMENT"
    sig = {r.req_id: r for r in replay.model_signals(replay.validated(spark.createDataFrame(raw, "req_id long, raw string"), own), 0).collect()}
    assert sig[0].hit and sig[2].indeterminate and 4 not in sig


def test_row_order_and_partitions_do_not_matter(spark):
    rows = [(i % 7, i, None, t) for i, t in enumerate(list(HITS.values()) * 3)]
    a = detect(spark.createDataFrame(rows, SCHEMA)).verdicts.orderBy("req_id").collect()
    b = detect(spark.createDataFrame(rows[::-1], SCHEMA).repartition(9)).verdicts.orderBy("req_id").collect()
    assert a == b


def test_limits(spark):
    rows = [(1, i, None, "字" * 10) for i in range(6)]
    own = document.analysed_messages(spark.createDataFrame(rows, SCHEMA), document.Limits(4, 25)).where("kept").count()
    assert own == 2
    with pytest.raises(ValueError):
        document.Limits(0, 1)

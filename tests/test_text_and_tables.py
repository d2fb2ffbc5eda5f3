import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from shoalwater.functions import stats, text
from shoalwater.operators import evaluate, ngram, quotation, redact
from shoalwater.sources import snapshots
from shoalwater.streaming import conversations


def test_normalisation_offsets():
    rng = random.Random(1)
    alphabet = "aé中１ｆ！？。;!\n\r \t​﻿❗ﬁ㍿\U0001f600"
    for _ in range(500):
        raw = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        norm, at = text.normalise(raw)
        assert len(at) == len(norm) + 1 and at[-1] == len(raw) and at == sorted(at) and (not norm or at[0] == 0)
        assert text.unchanged(raw) == (norm == raw and "\r" not in raw)
        size, found = text.sentences(raw)
        assert size == len(norm)
        for body, own, lead, offsets in found:
            offsets = [0, *range(lead + 1, lead + len(body)), len(own)] if offsets is None else offsets
            assert body == body.strip() and body and len(offsets) == len(body) + 1 and offsets[-1] == len(own) and own in raw


@pytest.mark.parametrize("raw,want", [
    ("你好。再見!!好", ["你好。", "再見!!", "好"]), ("a\r\nb\rc", ["a", "b", "c"]), ("見https://a.com/x;y?z 好;", ["見https://a.com/x;y?z 好;"]), ("１２！", ["12!"]), ("  \n ", []), ("", []), ("？！？", ["?!?"]),
])
def test_sentences(raw, want):
    assert [s for s, *_ in text.sentences(raw)[1]] == want


def test_quotes():
    assert quotation.quoted("他說「一二三四五六七八」") == ["一二三四五六七八"]
    assert quotation.quoted("「外「內內內內內內內內」外」") == ["外「內內內內內內內內」外"]
    assert quotation.quoted('"short" "long enough text"') == ["long enough text"]


def test_redaction(spark):
    rows = ["我的電話0912-345-678", "市話 02-2345-6789", "卡號 4111 1111 1111 1111", "身分證 A123456789", "A123456788", "https://x.com/0912345678", "無", "4111111111111111 與 0912345678"]
    own = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(rows)], "req_id long, m int, s int, text string")
    got = {r.req_id: r for r in redact.redacted(own).collect()}
    assert [got[i].text for i in range(8)] == ["我的電話<TW_MOBILE>", "市話 <TW_LANDLINE>", "卡號 <CREDIT_CARD>", "身分證 <TW_ID>", "A123456788", "https://x.com/0912345678", "無", "<CREDIT_CARD> 與 <TW_MOBILE>"]
    assert got[7].credit_card == 1 and got[7].tw_mobile == 1 and got[6].tw_id == 0


def test_wilson(spark):
    low, high = stats.wilson(F.lit(4), F.lit(428))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert r.h == pytest.approx(0.0238, abs=1e-4) and r.l > 0
    got = {r.target: r.n for r in stats.smallest_sample(spark, [0.01, 0.02, 0.05]).collect()}
    assert got[0.02] == 189
    with pytest.raises(Exception, match="without observations"):
        spark.range(1).select(stats.wilson(F.lit(0), F.col("id"))[0].alias("x")).collect()


def test_ngram_scores(spark):
    model = ngram.Model((("ab", 1.5, 2.0), ("b ", 1.0, -1.0), ("a", 1.0, 0.5)), 0.25)
    texts = spark.createDataFrame([(1, "AB ab"), (2, "zz"), (3, "a")], "req_id long, text string")
    got = {r.req_id: r.ngram_score for r in ngram.gram_scores(texts, model).collect()}
    import math

    tf = 1 + math.log(2)
    v = [tf * 1.5, tf, tf]
    assert got[1] == pytest.approx(0.25 + (v[0] * 2 - v[1] + v[2] * 0.5) / math.sqrt(sum(x * x for x in v)))
    assert got[2] == 0.25 and got[3] == pytest.approx(0.75)


def test_training_separates(spark):
    rows = [(i, ("win money now " if i % 2 else "see you at lunch ") * (1 + i % 3)) for i in range(40)]
    texts = spark.createDataFrame(rows, "req_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "req_id long, label int")
    model = ngram.train(texts, labels, (1, 2), 200)
    got = {r.req_id: r.ngram_score for r in ngram.gram_scores(texts, model).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)


def test_splits(spark):
    got = spark.createDataFrame([("abc", "x"), ("00ff", "conversation_ham"), ("q", "self_sms_ham")], "id string, subset string").select("id", evaluate.split_of(F.col("id"), F.col("subset")).alias("s")).collect()
    want = "tune" if hashlib.sha256(b"abc").digest()[0] < 128 else "holdout"
    assert [r.s for r in got] == [want, "tune", "holdout"]


def test_snapshots(spark, tmp_path):
    lines = [{"host": "a.com", "url": "http://a.com", "source": "s", "first_seen": "2024-01", "last_seen": "2024-02", "nature": "x y"}]
    data = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n\n"
    (tmp_path / "e.jsonl").write_text(data, encoding="utf8")
    manifest = {"entries_file": "e.jsonl", "entries_sha256": hashlib.sha256(data.encode()).hexdigest(), "sources": {"s": {"title": "T", "redistributable": True, "data_through": "2024-02-01", "retired": False}}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    got = snapshots.load_blocklist(spark, str(tmp_path), "2024-02-10", {"s": 30}).collect()
    assert len(got) == 1 and got[0].nature == "x y" and got[0].title == "T"
    with pytest.raises(ValueError, match="days old"):
        snapshots.load_blocklist(spark, str(tmp_path), "2025-02-10", {"s": 30})
    with pytest.raises(KeyError):
        snapshots.load_blocklist(spark, str(tmp_path), "2024-02-10", {})
    manifest["entries_sha256"] = "0"
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="checksum"):
        snapshots.load_blocklist(spark, str(tmp_path), "2024-02-10", {"s": 30})


def test_writing_refuses_to_shrink(spark, tmp_path):
    df = spark.range(10)
    assert snapshots.write_snapshot(df, str(tmp_path / "s"), before=15) == 10
    with pytest.raises(ValueError, match="only"):
        snapshots.write_snapshot(spark.range(2), str(tmp_path / "s"), before=10)
    assert spark.read.json(str(tmp_path / "s")).count() == 10


def test_dates_and_chat(spark):
    r = spark.range(1).select(snapshots.roc_month(F.lit("11302")).alias("m"), snapshots.slash_date(F.lit("2024/03/05")).alias("d"), snapshots.compact_date(F.lit("20240305")).alias("c"), snapshots.minutes_of(F.lit("下午03:05")).alias("t"), snapshots.http_date(F.lit("Wed, 21 Oct 2015 07:28:00 GMT")).cast("string").alias("h")).first()
    assert (r.m, r.d, r.c, r.t, r.h) == ("2024-02", "2024-03-05", "2024-03-05", 905, "2015-10-21")
    lines = ["[LINE] 與甲的聊天記錄", "儲存日期：2024/3/6", "2024/03/05（二）", "上午09:01\t甲\t你好", "第二行", "下午03:05\t乙\t好"]
    got = snapshots.chat_export(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")).orderBy("msg").collect()
    assert [(g.sender, g.text) for g in got] == [("甲", "你好\n第二行"), ("乙", "好")]


def test_ranked_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,a.com\n2,b.com\n")
    assert snapshots.read_ranked_csv(spark, str(tmp_path / "r.csv")).count() == 2
    (tmp_path / "q.csv").write_text("1,a.com\n3,b.com\n")
    with pytest.raises(ValueError):
        snapshots.read_ranked_csv(spark, str(tmp_path / "q.csv"))


def test_streams(spark, tmp_path):
    schema = "req_id long, msg_idx int, sender string, text string"
    first = spark.createDataFrame([(1, 0, None, "你好"), (2, 0, None, "保證獲利")], schema)
    second = spark.createDataFrame([(1, 1, None, "請提供驗證碼給客服")], schema)
    first.write.parquet(str(tmp_path / "in/a"))
    second.write.parquet(str(tmp_path / "in/b"))
    sink = conversations.VerdictStream(str(tmp_path / "out"))
    for i, part in enumerate("ab"):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / f"in/{part}"))
        sink.process(spark.read.schema(schema).parquet(str(tmp_path / f"in/{part}")), i)
        assert source.isStreaming
    sink.process(spark.read.schema(schema).parquet(str(tmp_path / "in/b")), 1)  # a repeated batch
    got = {r.req_id: r for r in sink.latest(spark).collect()}
    assert got[1].scam_type == "ACCOUNT_TAKEOVER" and got[2].scam_type == "FAKE_INVESTMENT" and len(got) == 2
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    q = conversations.windowed_state(stream).writeStream.outputMode("update").format("memory").queryName("sizes").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.req_id, r.n_seen) for r in spark.sql("select * from sizes").collect()} >= {(1, 2), (2, 1)}

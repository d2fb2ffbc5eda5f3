"""Queries over cases: every document stands for one of a list of inputs, chosen by its number.

The test tables hold no zh-TW text, no odd links and no model answers, so these
queries put such inputs in the place of every document's text.  What an
operator must make of each input is written down by hand from the described
behaviour, not taken from a run; the SQL joins it to the documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions import text
from shoalwater.functions.weights import Weights
from shoalwater.operators import document, evasion, presentation, prompting, quotation, redact, replay, reporting, rules, urls
from shoalwater.plans.text_queries import CODE_SQL, hits_sql, sql_any, table
from shoalwater.sources import feeds, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATALOGUE = rules.default_catalogue()


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _cast(column: Column, kind: str) -> Column:
    return column.cast({"VARCHAR": "string", "BIGINT": "long", "DOUBLE": "double", "BOOLEAN": "boolean"}[kind])


def chosen(spark: SparkSession, sf_dir: str, inputs: list[str | None]) -> DataFrame:
    """(req_id, k, text): every document with input number doc_id modulo the number of inputs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("req_id"), F.pmod("doc_id", F.lit(len(inputs))).cast("int").alias("k"))
    return docs.withColumn("text", F.get(F.array(*map(F.lit, inputs)).cast("array<string>"), F.col("k")))


def sentences(rows: DataFrame) -> DataFrame:
    return document.sentences_of(document.analysed_messages(document.from_texts(rows, "req_id", "text")))


def cases(columns: dict[str, str], expected: list[tuple[str | None, list[tuple]]]):
    """Registers an operator from (req_id, k, text) to (req_id, columns) under its name, with what each input must give."""
    inputs = [x for x, _ in expected]

    def register(operator: Callable[[DataFrame], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = operator(chosen(spark, sf_dir, inputs))
            return rows.select(F.col("req_id").alias("doc_id"), *(_cast(F.col(c), k).alias(c) for c, k in columns.items()))

        query.__doc__ = operator.__doc__
        QUERIES[operator.__name__] = query
        values = ", ".join(f"({', '.join(map(_sql, (k, *row)))})" for k, (_, rows) in enumerate(expected) for row in rows)
        shown = ", ".join(f"CAST(v.{c} AS {k}) AS {c}" for c, k in columns.items())
        ORACLES[operator.__name__] = f"SELECT d.doc_id, {shown} FROM documents d JOIN (VALUES {values}) AS v(k, {', '.join(columns)}) ON d.doc_id % {len(inputs)} = v.k"
        return query

    return register


# ---------------------------------------------------------------- rules of the zh-TW catalogue


def _acts() -> list[str]:
    """For each rule: a full hit, one by imperative only, one that is negated, one for others, one with a code, one in a longer sentence."""
    made = []
    for r in CATALOGUE.rules:
        act = ("不要" if r.negative else "") + r.predicates[0] + (r.objects[0] if r.objects else "")
        around = r.context[0] if r.context else ""
        to = r.receivers[0] if r.receivers else ""
        made += [f"{around}{act}{to}。", f"請{act}{around};好的。", f"{around}{'' if r.negative else '不要'}{r.predicates[-1]}{r.objects[-1] if r.objects else ''}{to}", f"{act}{to}{around},他人也可以", f"{act}{to}{around}。您的號碼 482913 已送出", f"您好,{act}{to}:{around}謝謝!"]
    made += ["我是工程師。想照顧你一輩子", "我是工程師 寶貝", "寶貝。加我LINE", "今天天氣很好。", ""]
    return made


ACTS = _acts()
_ACT_SENTENCES = """
msg AS (SELECT doc_id AS req_id, 0 AS m, list_extract([{texts}], CAST(doc_id % {n} AS INTEGER) + 1) AS text FROM documents),
cut AS (SELECT req_id, m, list_filter(list_transform(string_split(regexp_replace(text, '([。!?;]+)', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM msg),
sent AS (SELECT req_id, m, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS s, unnest(parts) AS text FROM cut)
""".replace("{texts}", ", ".join(map(_sql, ACTS))).replace("{n}", str(len(ACTS)))
_NAMES = "[" + ", ".join(_sql(r.name) for r in CATALOGUE.rules) + "]"


def act_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(chosen(spark, sf_dir, ACTS))


def speech_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of each of the 21 rules in every sentence that it matches."""
    names = F.array(*(F.lit(r.name) for r in CATALOGUE.rules))
    return rules.clause_hits(act_sentences(spark, sf_dir), CATALOGUE).select(F.col("req_id").alias("doc_id"), "m", "s", F.get(names, F.col("rule")).alias("name"), "level", "single")


ORACLES["speech_acts"] = f"WITH {hits_sql(CATALOGUE, _ACT_SENTENCES)} SELECT req_id AS doc_id, m, s, {_NAMES}[rule + 1] AS name, level, single FROM hit"


def speech_act_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the rules with their details: fact, exemption for a contained code, weak and single-clause notes."""
    rows = rules.rule_signals(act_sentences(spark, sf_dir), CATALOGUE)
    return rows.select(F.col("req_id").alias("doc_id"), "name", "hard", "detail", F.array_join("scam_types", ",").alias("types"))


_FACT = "[" + ", ".join(_sql(r.fact if r.hard else "") for r in CATALOGUE.rules) + "]"
_SUMMARY = "[" + ", ".join(_sql(r.summary) for r in CATALOGUE.rules) + "]"
_HARD = "[" + ", ".join(_sql(r.hard) for r in CATALOGUE.rules) + "]"
_TYPES = "[" + ", ".join(_sql(",".join(r.types)) for r in CATALOGUE.rules) + "]"
_EXEMPT = ", ".join(str(i) for i, r in enumerate(CATALOGUE.rules) if r.name in CATALOGUE.code_exempt)
ORACLES["speech_act_signals"] = f"""WITH {hits_sql(CATALOGUE, _ACT_SENTENCES)}, {CODE_SQL},
  g AS (SELECT h.req_id, rule, max(level) = 2 AS full_, bool_or(single) AS single, any_value(code) AS code FROM hit h LEFT JOIN code c ON h.req_id = c.req_id AND h.m = c.m GROUP BY h.req_id, h.m, rule),
  e AS (SELECT *, CASE WHEN rule IN ({_EXEMPT}) THEN code END AS own FROM g)
  SELECT req_id AS doc_id, {_NAMES}[rule + 1] AS name, {_HARD}[rule + 1] AND full_ AND own IS NULL AS hard,
  concat_ws('；', {_SUMMARY}[rule + 1], CASE WHEN {_FACT}[rule + 1] <> '' THEN '事實：' || {_FACT}[rule + 1] END, CASE WHEN own IS NOT NULL THEN '訊息內已含 ' || length(own) || ' 位數字 ' || own || '，自帶碼豁免成立，降級為弱訊號' END,
    CASE WHEN NOT full_ THEN '子句內未出現接收者，僅憑祈使標記命中，降級為弱訊號' END, CASE WHEN single THEN '本句未切出子句，否定範疇涵蓋全句' END) AS detail, {_TYPES}[rule + 1] AS types FROM e"""


def relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of relationship words in two sentences."""
    return rules.relationship_signals(act_sentences(spark, sf_dir), CATALOGUE, 0).select(F.col("req_id").alias("doc_id"), F.size("evidence").cast("long").alias("n_evidence"))


_REL = " UNION ALL ".join(f"SELECT req_id, m, s, '{k}' AS kind FROM sent WHERE {sql_any('text', w)}" for k, w in CATALOGUE.relationship)
ORACLES["relationship"] = f"WITH {_ACT_SENTENCES}, k AS ({_REL}) SELECT req_id AS doc_id, count(DISTINCT s) AS n_evidence FROM k GROUP BY req_id, m HAVING count(DISTINCT kind) > 1 AND count(DISTINCT s) > 1"


def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered checks in order, with weight, group and strength, and how many documents each hits."""
    weights = Weights()
    weights.validate_against(set(CATALOGUE.names()))
    hits = rules.rule_signals(act_sentences(spark, sf_dir), CATALOGUE).groupBy("name").agg(F.count_distinct("req_id").alias("n"))
    names = spark.createDataFrame([(n, i) for i, n in enumerate(CATALOGUE.names()) if n != "relationship_building"], "name string, no long")
    soft = weights.frame(spark).where("not hard").select("name", "grp", "weight")
    return names.join(soft, "name").join(hits, "name", "left").select("name", "no", "grp", "weight", F.coalesce("n", F.lit(0)).alias("n"))


_SOFT = ", ".join(f"({_sql(n)}, {i}, {_sql(g)}, {w})" for i, r in enumerate(CATALOGUE.rules) for n, g, w, _, _ in Weights().signals if n == r.name)
ORACLES["rule_registry"] = f"""WITH {hits_sql(CATALOGUE, _ACT_SENTENCES)}, n AS (SELECT rule, count(DISTINCT req_id) AS n FROM hit GROUP BY rule)
  SELECT v.name, v.no::BIGINT AS no, v.grp, v.weight::DOUBLE AS weight, coalesce(n.n, 0) AS n FROM (VALUES {_SOFT}) AS v(name, no, grp, weight) LEFT JOIN n ON n.rule = v.no"""
QUERIES |= {f.__name__: f for f in (speech_acts, speech_act_signals, relationship, rule_registry)}

# ---------------------------------------------------------------- text and coordinates


@cases({"raw_start": "BIGINT", "raw_end": "BIGINT", "piece": "VARCHAR"}, [
    ("１２３ａｂｃ。", [(0, 3, "１２３")]), ("a​b c", [(0, 3, "a​b")]), ("㍿好的", [(0, 1, "㍿")]), ("   hi! yo", [(0, 5, "   hi")]), ("plain text", [(0, 3, "pla")]), ("one;two", [(0, 3, "one")]),
])
def raw_spans(rows: DataFrame) -> DataFrame:
    """Where the first characters of the first sentence stand in the raw text: 3, 2, 4, 2, 3 and 3 of them."""
    first = document.sentences_at(sentences(rows), rows.select("req_id", F.lit(0).alias("m"), F.lit(0).alias("s"), "k")).select("req_id", "k").join(sentences(rows).where("s = 0"), "req_id")
    own = {c: F.col(c) for c in ("text", "raw", "lead", "offsets")}
    end = F.get(F.array(*map(F.lit, (3, 2, 4, 2, 3, 3))), F.col("k"))
    a, b = document.raw_bounds(own, F.lit(0), end)
    return first.select("req_id", a.alias("raw_start"), b.alias("raw_end"), document.raw_span(own, F.lit(0), end).alias("piece"))


@cases({"n_messages": "BIGINT", "last": "VARCHAR", "n_context": "BIGINT", "first": "BIGINT", "n": "BIGINT", "whole": "VARCHAR"}, [
    ("a。b\n\nc", [(2, "c", 1, 2, 1, "a。\nb\nc")]), ("only one", [(1, "only one", 0, 1, 0, "only one")]), ("x!\n \ny?z;w\n\nlast", [(3, "last", 2, 1, 3, "x!\ny?\nz;\nw\nlast")]),
])
def forwarded(rows: DataFrame) -> DataFrame:
    """Pasted conversations: messages, the last one, the context, the sentences of message 1 and the whole document."""
    messages = document.split_forwarded(rows, "req_id", "text")
    found = document.sentences_of(document.analysed_messages(messages))
    context = document.context(messages).groupBy("req_id").agg(F.count("*").alias("n_context"))
    counts = messages.groupBy("req_id").agg(F.count("*").alias("n_messages")).join(document.latest(messages).withColumnRenamed("text", "last"), "req_id").join(context, "req_id", "left").fillna(0, ["n_context"])
    return counts.join(document.message_range(found, 1), "req_id").join(document.document_text(found).withColumnRenamed("text", "whole"), "req_id")


@cases({"simplified": "BOOLEAN", "marker": "BOOLEAN", "found": "VARCHAR", "masked": "VARCHAR"}, [
    ("请将验证码发给客服", [(True, False, "", "请将验证码发给客服")]), ("这里多少錢", [(False, False, "", "这里多少錢")]), ("加 LINE 領錢 www.a.com/x", [(False, True, "領", "加 LINE 領錢 ")]), ("這檔穩賺 驗證後領", [(False, True, "領、驗證", "這檔穩賺 驗證後領")]), ("", [(False, False, "", "")]),
])
def lexicon_tests(rows: DataFrame) -> DataFrame:
    """Simplified script, marker words, words found in code-point order, links masked."""
    t = F.col("text")
    return rows.select("req_id", reporting.is_simplified(t).alias("simplified"), feeds.has_scam_marker(t).alias("marker"), F.array_join(text.found_words(t, ["驗證", "領"]), "、").alias("found"), F.regexp_replace(t, text.URL, "").alias("masked"))


# ---------------------------------------------------------------- evasion, quotation

_VARIANTS = (("婍", "期"),)


@cases({"name": "VARCHAR", "detail": "VARCHAR", "n_evidence": "BIGINT"}, [
    ("請提​供", [("evasion_invisible", "原文含 1 個不可見字元：U+200B ×1", 1)]), ("Ａpple 特價", [("evasion_width_mix", "同一 token 內全形與半形混用：Ａpple", 1)]),
    ("請給我驗 證 碼", [("evasion_split_word", "目標詞被插入分隔字元拆開：驗證碼 被寫成「驗 證 碼」", 1)]), ("你ㄉ帳戶。他ㄟ錢", [("evasion_zhuyin", "注音符號夾在漢字之間：ㄉ、ㄟ", 2)]), ("今天天氣好", []),
    ("１2點見", [("evasion_width_mix", "同一 token 內全形與半形混用：１2點見", 1)]), ("長婍投資", [("evasion_homophone", "同音或形近變體：婍（應為期）", 1)]), ("﻿你好", []), ("https://ａb.com/１2", []), ("a­b⁠。c­", [("evasion_invisible", "原文含 1 個不可見字元：U+2060 ×1", 1)]),
])
def evasion_signals(rows: DataFrame) -> DataFrame:
    """The five evasion checks on inputs that they catch and inputs that they must leave alone."""
    return evasion.evasion_signals(sentences(rows), CATALOGUE, 0, _VARIANTS).select("req_id", "name", "detail", F.size("evidence").alias("n_evidence"))


@cases({"detail": "VARCHAR", "n_evidence": "BIGINT"}, [
    ("他說「一二三四五六七八」嗎", [("命中 2 類引述標記：引號、來源歸屬；具體標記：一二三四五六七八、他說", 1)]), ("「短」而已", []), ("「外『內內內內內內內』外」。好", [("命中 1 類引述標記：引號；具體標記：外『內內內內內內內』外", 1)]),
    ("轉傳給大家。請勿受騙", [("命中 2 類引述標記：轉傳格式、宣導框架；具體標記：請勿受騙、轉傳", 2)]), ("上午10:20 你好\n下午3:05 在嗎", [("命中 1 類引述標記：轉傳格式；具體標記：時間戳行", 2)]), ("10:20 你好", []), ("今天很好", []),
])
def quotation_marks(rows: DataFrame) -> DataFrame:
    """Quotes of eight characters, attributions, forwards, time stamps, warnings."""
    messages = rows.select("req_id", F.lit(0).alias("msg_idx"), "text")
    return quotation.quotation_signals(sentences(rows), messages, 0).select("req_id", "detail", F.size("evidence").alias("n_evidence"))


# ---------------------------------------------------------------- links

SUFFIXES = urls.Suffixes.parse(
    "// ===BEGIN ICANN DOMAINS===\ncom\ntw\ncom.tw\norg\nzip\n*.ck\n!www.ck\n台灣\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nwixsite.com\n// ===END PRIVATE DOMAINS===\n"
)


@cases({"url": "VARCHAR", "host": "VARCHAR", "domain": "VARCHAR", "is_ip": "BOOLEAN", "userinfo": "BOOLEAN", "scheme": "BOOLEAN"}, [
    ("看 https://WWW.Example.com/a?b=1。好", [("https://example.com/a?b=1", "example.com", "example.com", False, False, True)]), ("（https://a.b.com.tw/x(1)）", [("https://a.b.com.tw/x(1)", "a.b.com.tw", "b.com.tw", False, False, True)]),
    ("http://user@10.0.0.1:8080/p", [("http://10.0.0.1:8080/p", "10.0.0.1", None, True, True, True)]), ("請上evil.org/x, 或 file.zip", [("evil.org/x", "evil.org", "evil.org", False, False, False)]), ("http://[2001:db8::1]/a", [("http://[2001:db8::1]/a", "2001:db8::1", None, True, False, True)]),
    ("me@mail.com", []), ("http://bücher.com/", [("http://xn--bcher-kva.com/", "xn--bcher-kva.com", "xn--bcher-kva.com", False, False, True)]), ("see https://shop.com.tw點我", [("https://shop.com.tw", "shop.com.tw", "shop.com.tw", False, False, True)]),
    ("https://x.me.wixsite.com!!", [("https://x.me.wixsite.com", "x.me.wixsite.com", "me.wixsite.com", False, False, True)]), ("ｈｔｔｐｓ：／／ａ．ｃｏｍ", [("https://a.com", "a.com", "a.com", False, False, True)]), ("http://www.ck/ 與 http://a.b.ck", [("http://ck/", "ck", None, False, False, True), ("http://a.b.ck", "a.b.ck", "a.b.ck", False, False, True)]), ("no link", []),
])
def link_extraction(rows: DataFrame) -> DataFrame:
    """Links as sentences hold them: brackets, punctuation, glued words, user information, addresses, international names."""
    found = urls.extract_urls(sentences(rows), SUFFIXES)
    return found.select("req_id", "url", "host", F.col("registrable_domain").alias("domain"), "is_ip", F.col("has_userinfo").alias("userinfo"), F.col("scheme_present").alias("scheme"))


@cases({"detail": "VARCHAR"}, [
    ("http://10.0.0.1/a", [("連結 http://10.0.0.1/a 的主機為 IP 位址 10.0.0.1，不是網域名稱",)]), ("https://bank.com@evil.com/", [("連結 https://evil.com/ 的實際主機為 evil.com，`@` 之前的部分位於使用者資訊欄位而不是主機",)]),
    ("https://аpple.com/", [("連結 https://xn--pple-43d.com/ 的主機 аpple.com 混用拉丁與西里爾字母",)]), ("https://ok.com/", []), ("http://u@192.168.0.9/", [("連結 http://192.168.0.9/ 的主機為 IP 位址 192.168.0.9，不是網域名稱",), ("連結 http://192.168.0.9/ 的實際主機為 192.168.0.9，`@` 之前的部分位於使用者資訊欄位而不是主機",)]),
])
def host_shapes(rows: DataFrame) -> DataFrame:
    """Odd hosts: addresses, user information, mixed scripts."""
    return urls.shape_signals(urls.extract_urls(sentences(rows), SUFFIXES), 0).select("req_id", "detail")


@cases({"suffix": "VARCHAR", "domain": "VARCHAR"}, [
    ("a.b.example.com", [("com", "example.com")]), ("com", [("com", None)]), ("x.com.tw", [("com.tw", "x.com.tw")]), ("a.b.c.ck", [("c.ck", "b.c.ck")]), ("www.ck", [("ck", "www.ck")]), ("me.wixsite.com", [("wixsite.com", "me.wixsite.com")]),
    ("a.unknown", [("unknown", "a.unknown")]), ("", [(None, None)]), ("xn--kpry57d", [("xn--kpry57d", None)]), ("10.0.0.1", [("1", None)]),
])
def suffix_rules(rows: DataFrame) -> DataFrame:
    """Public suffixes: exceptions before wildcards, unknown names by their last label, encoded names."""
    found = urls.registrable_domains(rows.select(F.col("text").alias("host")).distinct(), SUFFIXES.frame(rows.sparkSession))
    return rows.join(found, rows["text"] == found["host"]).select("req_id", "suffix", F.col("registrable_domain").alias("domain"))


@cases({"hit": "BOOLEAN", "indeterminate": "BOOLEAN", "detail": "VARCHAR"}, [
    ("https://new.com/", [(True, False, "網域 new.com 註冊於 2024-05-20，距今 12 天")]), ("https://old.com/", []), ("https://lost.com/", [(False, True, "網域 lost.com 的註冊日期無法取得")]), ("https://svc.com/", []), ("https://none.com/", [(False, True, "網域 none.com 的註冊日期無法取得")]),
])
def domain_ages(rows: DataFrame) -> DataFrame:
    """Young domains, unknown ages, shorteners."""
    spark = rows.sparkSession
    ages = spark.createDataFrame([("new.com", "KNOWN", "2024-05-20"), ("old.com", "KNOWN", "2001-01-01"), ("lost.com", "FAILED", None)], "domain string, outcome string, registered_on string").withColumn("registered_on", F.to_date("registered_on"))
    short = spark.createDataFrame([("svc.com", "svc")], "domain string, service string")
    return urls.age_signals(urls.by_domain(urls.extract_urls(sentences(rows), SUFFIXES)), ages, short, "2024-06-01", 0).select("req_id", "hit", "indeterminate", "detail")


# ---------------------------------------------------------------- personal data


@cases({"text": "VARCHAR", "tw_id": "BIGINT", "tw_mobile": "BIGINT", "tw_landline": "BIGINT", "credit_card": "BIGINT"}, [
    ("我的電話0912-345-678", [("我的電話<TW_MOBILE>", 0, 1, 0, 0)]), ("市話 02-2345-6789", [("市話 <TW_LANDLINE>", 0, 0, 1, 0)]), ("卡號 4111 1111 1111 1111", [("卡號 <CREDIT_CARD>", 0, 0, 0, 1)]), ("卡號 4111 1111 1111 1112", [("卡號 4111 1111 1111 1112", 0, 0, 0, 0)]),
    ("身分證 A123456789", [("身分證 <TW_ID>", 1, 0, 0, 0)]), ("A123456788", [("A123456788", 0, 0, 0, 0)]), ("見 https://x.com/0912345678 即可", [("見 https://x.com/0912345678 即可", 0, 0, 0, 0)]), ("無", [("無", 0, 0, 0, 0)]),
    ("4111111111111111 與 0912345678", [("<CREDIT_CARD> 與 <TW_MOBILE>", 0, 1, 0, 1)]), ("6011000990139424", [("6011000990139424", 0, 0, 0, 0)]), ("(02)2345-6789。0912 345 678", [("<TW_LANDLINE>。", 0, 0, 1, 0), ("<TW_MOBILE>", 0, 1, 0, 0)]), ("09123456789", [("09123456789", 0, 0, 0, 0)]),
])
def personal_data(rows: DataFrame) -> DataFrame:
    """Redacted sentences with counts, as many as came in; links, wrong checksums and longer digit runs stay."""
    return redact.redacted(sentences(rows))


@cases({"violations": "BIGINT", "markup": "VARCHAR"}, [
    ("打0912-345-678 & <我>", [(0, '打<mark class="personal" title="手機號碼">0912-345-678<span class="kind">手機號碼</span></mark> &amp; &lt;我&gt;')]), ("無", [(0, "無")]), ("A123456789", [(0, '<mark class="personal" title="身分證字號">A123456789<span class="kind">身分證字號</span></mark>')]),
])
def highlights(rows: DataFrame) -> DataFrame:
    """Marked personal data, and what redaction must never do: lose a sentence, empty one, change a link."""
    found = sentences(rows)
    bad = redact.redaction_violations(found)
    marked = found.select("req_id", "text", redact.spans(F.col("text")).alias("spans")).select("req_id", presentation.highlighted(F.col("text"), F.col("spans")).alias("markup"))
    return marked.join(bad, "req_id", "left").select("req_id", F.coalesce("violations", F.lit(0)).alias("violations"), "markup")


# ---------------------------------------------------------------- answers of a language model


def _answer(**changes) -> str:
    return json.dumps({"analysis_notes": "n", "evidence_sentence_ids": [[0, 0]], "category_165": "假投資", "label": "scam"} | changes, ensure_ascii=False)


ANSWERS = [
    (_answer(), [("ok", "scam", "FAKE_INVESTMENT", 1, 2)]), (_answer(label="suspicious", category_165=None, evidence_sentence_ids=[[0, 1], [0, 0], [0, 1]]), [("ok", "suspicious", None, 2, 1)]), (_answer(label="not_scam", category_165=None, evidence_sentence_ids=[]), [("ok", "not_scam", None, 0, 0)]),
    ("not json", [("malformed", None, None, None, None)]), (_answer(extra=1), [("malformed", None, None, None, None)]), (_answer(evidence_sentence_ids=[[0, 9]]), [("out_of_window", None, None, None, None)]), (_answer(evidence_sentence_ids=[[0]]), [("malformed", None, None, None, None)]),
    (_answer(evidence_sentence_ids=[[0, True]]), [("malformed", None, None, None, None)]), (_answer(label="maybe"), [("malformed", None, None, None, None)]), (_answer(category_165="其他"), [("malformed", None, None, None, None)]), (_answer(evidence_sentence_ids=[]), [("inconsistent", None, None, None, None)]), (_answer(label="not_scam"), [("inconsistent", None, None, None, None)]),
]


def _judged(rows: DataFrame) -> DataFrame:
    window = sentences(rows.withColumn("text", F.lit("一。二")))
    return replay.validated(rows.select("req_id", F.col("text").alias("raw")), window)


@cases({"outcome": "VARCHAR", "label": "VARCHAR", "category": "VARCHAR", "n_evidence": "BIGINT", "rank": "BIGINT"}, ANSWERS)
def model_answers(rows: DataFrame) -> DataFrame:
    """Outcome of stored answers: keys in order, pairs of integers inside the window, known labels and categories, consistency."""
    return _judged(rows).select("req_id", "outcome", "label", "category", F.when(F.col("evidence").isNotNull(), F.size("evidence")).alias("n_evidence"), F.when(F.col("label").isNotNull(), replay.label_rank(F.col("label"))).alias("rank"))


def model_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each outcome occurs, and the share of failures."""
    counts = replay.outcome_counts(_judged(chosen(spark, sf_dir, [x for x, _ in ANSWERS])))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


QUERIES["model_outcomes"] = model_outcomes
_OUT = ", ".join(f"({i}, '{rows[0][0]}')" for i, (_, rows) in enumerate(ANSWERS))
ORACLES["model_outcomes"] = f"""SELECT o.outcome, count(d.doc_id) AS n, round(count(d.doc_id) / (SELECT count(*) FROM documents)::DOUBLE, 6)::DOUBLE AS share
  FROM (VALUES ('ok'), ('malformed'), ('out_of_window'), ('inconsistent')) AS o(outcome) LEFT JOIN (VALUES {_OUT}) AS v(k, outcome) ON v.outcome = o.outcome LEFT JOIN documents d ON d.doc_id % {len(ANSWERS)} = v.k GROUP BY o.outcome"""


@cases({"name": "VARCHAR", "hit": "BOOLEAN", "indeterminate": "BOOLEAN", "types": "VARCHAR"}, [
    (raw, [("llm_scam" if rows[0][1] == "scam" else "llm_suspicious", rows[0][0] == "ok", rows[0][0] != "ok", rows[0][2] or "")] if rows[0][1] != "not_scam" else []) for raw, rows in ANSWERS
])
def model_signals(rows: DataFrame) -> DataFrame:
    """Signals of usable answers; failed ones are indeterminate, the weakest label is none."""
    return replay.model_signals(_judged(rows), 0).select("req_id", "name", "hit", "indeterminate", F.array_join("scam_types", ",").alias("types"))


@cases({"stops_at": "BIGINT"}, [
    ("有 2 項", [(None,)]), ("有 3 項", [(3,)]), ("請打 165 查證", [(None,)]), ("請打 166", [(6,)]), ("見 http://x", [(6,)]), ("這是假檢警", [(5,)]), ("這是假投資", [(None,)]), ("", [(None,)]), ("www.16", [(4,)]), ("1655", [(4,)]),
])
def stream_guard(rows: DataFrame) -> DataFrame:
    """Where a streamed answer is cut: numbers that were not found, links, categories that were not named."""
    numbers = prompting.allowed_numbers(F.array(F.lit("命中 2 項"), F.lit("撥打 165")))
    types = prompting.allowed_types(F.lit("假投資"), F.array(F.array(F.lit("假投資"))))
    return rows.select("req_id", prompting.first_violation(F.col("text"), numbers, F.array_except(F.array(F.lit("假檢警"), F.lit("假投資")), types)).alias("stops_at"))


# ---------------------------------------------------------------- dates, registry answers, evidence lines


@cases({"month": "VARCHAR", "month_end": "VARCHAR", "slash": "VARCHAR", "compact": "VARCHAR", "http": "VARCHAR", "minutes": "BIGINT"}, [
    ("11309|2024/09/30|20240930|Wed, 02 Oct 2024 10:00:00 GMT|下午3:05", [("2024-09", "2024-09-30", "2024-09-30", "2024-09-30", "2024-10-02", 905)]), ("11302|2024/2/9|20240209|Fri, 09 Feb 2024 23:59:59 GMT|上午12:10", [("2024-02", "2024-02-29", "2024-02-09", "2024-02-09", "2024-02-09", 10)]),
    ("10012|2011/12/01|20111201|Thu, 01 Dec 2011 00:00:00 GMT|23:59", [("2011-12", "2011-12-31", "2011-12-01", "2011-12-01", "2011-12-01", 1439)]),
])
def list_dates(rows: DataFrame) -> DataFrame:
    """Dates as the lists write them."""
    f = lambda i: F.get(F.split("text", r"\|"), F.lit(i))
    month = snapshots.roc_month(f(0))
    slash = F.date_format(F.to_date(f(1), "yyyy/M/d"), "yyyy-MM-dd")
    return rows.select("req_id", month.alias("month"), snapshots.month_end(month).alias("month_end"), slash.alias("slash"), snapshots.compact_date(f(2)).alias("compact"), snapshots.http_date(f(3)).alias("http"), snapshots.minutes_of(f(4)).alias("minutes"))


@cases({"outcome": "VARCHAR", "registered_on": "VARCHAR"}, [
    ('{"events":[{"eventAction":"registration","eventDate":"2024-05-20T23:30:00Z"}]}', [("KNOWN", "2024-05-20")]), ('{"events":[{"eventAction":"expiration","eventDate":"2030-01-01"}]}', [("NO_DATA", None)]), ('{"events":[{"eventAction":"registration","eventDate":"soon"}]}', [("NO_DATA", None)]), ("{}", [("NO_DATA", None)]),
    ('{"events":[{"eventAction":"last changed","eventDate":"2024-01-01"},{"eventAction":"registration","eventDate":"2020-02-03"}]}', [("KNOWN", "2020-02-03")]),
])
def registry_answers(rows: DataFrame) -> DataFrame:
    """The registration day that a registry's answer names."""
    r = presentation.registration(F.col("text"))
    return rows.select("req_id", r["outcome"].alias("outcome"), r["registered_on"].alias("registered_on"))


@cases({"title": "VARCHAR", "notes": "VARCHAR", "quote": "VARCHAR", "masked": "VARCHAR", "speculative": "BOOLEAN", "claims": "BOOLEAN", "verifiable": "BOOLEAN"}, [
    ("索取簡訊驗證碼；事實：不得轉交：「請給我驗證碼」", [("索取簡訊驗證碼", "事實：不得轉交", "請給我驗證碼", "索取簡訊驗證碼", False, False, True)]), ("連結 https://a.com/x 的分數 90%；註", [("連結 https://a.com/x 的分數 90%", "註", None, "連結 [網址已省略] 的分數 [比率已省略]", False, False, True)]),
    ("這是詐騙，很可能", [("這是詐騙，很可能", "", None, "這是詐騙，很可能", True, True, False)]), ("保證獲利", [("保證獲利", "", None, "保證獲利", False, False, False)]),
])
def evidence_lines(rows: DataFrame) -> DataFrame:
    """Parts of evidence lines, masked titles, and whether a reader can check them."""
    p, q = presentation.evidence_parts(F.col("text")), presentation.line_qualities(F.col("text"))
    return rows.select("req_id", p["title"].alias("title"), F.array_join(p["notes"], "；").alias("notes"), p["quote"].alias("quote"), presentation.masked_title(F.col("text")).alias("masked"), q["speculative"].alias("speculative"), q["claims"].alias("claims"), q["verifiable"].alias("verifiable"))


@cases({"msg": "BIGINT", "day": "VARCHAR", "clock": "VARCHAR", "sender": "VARCHAR", "text": "VARCHAR"}, [
    ("[LINE] 與阿明的聊天記錄\n儲存日期：2024/01/05\n\n2024/01/03（三）\n上午10:20\t阿明\t你好\n第二行\n下午3:05\t我\t嗨\n2024/01/04（四）\n上午9:00\t阿明\t早", [(1, "2024/01/03", "上午10:20", "阿明", "你好\n第二行"), (2, "2024/01/03", "下午3:05", "我", "嗨"), (3, "2024/01/04", "上午9:00", "阿明", "早")]), ("沒有訊息", []),
])
def chat_exports(rows: DataFrame) -> DataFrame:
    """Messages of exported chats, one export a document."""
    lines = rows.select("req_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return snapshots.chat_export(lines, "req_id").withColumnRenamed("file", "req_id")


@cases({"host": "VARCHAR"}, [
    ("https://u:p@WWW.Evil.com:8080/a?b#c", [("evil.com",)]), ("evil.org/path", [("evil.org",)]), ("http://a.b.c", [("a.b.c",)]), ("ftp://x.y.", [("x.y",)]), ("m.site.com:443", [("m.site.com",)]),
])
def feed_hosts(rows: DataFrame) -> DataFrame:
    """Hosts that feeds' addresses name."""
    return rows.select("req_id", feeds.host_of(F.col("text")).alias("host"))

"""Document, clause and rule queries over ``conversations`` and ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions import text
from shoalwater.operators import document, evaluate, redact, rules

#: The defaults; only ``conversation_truncation`` shows smaller ones at work.
LIMITS = document.Limits()
SMALL = document.Limits(4, 600)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("req_id"), F.col("turn").cast("int").alias("msg_idx"), F.col("role").alias("sender"), "text")


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests of one message."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("req_id"), F.lit(0).alias("msg_idx"), F.lit(None).cast("string").alias("sender"), "text")


def catalogue() -> rules.Catalogue:
    """A small catalogue of words that occur in the test tables; the zh-TW catalogue never matches them."""
    made = (
        rules.Rule("solicit_otp", "asks for a code", ("with", "avec"), ("the", "les"), ("that", "que"), types=("ACCOUNT_TAKEOVER",), hard=True, fact="codes are never asked for"),
        rules.Rule("safe_account", "names an account", ("nicht", "and"), (), ("der", "this"), types=("FAKE_AUTHORITY",), hard=True, fact="no such account exists"),
        rules.Rule("secrecy_demand", "demands secrecy", ("is", "para"), (), ("by",), types=("FAKE_AUTHORITY",), negative=True, hard=True, fact="no office demands it"),
        rules.Rule("guaranteed_return", "promises a return", ("was", "pour"), context=("to", "dans"), types=("FAKE_INVESTMENT",)),
        rules.Rule("identity_docs", "asks for documents", ("are", "por"), ("of",), types=("FAKE_JOB", "PHISHING_LINK")),
        rules.Rule("loan_no_check", "offers a loan", ("have", "mit"), types=("FAKE_LOAN",)),
    )
    kinds = (("first", ("onea", "eau")), ("second", ("inea", "tre")), ("third", ("hent", "oi")))
    return rules.Catalogue(made, negators=("not", "or ", "ne ", "un "), imperative=("in ", "et "), other_directed=("anti", "onou"), relationship=kinds)


MARKERS = {"attribution": ["hand", "ment"], "forward": ["shor"], "awareness": ["blethe", "eauai"]}

# ---------------------------------------------------------------- SQL

_SENTENCES = r"""
msg AS (SELECT conv_id AS req_id, CAST(turn AS INTEGER) AS m, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY m DESC) AS rk,
         sum(n) OVER (PARTITION BY req_id ORDER BY m DESC ROWS UNBOUNDED PRECEDING) AS total FROM msg),
marked AS (SELECT *, rk <= {messages} AND (total <= {chars} OR rk = 1) AS keep FROM ranked),
req AS (SELECT req_id, count(*) AS n_messages, sum(CASE WHEN keep THEN 0 ELSE 1 END)::BIGINT AS dropped FROM marked GROUP BY req_id),
cut AS (
  SELECT req_id, m, list_filter(list_transform(string_split(regexp_replace(text, '([。!?;]+)', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM marked WHERE keep),
sent AS (SELECT req_id, m, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS s, unnest(parts) AS text FROM cut)
"""
SENTENCES, SMALL_SENTENCES = (_SENTENCES.replace("{messages}", str(x.max_messages)).replace("{chars}", str(x.max_chars)) for x in (LIMITS, SMALL))
DOC_SENTENCES = r"""
cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([。!?;]+)', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM documents),
sent AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS s, unnest(parts) AS text FROM cut)
"""
CLAUSES = "list_filter(list_transform(string_split_regex(text, '[,:]'), lambda x: trim(x)), lambda x: x <> '')"


def sql_any(column: str, words) -> str:
    return "(" + (" OR ".join(f"contains({column}, '{w}')" for w in words) or "false") + ")"


def sql_strength(rule: rules.Rule, cat: rules.Catalogue) -> str:
    """The strength of one rule for a clause ``c`` of a sentence ``text``."""
    def state(w: str) -> str:
        negated = sql_any(f"substr(c, 1, strpos(c, '{w}') - 1)", cat.negators)
        return f"(contains(c, '{w}') AND {'' if rule.negative else 'NOT '}{negated})"

    tests = ["(" + " OR ".join(map(state, rule.predicates)) + ")", f"NOT {sql_any('c', cat.other_directed)}"]
    if rule.objects:
        tests.append(sql_any("c", rule.objects))
    if rule.context:
        tests.append(sql_any("text", rule.context))
    level = "2"
    if rule.receivers:
        weak = "0" if rule.negative else f"CASE WHEN {sql_any('c', cat.imperative)} THEN 1 ELSE 0 END"
        level = f"CASE WHEN {sql_any('c', rule.receivers)} THEN 2 ELSE {weak} END"
    return f"CASE WHEN {' AND '.join(tests)} THEN {level} ELSE 0 END"


def hits_sql(cat: rules.Catalogue, sentences: str | None = None) -> str:
    """CTEs up to ``hit`` (req_id, m, s, rule, level, single)."""
    each = "\n  UNION ALL\n  ".join(f"SELECT req_id, m, s, n, {i} AS rule, {sql_strength(r, cat)} AS level FROM clause" for i, r in enumerate(cat.rules))
    return f"""{sentences or SENTENCES},
clause AS (SELECT req_id, m, s, text, len(p) AS n, unnest(p) AS c FROM (SELECT *, {CLAUSES} AS p FROM sent)),
lev AS ({each}),
hit AS (SELECT req_id, m, s, rule, max(level) AS level, max(n) <= 1 AS single FROM lev WHERE level > 0 GROUP BY ALL)"""


CODE_SQL = r"""
code AS (
  SELECT req_id, m, arg_min(code, s) AS code FROM (
    SELECT req_id, m, s, nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{4,8})(?:[^0-9]|$)', 1), '') AS code FROM sent) WHERE code IS NOT NULL GROUP BY req_id, m)"""


# ---------------------------------------------------------------- queries


def message_norm_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised length and flags of every document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.normalised(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("doc_id", F.length("t").alias("norm_len"), F.array_join(evaluate.message_flags(F.col("t")), ",").alias("flags"))


def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and characters of every document."""
    found = document.sentences_of(document.analysed_messages(doc_messages(spark, sf_dir), document.Limits(100, 10**9)))
    return found.groupBy(F.col("req_id").alias("doc_id")).agg(F.count("*").alias("n_sentences"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("longest"))


def conversation_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the limits drop of every conversation."""
    return document.requests_of(document.analysed_messages(messages(spark, sf_dir), SMALL))


def prompt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest sentences that fit a prompt."""
    found = document.sentences_of(document.analysed_messages(messages(spark, sf_dir), LIMITS))
    return document.prompt_window(found, 5, 400).groupBy("req_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("text")).alias("n_chars"), F.min(F.col("m") * 1000 + F.col("s")).alias("first"))


def clause_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of documents with a predicate, plain or after a negator."""
    cat = catalogue()
    found = document.sentences_of(document.analysed_messages(doc_messages(spark, sf_dir), document.Limits(100, 10**9)))
    each = found.select(F.col("req_id").alias("doc_id"), F.explode(text.clauses(F.col("text"))).alias("c"))
    plain, negated = (text.predicate_with_negation(F.col("c"), ("with", "avec", "mit"), cat.negators, n) for n in (False, True))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.count_if(plain).alias("n_plain"), F.count_if(negated).alias("n_negated"))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of every rule that a sentence matches."""
    found = document.sentences_of(document.analysed_messages(messages(spark, sf_dir), LIMITS))
    names = F.array(*(F.lit(r.name) for r in catalogue().rules))
    return rules.clause_hits(found, catalogue()).select("req_id", "m", "s", F.get(names, F.col("rule")).alias("name"), "level", "single")


def rule_hits_by_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule signals: hardness and evidence by message."""
    found = document.sentences_of(document.analysed_messages(messages(spark, sf_dir), LIMITS))
    rows = rules.rule_signals(found, catalogue())
    return rows.select("req_id", "name", (F.col("ord") % rules.STRIDE).cast("int").alias("m"), "hard", F.size("evidence").cast("long").alias("n_evidence"), F.array_join("scam_types", ",").alias("types"))


def cross_sentence_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where two kinds of words occur in two sentences."""
    found = document.sentences_of(document.analysed_messages(doc_messages(spark, sf_dir), document.Limits(100, 10**9)))
    rows = rules.cooccurrence(found, catalogue().relationship)
    return rows.select(F.col("req_id").alias("doc_id"), F.size("evidence").cast("long").alias("n_evidence"))


def self_contained_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first code of four to eight digits in every document that has one."""
    found = document.sentences_of(document.analysed_messages(doc_messages(spark, sf_dir), document.Limits(100, 10**9)))
    return rules.message_codes(found).select(F.col("req_id").alias("doc_id"), "code")


def pii_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare 16-digit numbers in documents, and how many pass the checksum with a known issuer."""
    runs = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda d: F.length(d) == 16)
    rows = table(spark, sf_dir, "documents").select("doc_id", runs.alias("d"))
    ok = F.filter("d", lambda d: F.regexp_like(d, F.lit("^(?:4|5[1-5]|34|37|35)")) & F.call_function("luhn_check", d))
    return rows.where(F.size("d") > 0).select("doc_id", F.size("d").cast("long").alias("n_numbers"), F.size(ok).cast("long").alias("n_cards"))


def pii_redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted kinds in every document."""
    found = document.sentences_of(document.analysed_messages(doc_messages(spark, sf_dir), document.Limits(100, 10**9)))
    return redact.redaction_counts(found).withColumnRenamed("req_id", "doc_id")


def redacted_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with personal data, placeholders in place of it."""
    found = document.sentences_of(document.analysed_messages(doc_messages(spark, sf_dir), document.Limits(100, 10**9)))
    rows = redact.redacted(found)
    return rows.where(F.greatest(*(k.lower() for k in redact.KINDS)) > 0).withColumnRenamed("req_id", "doc_id")


def _luhn_sql(d: str) -> str:
    return f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST({d}[i] AS INTEGER) ELSE CASE WHEN CAST({d}[i] AS INTEGER) > 4 THEN 2 * CAST({d}[i] AS INTEGER) - 9 ELSE 2 * CAST({d}[i] AS INTEGER) END END)) % 10 = 0"


QUERIES = {
    f.__name__: f
    for f in (
        message_norm_len, sentence_split_counts, conversation_truncation, prompt_window, clause_negation, rule_hits, rule_hits_by_message, cross_sentence_cooccurrence, self_contained_code, pii_card_luhn,
        pii_redaction_counts, redacted_sentences,
    )
}

_CAT = catalogue()
_NAMES = "[" + ", ".join(f"'{r.name}'" for r in _CAT.rules) + "]"
_KINDS = " UNION ALL ".join(f"SELECT doc_id, s, '{k}' AS kind FROM sent WHERE {sql_any('text', w)}" for k, w in _CAT.relationship)
ORACLES = {
    "message_norm_len": r"""SELECT doc_id, length(t) AS norm_len, concat_ws(',',
      CASE WHEN regexp_matches(t, 'https?://[^ \t\n]|www\.[^ \t\n]') AND length(regexp_replace(regexp_replace(t, 'https?://[^ \t\n\r]+|www\.[^ \t\n\r]+', '', 'g'), '[ \t\n\r]+', '', 'g')) < 10 THEN 'url_only' END,
      CASE WHEN starts_with(t, '[LINE]') THEN 'line_export' END, CASE WHEN length(t) < 8 THEN 'too_short' END, CASE WHEN length(t) > 2000 THEN 'too_long' END) AS flags
      FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)""",
    "sentence_split_counts": f"WITH {DOC_SENTENCES} SELECT doc_id, count(*) AS n_sentences, sum(length(text))::BIGINT AS n_chars, max(length(text)) AS longest FROM sent GROUP BY doc_id",
    "conversation_truncation": f"WITH {SMALL_SENTENCES} SELECT req_id, n_messages, dropped, dropped > 0 AS truncated FROM req",
    "prompt_window": f"""WITH {SENTENCES}, w AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY m DESC, s DESC) AS k,
      sum(length(text)) OVER (PARTITION BY req_id ORDER BY m DESC, s DESC ROWS UNBOUNDED PRECEDING) AS size FROM sent)
      SELECT req_id, count(*) AS n_sentences, sum(length(text))::BIGINT AS n_chars, min(m * 1000 + s) AS first FROM w WHERE k <= 5 AND (size <= 400 OR k = 1) GROUP BY req_id""",
    "clause_negation": f"""WITH {DOC_SENTENCES}, e AS (SELECT doc_id, unnest({CLAUSES}) AS c FROM sent)
      SELECT doc_id, count(*) AS n_clauses,
      count(*) FILTER ({" OR ".join(f"(contains(c, '{w}') AND NOT {sql_any(f"substr(c, 1, strpos(c, '{w}') - 1)", _CAT.negators)})" for w in ("with", "avec", "mit"))}) AS n_plain,
      count(*) FILTER ({" OR ".join(f"(contains(c, '{w}') AND {sql_any(f"substr(c, 1, strpos(c, '{w}') - 1)", _CAT.negators)})" for w in ("with", "avec", "mit"))}) AS n_negated FROM e GROUP BY doc_id""",
    "rule_hits": f"WITH {hits_sql(_CAT)} SELECT req_id, m, s, {_NAMES}[rule + 1] AS name, level, single FROM hit",
    "rule_hits_by_message": f"""WITH {hits_sql(_CAT)}, {CODE_SQL} SELECT h.req_id, {_NAMES}[rule + 1] AS name, h.m, bool_or(level = 2) AND bool_and(rule <= 2) AND NOT (bool_or(code IS NOT NULL) AND bool_or(rule IN (0, 2))) AS hard,
      count(*) AS n_evidence, ['ACCOUNT_TAKEOVER', 'FAKE_AUTHORITY', 'FAKE_AUTHORITY', 'FAKE_INVESTMENT', 'FAKE_JOB,PHISHING_LINK', 'FAKE_LOAN'][rule + 1] AS types
      FROM hit h LEFT JOIN code c ON h.req_id = c.req_id AND h.m = c.m GROUP BY h.req_id, h.m, rule""",
    "cross_sentence_cooccurrence": f"WITH {DOC_SENTENCES}, k AS ({_KINDS}) SELECT doc_id, count(DISTINCT s) AS n_evidence FROM k GROUP BY doc_id HAVING count(DISTINCT kind) > 1 AND count(DISTINCT s) > 1",
    "self_contained_code": f"""WITH {DOC_SENTENCES} SELECT doc_id, arg_min(code, s) AS code FROM (
      SELECT doc_id, s, nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{4,8}})(?:[^0-9]|$)', 1), '') AS code FROM sent) WHERE code IS NOT NULL GROUP BY doc_id""",
    # Documents hold no Taiwanese numbers: only bare card numbers of known issuers can be found in them.
    "pii_redaction_counts": f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: CASE WHEN length(x) = 16 AND regexp_matches(x, '^(?:4|5[1-5]|34|37|35)') THEN {_luhn_sql("x")} ELSE false END) AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM ({"WITH " + DOC_SENTENCES + " SELECT DISTINCT doc_id FROM sent"})))
      SELECT doc_id, 0::BIGINT AS tw_id, 0::BIGINT AS tw_mobile, 0::BIGINT AS tw_landline, len(c)::BIGINT AS credit_card FROM d""",
    "redacted_sentences": f"""WITH {DOC_SENTENCES}, f AS (SELECT doc_id, s, text, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: CASE WHEN length(x) = 16 AND regexp_matches(x, '^(?:4|5[1-5]|34|37|35)') THEN {_luhn_sql("x")} ELSE false END) AS c FROM sent)
      SELECT doc_id, 0 AS m, s, list_reduce(list_concat([text], list_distinct(c)), lambda a, x: replace(a, x, '<CREDIT_CARD>')) AS text, 0 AS tw_id, 0 AS tw_mobile, 0 AS tw_landline, len(c)::INTEGER AS credit_card FROM f WHERE len(c) > 0""",
    "pii_card_luhn": f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 16) AS d FROM documents)
      SELECT doc_id, len(d) AS n_numbers, len(list_filter(d, lambda x: regexp_matches(x, '^(?:4|5[1-5]|34|37|35)') AND {_luhn_sql("x")})) AS n_cards FROM d WHERE len(d) > 0""",
}

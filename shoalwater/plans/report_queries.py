"""Report, sweep, prompt and projection queries, with their SQL.

Run records are those of ``evaluation_queries`` with the further columns of a
record set by a document's number, so that the reports, not the detector, are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.operators import document, evaluate, fuse, presentation, prompting, reporting, urls
from shoalwater.operators.replay import validated
from shoalwater.plans import evaluation_queries as base
from shoalwater.plans.evaluation_queries import _REC, _rate, records
from shoalwater.plans.fusion_queries import SIGNALS as FUSION
from shoalwater.plans.fusion_queries import WEIGHTS, detection
from shoalwater.plans.text_queries import SENTENCES, table
from shoalwater.plans.url_queries import SUFFIXES, page_messages
from shoalwater.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name with the same question in SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with every column of a run."""
    n = F.col("id").cast("long")
    rows = records(spark, sf_dir).withColumns({
        "scam_type": F.when(n % 4 == 0, "FAKE_JOB"), "contradicted": n % 6 == 0, "quotation_hit": n % 5 == 0, "blocklist_hit": n % 7 == 0, "truncated": n % 11 == 0,
        "hard_signals": F.when(n % 2 == 0, F.filter("hit_signals", lambda s: s == "safe_account")).otherwise(F.array().cast("array<string>")),
        "shadowed_signals": F.slice("hit_signals", F.lit(2), F.size("hit_signals") + 1), "speech_act_hits": F.size("hit_signals").cast("long"), "split": evaluate.split_of(F.col("id"), F.col("subset")),
    })
    return rows.withColumn("no_clause_hits", F.when(n % 3 == 0, F.col("speech_act_hits")).otherwise(F.lit(0)))


_FULL = f"""{_REC}, f0 AS (SELECT *, CAST(id AS BIGINT) AS n FROM r), f AS (
  SELECT *, CASE WHEN n % 4 = 0 THEN 'FAKE_JOB' END AS scam_type, n % 6 = 0 AS contradicted, n % 5 = 0 AS quotation_hit, n % 7 = 0 AS blocklist_hit, n % 11 = 0 AS truncated,
    CASE WHEN n % 2 = 0 THEN list_filter(hit_signals, lambda s: s = 'safe_account') ELSE [] END AS hard_signals, hit_signals[2:] AS shadowed_signals, len(hit_signals) AS speech_act_hits,
    CASE WHEN n % 3 = 0 THEN len(hit_signals) ELSE 0 END AS no_clause_hits, CASE WHEN CAST('0x' || substr(sha256(id), 1, 2) AS INTEGER) < 128 THEN 'tune' ELSE 'holdout' END AS split FROM f0)"""


@query(f"""WITH {_FULL} SELECT * FROM (
  SELECT 'type_output' AS metric, count(scam_type) AS num, count(*) AS den FROM f UNION ALL SELECT 'quotation_veto', count(*) FILTER (quotation_hit AND len(hard_signals) > 0), count(*) FROM f UNION ALL SELECT 'quotation', count(*) FILTER (quotation_hit), count(*) FROM f
  UNION ALL SELECT 'no_clause', sum(no_clause_hits)::BIGINT, sum(speech_act_hits)::BIGINT FROM f UNION ALL SELECT 'contradicted', count(*) FILTER (contradicted), count(*) FROM f WHERE label = 'scam' UNION ALL SELECT 'truncated', count(*) FILTER (truncated), count(*) FROM f)""")
def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a run names a category, is vetoed, quotes, finds no clause, contradicts itself, is truncated."""
    return reporting.run_rates(full_records(spark, sf_dir))


def _outcome(decided: str, abstained: str = "abstained") -> str:
    rate = lambda label, name: f"round(count(*) FILTER (label = '{label}' AND {decided}) / nullif(count(*) FILTER (label = '{label}'), 0)::DOUBLE, 6) AS {name}"
    return f"{rate('ham', 'false_positive')}, {rate('scam', 'recall')}, round(count(*) FILTER ({abstained}) / count(*)::DOUBLE, 6) AS abstention"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("value", *(F.round(c, 6).alias(c) for c in ("false_positive", "recall", "abstention")))


@query(f"WITH {_FULL} SELECT v.value::DOUBLE AS value, {_outcome('confidence >= 0.4 AND score + v.value >= 1.5')} FROM f, (VALUES (-1.0::DOUBLE), (0.0::DOUBLE), (0.5::DOUBLE), (2.0::DOUBLE)) AS v(value) GROUP BY v.value")
def prior_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes under four priors."""
    return _rounded(reporting.prior_sweep(full_records(spark, sf_dir), WEIGHTS, [-1.0, 0.0, 0.5, 2.0]))


@query(f"WITH {_FULL} SELECT v.value::DOUBLE AS value, {_outcome('confidence >= v.value AND score >= 1.5', 'confidence < v.value')} FROM f, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.95::DOUBLE)) AS v(value) GROUP BY v.value")
def floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes under four confidence floors."""
    return _rounded(reporting.threshold_sweep(full_records(spark, sf_dir), WEIGHTS, "confidence_floor", [0.1, 0.5, 0.6, 0.95]))


@query(f"""WITH {_FULL}, s AS (SELECT name, count(*) AS n FROM (SELECT DISTINCT id, unnest(shadowed_signals) AS name FROM f) GROUP BY name), h AS (SELECT name, count(*) AS n FROM (SELECT DISTINCT id, unnest(hit_signals) AS name FROM f) GROUP BY name)
  SELECT v.name, coalesce(s.n, 0) AS shadowed, coalesce(h.n, 0) AS hits FROM (VALUES {", ".join(f"('{n}')" for _, n in base.SIGNALS)}) AS v(name) LEFT JOIN s ON s.name = v.name LEFT JOIN h ON h.name = v.name""")
def shadowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each signal was outdone inside its group."""
    return reporting.shadowed_counts(full_records(spark, sf_dir), spark.createDataFrame([(n,) for _, n in base.SIGNALS], "name string"))


@query(f"WITH {_FULL} SELECT subset, round(avg(CASE WHEN score >= 1.0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS fire_rate FROM f GROUP BY subset")
def fire_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of scores at or above 1 by subset."""
    return reporting.fire_rate(full_records(spark, sf_dir), 1.0).select("subset", F.round("fire_rate", 6).alias("fire_rate"))


@query(f"WITH {_FULL} SELECT len(hit_signals) > 0 AS rule_hit, count(*) AS n, count(*) FILTER (score >= 1.5) AS fires, round(count(*) FILTER (score >= 1.5) / count(*)::DOUBLE, 6) AS rate FROM f WHERE label = 'scam' GROUP BY 1")
def classifier_given_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the classifier fires on scam with and without a rule hit."""
    return reporting.conditional_rates(full_records(spark, sf_dir), F.col("score") >= 1.5, F.size("hit_signals") > 0).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_FULL} SELECT round(max(abs(score / 3 - round(score / 3, 1))), 6)::DOUBLE AS largest, count(*) FILTER ((score / 3 >= 0.52) <> (round(score / 3, 1) >= 0.52)) AS flips FROM f")
def quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rounding scores to one decimal changes."""
    rows = full_records(spark, sf_dir).select((F.col("score") / 3).alias("exact"), F.round(F.col("score") / 3, 1).alias("rounded"))
    return reporting.quantisation(rows, 0.52).select(F.round("largest", 6).alias("largest"), "flips")


@query(f"""WITH {_FULL}, t AS (SELECT * FROM f WHERE split = 'tune') SELECT 'hard' AS kind, label, count(*) FILTER (list_contains(hard_signals, 'safe_account')) AS n FROM t GROUP BY label
  UNION ALL SELECT 'soft', label, count(*) FILTER (list_contains(hit_signals, 'safe_account') AND NOT list_contains(hard_signals, 'safe_account')) FROM t GROUP BY label""")
def projected_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one signal as hard and as soft evidence among tuning records, the only ones that calibration takes."""
    own = reporting.require_split(full_records(spark, sf_dir).where("split = 'tune'"), "tune")
    count = lambda hard: reporting.projected(own, "safe_account", hard).groupBy("label").agg(F.count_if(F.size("hit_signals") > 0).alias("n")).select(F.lit("hard" if hard else "soft").alias("kind"), "label", "n")
    return count(True).unionByName(count(False))


@query(f"""WITH {_FULL} SELECT label, count(*) AS n, count(*) FILTER (decided AND score >= 2.0) AS both, count(*) FILTER (decided AND score < 2.0) AS only_a, count(*) FILTER (NOT decided AND score >= 2.0) AS only_b, count(*) FILTER (NOT decided AND score < 2.0) AS neither FROM f GROUP BY label""")
def track_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of two tracks side by side."""
    rows = full_records(spark, sf_dir)
    return reporting.tracks(rows.select("id", "label", "decided"), rows.select("id", "label", (F.col("score") >= 2.0).alias("decided")))


@query("""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 3 WHEN 0 THEN 'cofacts_scam' WHEN 1 THEN 'cofacts_ham_ad' ELSE 'cofacts_ham_suspected' END AS subset, doc_id, doc_id % 10 = 7 AS multi FROM documents WHERE doc_id % 13 <> 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY -doc_id) AS rk FROM p WHERE NOT multi)
  SELECT id, subset FROM k WHERE subset = 'cofacts_ham_suspected' OR rk <= CASE subset WHEN 'cofacts_scam' THEN 60 ELSE 25 END UNION ALL SELECT id, CASE WHEN subset = 'cofacts_scam' THEN 'multi_message_scam' ELSE 'multi_message_ham' END FROM p WHERE multi""")
def pool_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test samples of three pools: development samples go, exported chats move, two pools are limited to their first."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    subset = F.get(F.array(*map(F.lit, ("cofacts_scam", "cofacts_ham_ad", "cofacts_ham_suspected"))), (F.col("doc_id") % 3).cast("int"))
    pools = docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 10 == 7, "[LINE] chat").otherwise("text").alias("text"), subset.alias("subset"), (-F.col("doc_id")).alias("ord"))
    known = docs.where("doc_id % 13 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return reporting.select_pools(pools, known, {"cofacts_scam": 60, "cofacts_ham_ad": 25, "cofacts_ham_suspected": None}).select("id", "subset")


@query("SELECT doc_id // 2 AS id, count(*) AS n FROM documents GROUP BY 1")
def unique_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that were fetched twice, once each; two texts under one id would raise an error."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).cast("long").alias("id"), F.concat(F.lit("t"), F.floor(F.col("doc_id") / 2)).alias("text"))
    return reporting.unique_records(rows).select("id", "n")


@query(f"WITH {_FULL} SELECT f.id, CASE WHEN f.label = 'ham' THEN 'false alarm' ELSE 'missed' END AS why, f.subset, length(coalesce(d.text, '')) AS n_chars FROM f JOIN documents d ON CAST(d.doc_id AS VARCHAR) = f.id WHERE f.decided <> (f.label = 'scam')")
def case_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong decisions with their texts."""
    rows = full_records(spark, sf_dir)
    wrong = rows.where(F.col("decided") != (F.col("label") == "scam")).select("id", F.when(F.col("label") == "ham", "false alarm").otherwise("missed").alias("why"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return reporting.case_studies(rows, texts, wrong).select("id", "why", "subset", F.length("text").cast("long").alias("n_chars"))


def _listed(kind: str, name: str) -> str:
    each = (("false_positive_rate", "count(*) FILTER (decided AND label = 'ham')", "count(*) FILTER (label = 'ham')"), ("recall", "count(*) FILTER (decided AND label = 'scam')", "count(*) FILTER (label = 'scam')"), ("abstention_rate", "count(*) FILTER (abstained)", "count(*)"))
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST({name} AS VARCHAR) AS name, '{m}' AS metric, {a} AS numerator, {b} AS denominator FROM f GROUP BY {name}" for m, a, b in each)


@query(f"""WITH {_FULL}, x AS ({_listed("subset", "subset")} UNION ALL {_listed("blocklist_hit", "blocklist_hit")}
  UNION ALL SELECT 'run', 'type_output', 'share', count(scam_type), count(*) FROM f UNION ALL SELECT 'run', 'quotation_veto', 'share', count(*) FILTER (quotation_hit AND len(hard_signals) > 0), count(*) FROM f UNION ALL SELECT 'run', 'quotation', 'share', count(*) FILTER (quotation_hit), count(*) FROM f
  UNION ALL SELECT 'run', 'no_clause', 'share', sum(no_clause_hits)::BIGINT, sum(speech_act_hits)::BIGINT FROM f UNION ALL SELECT 'run', 'contradicted', 'share', count(*) FILTER (contradicted), count(*) FROM f WHERE label = 'scam' UNION ALL SELECT 'run', 'truncated', 'share', count(*) FILTER (truncated), count(*) FROM f)
  SELECT kind, name, metric, numerator, denominator, {_rate("numerator", "denominator", "value")}, (SELECT count(*) FROM f) AS n_records FROM x WHERE denominator > 0""")
def report_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run, written (rates, Markdown, records) and read back."""
    folder = Scratch(spark, "report").root
    reporting.write_report(full_records(spark, sf_dir), folder)
    n = spark.read.json(f"{folder}/records.jsonl").count()
    if not spark.read.text(f"{folder}/report.md", wholetext=True).first()[0].startswith("| kind | name |"):
        raise ValueError("no table in the report")
    rates = spark.read.option("header", True).schema("kind string, name string, metric string, numerator long, denominator long, value double, lower double, upper double").csv(f"{folder}/rates.csv")
    return rates.select("kind", "name", "metric", "numerator", "denominator", F.round("value", 6).alias("value"), F.round("lower", 6).alias("value_lower"), F.round("upper", 6).alias("value_upper"), F.lit(n).cast("long").alias("n_records"))


# ---------------------------------------------------------------- links of pages

_PAGE_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '[.]+$', ''), '^www[.]', '')"


def _page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document.sentences_of(document.analysed_messages(page_messages(spark, sf_dir)))
    return urls.extract_urls(found, SUFFIXES).select("req_id", "host")


@query(f"SELECT host AS domain, min(page_id) AS first FROM (SELECT page_id, {_PAGE_HOST} AS host FROM pages) GROUP BY host")
def distinct_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host once, with the first page that has it."""
    return reporting.distinct_domains(_page_domains(spark, sf_dir).withColumnRenamed("host", "registrable_domain")).select(F.col("registrable_domain").alias("domain"), "first")


@query(f"""WITH h AS (SELECT page_id, {_PAGE_HOST} AS host FROM pages), a AS (SELECT page_id, CASE WHEN length(host) % 5 <> 0 THEN length(host) * 4 END AS age FROM h)
  SELECT v.days, count(*) FILTER (age < v.days) AS n_hit, count(*) AS n FROM a, (VALUES (7), (14), (30), (60), (90)) AS v(days) GROUP BY v.days""")
def age_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a young domain under five limits, on one frozen table of ages."""
    links = _page_domains(spark, sf_dir).withColumnRenamed("host", "registrable_domain")
    size = F.length("domain")
    ages = links.select(F.col("registrable_domain").alias("domain")).distinct().select("domain", F.when(size % 5 != 0, "KNOWN").otherwise("FAILED").alias("outcome"), F.date_sub(F.lit("2024-06-01").cast("date"), size * 4).alias("registered_on"))
    return reporting.age_sweep(links, ages, "2024-06-01")


# ---------------------------------------------------------------- prompts, answers, projections of verdicts

_SECRET = "night"
_WINDOW = f"""WITH {SENTENCES}, w AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY m DESC, s DESC) AS k, sum(length(text)) OVER (PARTITION BY req_id ORDER BY m DESC, s DESC ROWS UNBOUNDED PRECEDING) AS size, count(*) OVER (PARTITION BY req_id) AS total FROM sent),
  p AS (SELECT req_id, any_value(total) - count(*) AS left_out, arg_min(m, m * 100000 + s) AS first_m, string_agg('[' || m || ',' || s || '] ' || text, chr(10) ORDER BY m, s) AS lines, substr(sha256('{_SECRET}:' || req_id), 1, 8) AS t FROM w WHERE k <= 6 AND (size <= 500 OR k = 1) GROUP BY req_id)"""


def _prompts(spark: SparkSession, sf_dir: str, found) -> DataFrame:
    groups = fuse.weighted(found.signals, WEIGHTS).groupBy("req_id").agg(F.array_sort(F.collect_set("grp")).alias("groups")).where("req_id % 2 = 0")
    return prompting.prompts(found.sentences, found.requests, groups, "judge the message", prompting.nonce_of("req_id", _SECRET), 6, 500)


@query(f"""{_WINDOW}, {FUSION[FUSION.index("clause AS") :]}, g AS (SELECT req_id, array_to_string(list_sort(list(DISTINCT grp)), ', ') AS groups FROM sig WHERE req_id % 2 = 0 GROUP BY req_id)
  SELECT p.req_id, left_out AS dropped_sentences, '<instructions-' || t || '>' || chr(10) || 'judge the message' || chr(10) || '</instructions-' || t || '>' || chr(10) || chr(10) || '<rules-' || t || '>' || chr(10) || CASE WHEN g.req_id IS NULL THEN 'no rule matched' ELSE 'rules matched: ' || groups END || chr(10) || '</rules-' || t || '>' || chr(10) || chr(10)
  || CASE WHEN left_out > 0 OR r.dropped > 0 THEN '<context-' || t || '>' || chr(10) || r.dropped || ' messages and ' || left_out || ' sentences before message ' || first_m || ' are not shown' || chr(10) || '</context-' || t || '>' || chr(10) || chr(10) ELSE '' END
  || '<message-' || t || '>' || chr(10) || lines || chr(10) || '</message-' || t || '>' AS prompt FROM p JOIN req r ON r.req_id = p.req_id LEFT JOIN g ON g.req_id = p.req_id""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a language model is shown of every conversation."""
    return _prompts(spark, sf_dir, detection(spark, sf_dir)).select("req_id", "dropped_sentences", "prompt")


def _runtime(prompt: str) -> str:
    """Plays a model: it cites the first sentence it is shown, and fails on some prompts."""
    lines = prompt[prompt.index("<message-") :].split("\n")[1:-1]
    if len(lines[0]) % 7 == 0:
        raise TimeoutError("too slow")
    at = lines[0][: lines[0].index("]") + 1]
    return f'{{"analysis_notes":"n","evidence_sentence_ids":[{at}],"category_165":null,"label":"suspicious"}}'


@query(f"""{_WINDOW}, f AS (SELECT req_id, '[' || m || ',' || s || '] ' || text AS line, m, s FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY m, s) AS rk FROM w WHERE k <= 6 AND (size <= 500 OR k = 1)) WHERE rk = 1),
  {FUSION[FUSION.index("clause AS") :]} SELECT f.req_id, CASE WHEN length(line) % 7 = 0 THEN 'malformed' ELSE 'ok' END AS outcome, CASE WHEN length(line) % 7 <> 0 THEN 'suspicious' END AS label, CASE WHEN length(line) % 7 = 0 THEN 'TimeoutError' END AS failure
  FROM f LEFT JOIN fact c ON c.req_id = f.req_id WHERE NOT coalesce(c.any_hard AND NOT c.quoted, false)""")
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a runtime for what the first pass leaves open, validated; failures are outcomes."""
    found = detection(spark, sf_dir)
    _, open_ = prompting.two_pass(found, _prompts(spark, sf_dir, found), WEIGHTS)
    raw = Scratch(spark, "answers").put(prompting.answered(open_, _runtime), "raw")
    judged = validated(raw.select("req_id", F.coalesce("raw", F.lit("")).alias("raw")), found.sentences)
    return judged.select("req_id", "outcome", "label").join(raw.select("req_id", "failure"), "req_id")


@query(f"""WITH {FUSION} SELECT t.req_id, CASE WHEN c.confidence >= 0.4 THEN round(1 / (1 + exp(-t.score)), 6) END::DOUBLE AS scam_probability, c.confidence < 0.4 AS abstained, c.confidence, k.scam_type AS code, 'scam_probability,abstained,confidence,scam_type,evidence,actions' AS keys
  FROM total t JOIN conf c ON c.req_id = t.req_id LEFT JOIN cat k ON k.req_id = t.req_id""")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller gets of every verdict: six keys, no checks."""
    rows = presentation.responses(detection(spark, sf_dir).verdicts)
    x = F.from_json("response", "scam_probability double, abstained boolean, confidence double, scam_type struct<code:string,label:string>")
    return rows.select("req_id", F.round(x["scam_probability"], 6).alias("scam_probability"), x["abstained"].alias("abstained"), x["confidence"].alias("confidence"), x["scam_type"]["code"].alias("code"), F.array_join(F.json_object_keys("response"), ",").alias("keys"))


@query(f"""WITH {FUSION}, e AS (SELECT req_id, name, len(list_distinct(flatten(list(ev)))) AS n FROM sig GROUP BY req_id, name), b AS (SELECT *, max(n) OVER (PARTITION BY req_id) AS largest FROM e)
  SELECT req_id, name, round(CASE WHEN n = 0 THEN 0 ELSE greatest(12.0, 100.0 * n / largest) END, 6)::DOUBLE AS width FROM b""")
def bar_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the bars of every conversation's ranking."""
    return presentation.bar_widths(presentation.hit_ranking(detection(spark, sf_dir).signals)).select("req_id", "name", F.round("width", 6).alias("width"))


@query(f"""WITH {FUSION}, x AS (SELECT r.req_id, (SELECT count(*) FROM part p WHERE p.req_id = r.req_id) AS n, CASE WHEN contradicted THEN 2 ELSE 0 END + CASE WHEN dropped > 0 AND NOT any_hard THEN 1 ELSE 0 END AS tail, f.req_id IS NOT NULL AS hit FROM req r LEFT JOIN fact f ON f.req_id = r.req_id)
  SELECT req_id, CASE WHEN hit THEN least(n, greatest(0, 5 - tail)) + tail ELSE 0 END AS n_items, true AS framed FROM x""")
def verdict_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as markup: lines of evidence become list items."""
    found = detection(spark, sf_dir).verdicts
    rows = presentation.card(found.withColumn("actions", F.array().cast("array<string>")))
    return rows.select("req_id", F.regexp_count("markup", F.lit("<li>")).cast("long").alias("n_items"), F.regexp_like("markup", F.lit('(?s)^<section class="card"><p>.*</section>$')).alias("framed"))


@query(f"""WITH {FUSION} SELECT c.req_id, CASE WHEN c.req_id % 2 = 0 THEN 'scam' ELSE 'ham' END AS label, c.confidence < 0.4 AS abstained, c.confidence >= 0.4 AND t.score >= 1.5 AS decided, coalesce(f.quoted, false) AS quotation_hit,
  coalesce((SELECT count(*) FROM sig s JOIN rules u ON u.name = s.name WHERE s.req_id = c.req_id), 0) AS speech_act_hits FROM conf c JOIN total t ON t.req_id = c.req_id LEFT JOIN fact f ON f.req_id = c.req_id""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for every conversation of a run."""
    from shoalwater.plans.text_queries import catalogue

    found = detection(spark, sf_dir)
    samples = found.requests.select(F.col("req_id").cast("string").alias("id"), F.when(F.col("req_id") % 2 == 0, "cofacts_scam").otherwise("cofacts_ham_ad").alias("subset"), "req_id")
    rows = reporting.run_records(samples, found, WEIGHTS, [r.name for r in catalogue().rules])
    return rows.select(F.col("id").cast("long").alias("req_id"), "label", "abstained", "decided", "quotation_hit", F.col("speech_act_hits").cast("long").alias("speech_act_hits"))


@query("SELECT 7 AS n_rules, 18 + 1 AS n_categories, 3 AS n_labels, (SELECT count(*) FROM documents) AS n")
def answer_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar of a model's answer: its rules, and how many categories (with null) and labels it allows."""
    rules = dict(line.split(" ::= ", 1) for line in prompting.grammar().splitlines())
    found = (len(rules), rules["category"].count(" | ") + 1, rules["label"].count(" | ") + 1, table(spark, sf_dir, "documents").count())
    return spark.createDataFrame([found], "n_rules long, n_categories long, n_labels long, n long")

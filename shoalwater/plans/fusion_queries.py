"""Fusion and n-gram queries over ``conversations`` and ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions.weights import Weights
from shoalwater.operators import evaluate, fuse, ngram
from shoalwater.operators.evasion import target_words
from shoalwater.plans.detect import Detection, detect
from shoalwater.plans.text_queries import CODE_SQL, LIMITS, MARKERS, catalogue, hits_sql, messages, sql_any, table

WEIGHTS = Weights()
MODEL = ngram.Model(
    (("th", 1.2, 0.8), ("e ", 1.1, -0.4), ("an", 1.6, 0.5), (" q", 2.0, -0.9), ("é", 1.9, 0.7), ("u", 1.3, -0.2), ("ti", 1.7, 0.3), ("ch", 2.1, -0.6), ("s", 1.0, 0.1), (" d", 1.8, 0.4)),
    -0.25,
)


def detection(spark: SparkSession, sf_dir: str) -> Detection:
    """The test catalogue over all conversations."""
    return detect(messages(spark, sf_dir), catalogue(), weights=WEIGHTS, limits=LIMITS, markers=MARKERS)


def hits(found: Detection) -> DataFrame:
    return fuse.weighted(found.signals, WEIGHTS)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per conversation: probability (null: abstains), score, confidence, category, decision."""
    rows = detection(spark, sf_dir).verdicts
    return rows.select("req_id", F.round("scam_probability", 6).alias("probability"), F.round("score", 6).alias("score"), "confidence", "scam_type", "contradicted", "decided", F.array_join("hit_signals", ",").alias("hit_signals"))


def group_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal that each group contributes, and how many it shadows."""
    parts = fuse.group_contributions(hits(detection(spark, sf_dir)), WEIGHTS)
    return parts.select("req_id", "grp", "weight", "taken.name", "taken.hard", F.size("shadowed").cast("long").alias("n_shadowed"))


def confidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations at each step of confidence."""
    return detection(spark, sf_dir).verdicts.groupBy("confidence").agg(F.count("*").alias("n"))


def type_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of each conversation with hits, and how many sentences show it."""
    rows = fuse.categories(hits(detection(spark, sf_dir)), WEIGHTS)
    return rows.where("scam_type is not null").select("req_id", "scam_type", F.size("type_evidence").cast("long").alias("n_evidence"))


def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of evidence that fit the budget."""
    return detection(spark, sf_dir).verdicts.select("req_id", F.size("evidence").cast("long").alias("n_lines"))


def actions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommended actions in order."""
    return detection(spark, sf_dir).verdicts.select("req_id", F.array_join("actions", "|").alias("actions"))


def short_circuit_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that need no expensive check."""
    return fuse.short_circuited(detection(spark, sf_dir).signals, WEIGHTS)


def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without the account rule: rows leave the signals table, nothing is detected again."""
    found = detection(spark, sf_dir)
    less = evaluate.ablated(found, WEIGHTS, ["safe_account"]).select("req_id", F.col("score").alias("without"))
    return found.verdicts.select("req_id", "score").join(less, "req_id").select("req_id", F.round("score", 6).alias("score"), F.round("without", 6).alias("without"), F.round(F.col("score") - F.col("without"), 6).alias("delta"))


def check_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every conversation, hit or not, counted."""
    found = detection(spark, sf_dir)
    names = catalogue().names() + ["quotation"]
    rows = fuse.check_rows(found.requests, found.signals, names)
    return rows.groupBy("name").agg(F.count_if("hit").alias("n_hit"), F.count_if(~F.col("hit")).alias("n_missed"))


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("req_id"), F.coalesce("text", F.lit("")).alias("text"))


def ngram_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known grams of every document: counts by gram."""
    rows = ngram.gram_counts(doc_texts(spark, sf_dir), MODEL.sizes, [g for g, _, _ in MODEL.terms])
    return rows.groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier score of every document."""
    return ngram.gram_scores(doc_texts(spark, sf_dir), MODEL).select(F.col("req_id").alias("doc_id"), F.round("ngram_score", 6).alias("score"), F.round("ngram_probability", 6).alias("probability"))


def ngram_evidence_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many grams make up half of the positive contributions."""
    rows = ngram.evidence_grams(doc_texts(spark, sf_dir), MODEL)
    return rows.groupBy(F.col("req_id").alias("doc_id")).agg(F.count("*").alias("n_grams"), F.round(F.sum("part"), 6).alias("mass"))


QUERIES = {
    f.__name__: f
    for f in (
        verdicts, group_max_score, confidence_ladder, type_resolution, evidence_topk, actions_topk, short_circuit_partition, ablation_delta, check_grid, ngram_tf, ngram_score, ngram_evidence_mass,
    )
}

_CAT = catalogue()
_RULES = ", ".join(f"({i}, '{r.name}', {str(r.hard).lower()}, [{', '.join(repr(t) for t in r.types)}])" for i, r in enumerate(_CAT.rules))
_REL = " UNION ALL ".join(f"SELECT req_id, m, s, '{k}' AS kind FROM sent WHERE {sql_any('text', w)}" for k, w in _CAT.relationship)
_WEIGHTS = ", ".join(f"('{n}', '{g}', {str(h).lower()}, {w})" for n, g, h, w, _ in WEIGHTS.rows())
_ORDER = ", ".join(f"('{c}', {i})" for i, (c, _) in enumerate(WEIGHTS.categories))
_GAP = r"[ \t*_\-.~·•/\\+|^#=]{0,2}"
_SPLIT = " OR ".join(f"len(list_filter(regexp_extract_all(text, '{_GAP.join(w)}'), lambda x: length(x) > {len(w)})) > 0" for w in target_words(_CAT))
_QUOTE = sql_any("text", [w for ws in MARKERS.values() for w in ws])
SIGNALS = f"""{hits_sql(_CAT)}, {CODE_SQL},
rules AS (SELECT * FROM (VALUES {_RULES}) AS v(rule, name, rule_hard, types)),
weights AS (SELECT * FROM (VALUES {_WEIGHTS}) AS v(name, grp, hard, weight)),
sig0 AS (
  SELECT h.req_id, r.name, h.rule * 1000 + h.m AS ord, any_value(rule_hard) AND max(level) = 2 AND NOT (bool_or(code IS NOT NULL) AND h.rule IN (0, 2)) AS hard,
         any_value(types) AS types, list_sort(list(h.m * 1000 + h.s)) AS ev, list(h.m * 1000 + h.s ORDER BY h.m, h.s)[1] AS first_ev
  FROM hit h JOIN rules r ON r.rule = h.rule LEFT JOIN code c ON c.req_id = h.req_id AND c.m = h.m GROUP BY h.req_id, h.m, h.rule, r.name
  UNION ALL
  SELECT req_id, 'relationship_building', 6000 + m, false, CAST([] AS VARCHAR[]), list_sort(list(DISTINCT m * 1000 + s)), min(m * 1000 + s) FROM ({_REL}) GROUP BY req_id, m HAVING count(DISTINCT kind) > 1 AND count(DISTINCT s) > 1
  UNION ALL
  SELECT req_id, 'evasion_split_word', 9000 + m, false, CAST([] AS VARCHAR[]), list_sort(list(DISTINCT m * 1000 + s)), min(m * 1000 + s) FROM sent WHERE {_SPLIT} GROUP BY req_id, m
  UNION ALL
  SELECT req_id, 'quotation', 12000, false, CAST([] AS VARCHAR[]), list_sort(list(DISTINCT m * 1000 + s)), min(m * 1000 + s) FROM sent WHERE {_QUOTE} GROUP BY req_id),
sig AS (SELECT s.*, w.grp, w.weight FROM sig0 s JOIN weights w ON w.name = s.name AND w.hard = s.hard),
fact AS (
  SELECT req_id, bool_or(hard) AS any_hard, count(DISTINCT grp) AS groups, bool_and(len(types) = 0) AS typeless, bool_or(name = 'quotation') AS quoted, bool_or(name = 'quotation') AND bool_or(hard) AS contradicted
  FROM sig GROUP BY req_id),
scored AS (SELECT s.* FROM sig s JOIN fact f ON f.req_id = s.req_id WHERE s.name <> 'quotation' OR NOT f.any_hard),
part AS (
  SELECT req_id, grp, max(weight) AS weight, arg_min(name, -weight * 100000 + ord) AS name, arg_min(hard, -weight * 100000 + ord) AS hard, count(*) - 1 AS n_shadowed FROM scored GROUP BY req_id, grp),
total AS (SELECT r.req_id, greatest(0.0, coalesce(sum(p.weight), 0.0)) AS score FROM req r LEFT JOIN part p ON p.req_id = r.req_id GROUP BY r.req_id),
conf AS (
  SELECT r.req_id, f.contradicted, least(
      CASE WHEN any_hard THEN 0.9 WHEN groups > 1 THEN 0.55 WHEN groups = 1 THEN 0.35 ELSE 0.05 END, CASE WHEN contradicted THEN 0.3 ELSE 1.0 END,
      CASE WHEN typeless THEN 0.35 ELSE 1.0 END, CASE WHEN dropped > 0 AND NOT coalesce(any_hard, false) THEN 0.5 ELSE 1.0 END)::DOUBLE AS confidence
  FROM req r LEFT JOIN fact f ON f.req_id = r.req_id),
cand AS (
  SELECT req_id, category, min(CASE WHEN hard THEN 0 ELSE 1 END * 1000000.0 - weight * 10000) AS rank, arg_min(ev, CASE WHEN hard THEN 0 ELSE 1 END * 1e12 - weight * 1e7 + ord) AS ev
  FROM (SELECT *, unnest(types) AS category FROM sig) GROUP BY req_id, category),
pri AS (SELECT * FROM (VALUES {_ORDER}) AS v(category, priority)),
top AS (SELECT req_id, arg_min(c.category, CASE WHEN c.category = 'PHISHING_LINK' THEN 1e9 ELSE 0 END + rank + priority * 0.01) AS category, arg_min(ev, CASE WHEN c.category = 'PHISHING_LINK' THEN 1e9 ELSE 0 END + rank + priority * 0.01) AS ev
  FROM cand c JOIN pri p ON p.category = c.category GROUP BY req_id),
both_ AS (
  SELECT req_id, arg_min(ev, ord) FILTER (list_contains(types, 'FAKE_INVESTMENT')) AS inv, arg_min(ev, ord) FILTER (name = 'relationship_building') AS rel FROM sig GROUP BY req_id),
cat AS (
  SELECT b.req_id, CASE WHEN inv IS NOT NULL AND rel IS NOT NULL THEN 'ROMANCE_INVESTMENT' ELSE t.category END AS scam_type,
         CASE WHEN inv IS NOT NULL AND rel IS NOT NULL THEN list_distinct(list_concat(inv, rel)) ELSE t.ev END AS ev
  FROM both_ b LEFT JOIN top t ON t.req_id = b.req_id)"""
_ACT = {
    "general": ["撥打 165 反詐騙專線查證", "查證前不要依訊息指示操作"], "safe": ["撥打 165 反詐騙專線查證"],
    "credential_solicit": "不要提供簡訊驗證碼、金融卡密碼或網銀帳號密碼給任何人", "authority_script": "用你自己查到的官方客服電話回撥，不要回撥訊息裡的號碼", "too_good_offer": "匯款前先與家人或行員談過",
}
_GRAMS = r"""
w AS (SELECT doc_id, ' ' || x || ' ' AS w FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '')) AS x FROM documents)),
g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: w[i]), list_transform(range(1, length(w)), lambda i: w[i:i + 1]))) AS gram FROM w),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY ALL),"""
_TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', {i}::DOUBLE, {c}::DOUBLE)" for g, i, c in MODEL.terms) + ") AS v(gram, idf, coef)),"
_VALUES = f"v AS (SELECT doc_id, t.gram, (1 + ln(tf)) * idf AS v, coef FROM tf t JOIN terms m ON m.gram = t.gram), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1)"
ORACLES = {
    "verdicts": f"""WITH {SIGNALS}
      SELECT t.req_id, round(CASE WHEN c.confidence >= 0.4 THEN 1 / (1 + exp(-t.score)) END, 6)::DOUBLE AS probability, round(t.score, 6)::DOUBLE AS score, c.confidence, k.scam_type, coalesce(c.contradicted, false) AS contradicted,
      c.confidence >= 0.4 AND t.score >= 1.5 AS decided, coalesce((SELECT array_to_string(list_sort(list(DISTINCT name)), ',') FROM sig s WHERE s.req_id = t.req_id), '') AS hit_signals
      FROM total t JOIN conf c ON c.req_id = t.req_id LEFT JOIN cat k ON k.req_id = t.req_id""",
    "group_max_score": f"WITH {SIGNALS} SELECT req_id, grp, weight::DOUBLE AS weight, name, hard, n_shadowed FROM part",
    "confidence_ladder": f"WITH {SIGNALS} SELECT confidence, count(*) AS n FROM conf GROUP BY confidence",
    "type_resolution": f"WITH {SIGNALS} SELECT req_id, scam_type, len(ev) AS n_evidence FROM cat WHERE scam_type IS NOT NULL",
    "evidence_topk": f"""WITH {SIGNALS}, x AS (SELECT r.req_id, (SELECT count(*) FROM part p WHERE p.req_id = r.req_id) AS n, CASE WHEN contradicted THEN 2 ELSE 0 END + CASE WHEN dropped > 0 AND NOT any_hard THEN 1 ELSE 0 END AS tail, f.req_id IS NOT NULL AS hit
      FROM req r LEFT JOIN fact f ON f.req_id = r.req_id) SELECT req_id, CASE WHEN hit THEN least(n, greatest(0, 5 - tail)) + tail ELSE 0 END AS n_lines FROM x""",
    "actions_topk": f"""WITH {SIGNALS},
      a AS (SELECT * FROM (VALUES ('credential_solicit', '{_ACT["credential_solicit"]}', true), ('authority_script', '{_ACT["authority_script"]}', true), ('too_good_offer', '{_ACT["too_good_offer"]}', false)) AS v(grp, txt, safe)),
      l AS (SELECT p.req_id, list(a.txt ORDER BY p.weight DESC, p.grp DESC) AS every, list(a.txt ORDER BY p.weight DESC, p.grp DESC) FILTER (safe) AS safe FROM part p JOIN a ON a.grp = p.grp GROUP BY p.req_id)
      SELECT c.req_id, CASE WHEN f.req_id IS NULL THEN '' WHEN c.confidence < 0.4 THEN array_to_string(list_concat(['{_ACT["safe"][0]}'], coalesce(l.safe, CAST([] AS VARCHAR[])))[1:3], '|')
      ELSE array_to_string(list_concat(['{_ACT["general"][0]}', '{_ACT["general"][1]}'], coalesce(l.every, CAST([] AS VARCHAR[])))[1:3], '|') END AS actions
      FROM conf c LEFT JOIN fact f ON f.req_id = c.req_id LEFT JOIN l ON l.req_id = c.req_id""",
    "short_circuit_partition": f"WITH {SIGNALS} SELECT req_id FROM fact WHERE any_hard AND NOT quoted",
    "ablation_delta": f"""WITH {SIGNALS}, s2 AS (SELECT * FROM sig WHERE name <> 'safe_account'), f2 AS (SELECT req_id, bool_or(hard) AS any_hard FROM s2 GROUP BY 1),
      p2 AS (SELECT s.req_id, grp, max(weight) AS weight FROM s2 s JOIN f2 f ON f.req_id = s.req_id WHERE name <> 'quotation' OR NOT f.any_hard GROUP BY ALL),
      t2 AS (SELECT r.req_id, greatest(0.0, coalesce(sum(weight), 0.0)) AS score FROM req r LEFT JOIN p2 ON p2.req_id = r.req_id GROUP BY r.req_id)
      SELECT a.req_id, round(a.score, 6)::DOUBLE AS score, round(b.score, 6)::DOUBLE AS without, round(a.score - b.score, 6)::DOUBLE AS delta FROM total a JOIN t2 b ON b.req_id = a.req_id""",
    "check_grid": f"""WITH {SIGNALS}, names AS (SELECT name FROM rules UNION ALL SELECT 'relationship_building' UNION ALL SELECT 'quotation'),
      k AS (SELECT name, count(*) AS n_hit, count(DISTINCT req_id) AS d FROM sig GROUP BY name)
      SELECT n.name, coalesce(n_hit, 0) AS n_hit, (SELECT count(*) FROM req) - coalesce(d, 0) AS n_missed FROM names n LEFT JOIN k ON k.name = n.name""",
    "ngram_tf": f"WITH {_GRAMS} {_TERMS[:-1]} SELECT t.gram, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf t JOIN terms m ON m.gram = t.gram GROUP BY t.gram",
    "ngram_score": f"""WITH {_GRAMS} {_TERMS} {_VALUES}, d AS (SELECT doc_id, sum(v * coef) / sqrt(sum(v * v)) AS dot FROM v GROUP BY 1), z AS (SELECT o.doc_id, coalesce(dot, 0) - 0.25 AS score FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id)
      SELECT doc_id, round(score, 6)::DOUBLE AS score, round(1 / (1 + exp(-score)), 6)::DOUBLE AS probability FROM z""",
    "ngram_evidence_mass": f"""WITH {_GRAMS} {_TERMS} {_VALUES}, p AS (SELECT v.doc_id, gram, v * coef / norm AS part FROM v JOIN n ON n.doc_id = v.doc_id WHERE coef > 0),
      c AS (SELECT *, coalesce(sum(part) OVER (PARTITION BY doc_id ORDER BY part DESC, gram ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(part) OVER (PARTITION BY doc_id) AS total FROM p)
      SELECT doc_id, count(*) AS n_grams, round(sum(part), 6)::DOUBLE AS mass FROM c WHERE before < 0.5 * total GROUP BY doc_id""",
}

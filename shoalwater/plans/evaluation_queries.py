"""Evaluation queries over ``documents`` and ``labels``, with their SQL.

Records stand in for a detection run: labels come from ``labels`` (toxic is
scam), scores and confidence are simple functions of a document's number and
length, so that the statistics, not the detector, are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions import stats
from shoalwater.operators import evaluate, redact
from shoalwater.plans.text_queries import table

STEPS = (0.05, 0.35, 0.55, 0.7, 0.9)
SIGNALS = (("with", "guaranteed_return"), ("nicht", "identity_docs"), ("pour", "loan_no_check"), ("token", "safe_account"), ("hethere", "parcel_notice"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subset, label, score, confidence, probability, abstained, decided, hit_signals)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    steps = F.array(*map(F.lit, STEPS))
    hit = F.filter(F.array(*(F.when(F.contains(F.coalesce("text", F.lit("")), F.lit(w)), F.lit(n)) for w, n in SIGNALS)), lambda x: x.isNotNull())
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subset"), F.when(F.col("toxic") == 1, "scam").otherwise("ham").alias("label"), F.col("lang"),
        ((F.col("doc_id") * 7 + F.coalesce("n_chars", F.lit(0))) % 101 / 25.0 - 0.5).alias("score"), F.get(steps, (F.col("doc_id") % 5).cast("int")).alias("confidence"), hit.alias("hit_signals"),
    )
    rows = rows.withColumn("abstained", F.col("confidence") < 0.4).withColumn("decided", evaluate.decided(F.col("score"), F.col("confidence"), F.lit(0.4), F.lit(1.5)))
    return rows.withColumn("probability", F.when(~F.col("abstained"), 1 / (1 + F.exp(-F.col("score")))))


def _rates(name: str) -> list:
    return [F.round(f"{name}.value", 6).alias(name), F.round(f"{name}.lower", 6).alias(f"{name}_lower"), F.round(f"{name}.upper", 6).alias(f"{name}_upper")]


def hash_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples on either side of the split, by language."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", evaluate.split_of(F.col("doc_id").cast("string"), F.lit("documents")).alias("split")).agg(F.count("*").alias("n"))


def dedupe_first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content digest."""
    return evaluate.first_by_content(table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), "doc_id").select("doc_id", "content_id")


def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proportional sample by language."""
    return evaluate.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 77)


def content_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 documents by salted digest of their text."""
    rows = evaluate.first_by_content(table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), "doc_id")
    return evaluate.content_sample(rows, F.coalesce("text", F.lit("")), "select:", 50).select("doc_id", "sample_key")


def subset_rates_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with intervals by subset."""
    return evaluate.subset_rates(records(spark, sf_dir)).select("subset", "n", *_rates("false_positive"), *_rates("recall"), *_rates("abstention"))


def headline_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper bound that the headline reports."""
    return evaluate.headline(evaluate.subset_rates(records(spark, sf_dir))).select(F.round("false_positive.upper", 6).alias("upper"))


def rates_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by subset, by language and by label in one pass."""
    return evaluate.rates_by_grouping(records(spark, sf_dir), ["subset", "lang", "label"])


def signal_estimability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each signal's hit rates allow to estimate."""
    names = spark.createDataFrame([(n,) for _, n in SIGNALS], "name string")
    rows = evaluate.calibration_exits(evaluate.signal_estimates(records(spark, sf_dir), names))
    return rows.select("name", "scam_hits", "n_scam", "ham_hits", "n_ham", "state", F.round("lower_bound", 6).alias("lower_bound"), "exit", "weight")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, false positives and abstention on a grid of 61 scores and the confidence cuts."""
    rows = records(spark, sf_dir)
    grid = evaluate.confidence_cuts(rows).join(spark.range(61).select((F.col("id") / 20.0).alias("least")))
    out = evaluate.threshold_grid(rows, grid)
    return out.select(F.round("floor", 6).alias("floor"), F.round("least", 6).alias("least"), F.round("recall", 6).alias("recall"), F.round("false_positive", 6).alias("false_positive"), F.round("abstention", 6).alias("abstention"))


def ngram_threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative hits at every distinct score."""
    return evaluate.score_sweep(records(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), "scam_hits", "ham_hits", "n_scam", "n_ham")


def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score whose false positive bound is at most 12 %."""
    return evaluate.choose_threshold(evaluate.score_sweep(records(spark, sf_dir)), 0.12).select(F.round("threshold", 6).alias("threshold"))


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of the scores."""
    return evaluate.auc(records(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities against observed shares."""
    rows = evaluate.calibration_bins(records(spark, sf_dir))
    return rows.select(F.col("bin").cast("long").alias("bin"), "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("observed", 6).alias("observed"))


def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of decisions."""
    return evaluate.classifier_metrics(records(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples without a hit prove a rate below 1, 2 and 5 %."""
    return stats.smallest_sample(spark, [0.01, 0.02, 0.05])


def drift_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents deleted from or edited in a later copy of the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_sha256"))
    later = docs.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    accepted = known.where("id % 38 = 0").select("id", F.lit("edited").alias("change"))
    return evaluate.unaccepted(evaluate.drift(known, later), accepted).select("id", "change")


def interval_overlap_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted spans against gold ones by overlap within a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    span = lambda a, w: docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "n").select("doc_id", (F.col("k") * 40 + F.col("n") % a).cast("int").alias("start"), (F.col("k") * 40 + F.col("n") % a + w).cast("int").alias("end"), F.lit("x").alias("kind"))
    return redact.span_overlap_rates(span(37, 9), span(29, 6)).select("tp", "predicted", "gold", "covered", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


QUERIES = {
    f.__name__: f
    for f in (
        hash_split_counts, dedupe_first_by_hash, stratified_hash_sample, content_hash_sample, subset_rates_wilson, headline_rate, rates_grouping_sets, signal_estimability, threshold_sweep, ngram_threshold_choice,
        chosen_threshold, auc_rank, calibration_bins, classifier_metrics, sample_sizes, drift_detect, interval_overlap_eval,
    )
}

_HIT = ", ".join(f"CASE WHEN contains(coalesce(text, ''), '{w}') THEN '{n}' END" for w, n in SIGNALS)
_REC = f"""r0 AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, source AS subset, CASE WHEN toxic = 1 THEN 'scam' ELSE 'ham' END AS label, lang, (d.doc_id * 7 + coalesce(n_chars, 0)) % 101 / 25.0::DOUBLE - 0.5::DOUBLE AS score,
         CAST({list(STEPS)} AS DOUBLE[])[d.doc_id % 5 + 1] AS confidence, list_filter([{_HIT}], lambda x: x IS NOT NULL) AS hit_signals FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, confidence < 0.4 AS abstained, confidence >= 0.4 AND score >= 1.5 AS decided, CASE WHEN confidence >= 0.4 THEN 1 / (1 + exp(-score)) END AS probability FROM r0)"""
_Z2 = stats.Z**2


def _wilson(k: str, n: str, side: str) -> str:
    p = f"({k} / {n}::DOUBLE)"
    half = f"{stats.Z} * sqrt({p} * (1 - {p}) / {n} + {_Z2} / (4.0 * {n} * {n})) / (1 + {_Z2} / {n})"
    mid = f"({p} + {_Z2} / (2.0 * {n})) / (1 + {_Z2} / {n})"
    return f"CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, {mid} - {half}) END" if side == "lower" else f"CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, {mid} + {half}) END"


def _rate(k: str, n: str, name: str) -> str:
    return ", ".join(f"round(CASE WHEN {n} > 0 THEN {x} END, 6)::DOUBLE AS {name}{s}" for x, s in ((f"{k} / {n}::DOUBLE", ""), (_wilson(k, n, "lower"), "_lower"), (_wilson(k, n, "upper"), "_upper")))


_SUB = f"""WITH {_REC}, s AS (SELECT subset, count(*) AS n, count(*) FILTER (label = 'ham') AS ham, count(*) FILTER (label = 'scam') AS scam, count(*) FILTER (decided AND label = 'ham') AS fp,
  count(*) FILTER (decided AND label = 'scam') AS tp, count(*) FILTER (abstained) AS ab FROM r GROUP BY subset)"""
_SWEEP = f"""WITH {_REC}, b AS (SELECT score, count(*) FILTER (label = 'scam') AS s, count(*) FILTER (label = 'ham') AS h FROM r GROUP BY score),
  w AS (SELECT score AS threshold, sum(s) OVER (ORDER BY score DESC)::BIGINT AS scam_hits, sum(h) OVER (ORDER BY score DESC)::BIGINT AS ham_hits, (sum(s) OVER ())::BIGINT AS n_scam, (sum(h) OVER ())::BIGINT AS n_ham FROM b)"""
_EST = f"""WITH {_REC}, t AS (SELECT count(*) FILTER (label = 'scam') AS n_scam, count(*) FILTER (label = 'ham') AS n_ham FROM r),
  x AS (SELECT DISTINCT id, label, unnest(hit_signals) AS name FROM r), k AS (SELECT name, count(*) FILTER (label = 'scam') AS s, count(*) FILTER (label = 'ham') AS h FROM x GROUP BY name),
  e AS (SELECT v.name, coalesce(s, 0) AS scam_hits, n_scam, coalesce(h, 0) AS ham_hits, n_ham FROM (VALUES {", ".join(f"('{n}')" for _, n in SIGNALS)}) AS v(name) LEFT JOIN k ON k.name = v.name, t),
  f AS (SELECT *, CASE WHEN scam_hits > 0 AND ham_hits > 0 THEN 'estimable' WHEN scam_hits > 0 THEN 'lower_bound_only' ELSE 'not_estimable' END AS state FROM e),
  g AS (SELECT *, CASE WHEN state = 'estimable' THEN ln({_wilson("scam_hits", "n_scam", "upper")} / ({_wilson("ham_hits", "n_ham", "lower")})) - ln(({_wilson("scam_hits", "n_scam", "lower")}) / ({_wilson("ham_hits", "n_ham", "upper")})) END AS width FROM f)"""
ORACLES = {
    "hash_split_counts": "SELECT lang, CASE WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS INTEGER) < 128 THEN 'tune' ELSE 'holdout' END AS split, count(*) AS n FROM documents GROUP BY ALL",
    "dedupe_first_by_hash": "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_id FROM documents GROUP BY 2",
    "stratified_hash_sample": """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS own, count(*) OVER () AS total FROM documents)
      WHERE k <= round_even(77.0 * own / total, 0)""",
    "content_hash_sample": "SELECT doc_id, sample_key FROM (SELECT min(doc_id) AS doc_id, sha256('select:' || coalesce(text, '')) AS sample_key FROM documents GROUP BY 2) ORDER BY sample_key LIMIT 50",
    "subset_rates_wilson": f"{_SUB} SELECT subset, n, {_rate('fp', 'ham', 'false_positive')}, {_rate('tp', 'scam', 'recall')}, {_rate('ab', 'n', 'abstention')} FROM s",
    "headline_rate": f"{_SUB} SELECT round(max(CASE WHEN ham > 0 THEN {_wilson('fp', 'ham', 'upper')} END), 6)::DOUBLE AS upper FROM s",
    "rates_grouping_sets": f"""WITH {_REC} SELECT CASE WHEN grouping(subset) = 0 THEN 'subset' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'label' END AS kind, coalesce(subset, lang, label) AS name, count(*) FILTER (decided) AS decided, count(*) AS n
      FROM r GROUP BY GROUPING SETS ((subset), (lang), (label))""",
    "signal_estimability": f"""{_EST} SELECT name, scam_hits, n_scam, ham_hits, n_ham, state, round(CASE WHEN state = 'lower_bound_only' THEN ln(scam_hits / n_scam::DOUBLE / ({_wilson("0", "n_ham", "upper")})) END, 6)::DOUBLE AS lower_bound,
      CASE WHEN state = 'estimable' AND width <= 1.9 THEN 'measured' WHEN state = 'estimable' THEN 'wide' WHEN state = 'lower_bound_only' THEN 'lower_bound' ELSE 'not_estimable' END AS exit,
      round(CASE WHEN state = 'estimable' AND width <= 1.9 THEN ln((scam_hits / n_scam::DOUBLE) / (ham_hits / n_ham::DOUBLE)) END, 6)::DOUBLE AS weight FROM g""",
    "threshold_sweep": f"""WITH {_REC}, c AS (SELECT (confidence + lead(confidence) OVER (ORDER BY confidence)) / 2 AS floor FROM (SELECT DISTINCT confidence FROM r)), g AS (SELECT floor, i / 20.0::DOUBLE AS least FROM c, range(61) AS v(i) WHERE floor IS NOT NULL)
      SELECT round(floor, 6) AS floor, round(least, 6)::DOUBLE AS least, round(count(*) FILTER (label = 'scam' AND confidence >= floor AND score >= least) / count(*) FILTER (label = 'scam')::DOUBLE, 6) AS recall,
      round(count(*) FILTER (label = 'ham' AND confidence >= floor AND score >= least) / count(*) FILTER (label = 'ham')::DOUBLE, 6) AS false_positive, round(count(*) FILTER (confidence < floor) / count(*)::DOUBLE, 6) AS abstention FROM r, g GROUP BY floor, least""",
    "ngram_threshold_choice": f"{_SWEEP} SELECT round(threshold, 6) AS threshold, scam_hits, ham_hits, n_scam, n_ham FROM w",
    "chosen_threshold": f"{_SWEEP} SELECT round(min(threshold), 6) AS threshold FROM w WHERE scam_hits > 0 AND ham_hits > 0 AND {_wilson('ham_hits', 'n_ham', 'upper')} <= 0.12",
    "auc_rank": f"""WITH {_REC}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM r)
      SELECT round((sum(rk) FILTER (label = 'scam') - count(*) FILTER (label = 'scam') * (count(*) FILTER (label = 'scam') + 1) / 2.0) / (count(*) FILTER (label = 'scam') * count(*) FILTER (label = 'ham'))::DOUBLE, 6)::DOUBLE AS auc FROM k""",
    "calibration_bins": f"""WITH {_REC}, o AS (SELECT *, row_number() OVER (ORDER BY probability, id) AS rn, count(*) OVER () AS total FROM r WHERE probability IS NOT NULL),
      b AS (SELECT *, least((rn - 1) // (total // greatest(1, total // 30)), greatest(1, total // 30) - 1) AS bin FROM o WHERE total >= 100)
      SELECT bin, count(*) AS n, round(avg(probability), 6) AS mean_probability, round(avg(CASE WHEN label = 'scam' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS observed FROM b GROUP BY bin""",
    "classifier_metrics": f"""WITH {_REC}, c AS (SELECT count(*) FILTER (decided AND label = 'scam')::DOUBLE AS tp, count(*) FILTER (decided AND label = 'ham') AS fp, count(*) FILTER (NOT decided AND label = 'scam') AS fn FROM r)
      SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "sample_sizes": f"SELECT target::DOUBLE AS target, min(n) AS n FROM range(1, 2001) AS v(n), (VALUES (0.01), (0.02), (0.05)) AS t(target) WHERE {_Z2} / (n + {_Z2}) <= target GROUP BY target",
    "drift_detect": "SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'edited' END AS change FROM documents WHERE doc_id % 17 = 0 OR (doc_id % 19 = 0 AND doc_id % 38 <> 0)",
    "interval_overlap_eval": """WITH k AS (SELECT doc_id, coalesce(n_chars, 0) AS n, i * 40 AS base FROM documents, range(5) AS v(i)), g AS (SELECT doc_id, base + n % 37 AS a, base + n % 37 + 9 AS b FROM k), p AS (SELECT doc_id, base + n % 29 AS a, base + n % 29 + 6 AS b FROM k),
      c AS (SELECT (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND p.a < g.b AND g.a < p.b)) AS tp, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM g) AS gold,
      (SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM p WHERE g.doc_id = p.doc_id AND p.a < g.b AND g.a < p.b)) AS covered)
      SELECT *, round(tp / predicted::DOUBLE, 6) AS precision, round(covered / gold::DOUBLE, 6) AS recall FROM c""",
}

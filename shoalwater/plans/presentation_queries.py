"""Queries on derived views of verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.operators import fuse, presentation
from shoalwater.plans.fusion_queries import SIGNALS, WEIGHTS, detection
from shoalwater.plans.text_queries import catalogue, messages

#: Reported cases per category, in order of priority (fixed values).
CASES = (30053, 15506, 11614, 11000, 9488, 6966, 6536, 5429, 5337, 5280, 5167, 4946, 4867, 2586, 2227, 1105, 1026, 620)


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each layer for every conversation."""
    found = detection(spark, sf_dir)
    return presentation.source_statuses(fuse.check_rows(found.requests, found.signals, catalogue().names() + ["quotation", "url_shortener", "evasion_split_word"]))


def hit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of every conversation in order of presentation."""
    return presentation.hit_ranking(detection(spark, sf_dir).signals)


def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by state and band."""
    rows = detection(spark, sf_dir).verdicts
    return rows.groupBy(presentation.verdict_state(F.col("scam_probability"), F.col("decided")).alias("state"), presentation.confidence_band(F.col("confidence"), WEIGHTS).alias("band")).agg(F.count("*").alias("n"))


def type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted categories next to reported cases."""
    official = spark.createDataFrame([(c, n) for (c, _), n in zip(WEIGHTS.categories, CASES)], "scam_type string, cases long")
    rows = presentation.type_shares(detection(spark, sf_dir).verdicts, official)
    return rows.select("scam_type", "predicted", F.round("predicted_share", 6).alias("predicted_share"), "official_cases", F.round("official_share", 6).alias("official_share"))


def random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that a control signal of 30 % hits."""
    return presentation.random_control(messages(spark, sf_dir), "control", 0.3, "7")


def gate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that a harmless corpus must not contain."""
    return presentation.gate_hits(detection(spark, sf_dir).signals)


QUERIES = {f.__name__: f for f in (source_status, hit_ranking, verdict_bands, type_shares, random_control, gate_hits)}
_OFFICIAL = ", ".join(f"('{c}', {n})" for (c, _), n in zip(WEIGHTS.categories, CASES))
ORACLES = {
    "source_status": f"""WITH {SIGNALS}, s AS (SELECT * FROM (VALUES ('rule'), ('url'), ('classifier'), ('semantic')) AS v(source)), k AS (SELECT req_id, count(DISTINCT name) AS n FROM sig GROUP BY req_id)
      SELECT r.req_id, source, CASE WHEN source = 'rule' THEN CASE WHEN coalesce(n, 0) > 0 THEN 'hit' ELSE 'clear' END WHEN source = 'url' THEN 'clear' ELSE 'unloaded' END AS state, CASE WHEN source = 'rule' THEN coalesce(n, 0) ELSE 0 END AS n_hit
      FROM req r CROSS JOIN s LEFT JOIN k ON k.req_id = r.req_id""",
    "hit_ranking": f"""WITH {SIGNALS}, e AS (SELECT req_id, name, arg_min(hard, ord) AS hard, len(list_distinct(flatten(list(ev)))) AS n_places FROM sig GROUP BY req_id, name)
      SELECT req_id, name, CASE WHEN hard THEN 'conclusive' ELSE 'indicative' END AS state, n_places, row_number() OVER (PARTITION BY req_id ORDER BY CASE WHEN hard THEN 0 ELSE 1 END, n_places DESC, name) AS rank FROM e""",
    "verdict_bands": f"""WITH {SIGNALS}, v AS (SELECT c.confidence, t.score FROM conf c JOIN total t ON t.req_id = c.req_id)
      SELECT CASE WHEN confidence < 0.4 THEN 'undecided' WHEN score >= 1.5 THEN 'scam' ELSE 'signals' END AS state, CASE WHEN confidence < 0.4 THEN NULL WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM v GROUP BY ALL""",
    "type_shares": f"""WITH {SIGNALS}, o AS (SELECT * FROM (VALUES {_OFFICIAL}) AS v(scam_type, cases)),
      p AS (SELECT k.scam_type, count(*) AS predicted FROM conf c JOIN total t ON t.req_id = c.req_id JOIN cat k ON k.req_id = c.req_id WHERE c.confidence >= 0.4 AND t.score >= 1.5 AND k.scam_type IS NOT NULL GROUP BY 1)
      SELECT o.scam_type, coalesce(predicted, 0) AS predicted, round(coalesce(predicted, 0) / greatest(1, (SELECT coalesce(sum(predicted), 0) FROM p))::DOUBLE, 6)::DOUBLE AS predicted_share, cases::BIGINT AS official_cases, round(cases / (SELECT sum(cases) FROM o)::DOUBLE, 6)::DOUBLE AS official_share
      FROM o LEFT JOIN p ON p.scam_type = o.scam_type""",
    "random_control": """WITH t AS (SELECT conv_id AS req_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY 1)
      SELECT req_id FROM t WHERE CAST('0x' || substr(sha256('7:control:' || t), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3""",
    "gate_hits": f"WITH {SIGNALS} SELECT DISTINCT req_id FROM sig WHERE hard",
}

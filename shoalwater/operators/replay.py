"""Stored judgements of a language model: validation by rule, outcomes, signals.

The engine calls no model.  Raw answers come from a table (req_id, raw); whatever
is not exactly of the agreed form becomes an outcome of its own, never a guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwater.functions.weights import CATEGORIES
from shoalwater.operators.rules import STRIDE

# Labels from weakest to strongest, keys of an answer in order.
LABELS = ("not_scam", "suspicious", "scam")
KEYS = ("analysis_notes", "evidence_sentence_ids", "category_165", "label")
OUTCOMES = ("ok", "malformed", "out_of_window", "inconsistent")


def label_rank(label):
    """0, 1, 2; an unknown label raises an error."""
    at = F.array_position(F.array(*map(F.lit, LABELS)), label)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("long"))


def validated(raw: DataFrame, sentences: DataFrame) -> DataFrame:
    """(req_id, outcome, label, category, evidence) of answers (req_id, raw).

    ok needs: a JSON object with exactly the four keys in order, coordinates that
    are pairs of integers and occur in the request's window, a known label, a
    known category or null, and evidence unless the label is the weakest.
    """
    shape = "analysis_notes string, evidence_sentence_ids array<array<int>>, category_165 string, label string"
    window = sentences.groupBy("req_id").agg(F.collect_set(F.struct("m", "s")).alias("window"))
    rows = raw.join(window, "req_id", "left").withColumn("keys", F.json_object_keys("raw")).withColumn("x", F.from_json("raw", shape))
    at = F.transform("x.evidence_sentence_ids", lambda p: F.struct(F.get(p, F.lit(0)).alias("m"), F.get(p, F.lit(1)).alias("s")))
    rows = rows.withColumn("evidence", at)
    formed = (
        F.col("keys").eqNullSafe(F.array(*map(F.lit, KEYS))) & F.col("x.analysis_notes").isNotNull() & F.col("x.evidence_sentence_ids").isNotNull() & F.col("x.label").isin(*LABELS)
        & F.forall("x.evidence_sentence_ids", lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()) & (F.col("x.category_165").isNull() | F.col("x.category_165").isin([c for _, c in CATEGORIES]))
    )
    weakest = F.col("x.label") == LABELS[0]
    outside = F.size(F.array_except("evidence", F.coalesce("window", F.array().cast("array<struct<m:int,s:int>>")))) > 0
    outcome = F.when(~F.coalesce(formed, F.lit(False)), "malformed").when(outside, "out_of_window").when((~weakest & (F.size("evidence") == 0)) | (weakest & F.col("x.category_165").isNotNull()), "inconsistent").otherwise("ok")
    code = F.create_map(*(F.lit(v) for c, label in CATEGORIES for v in (label, c)))
    good = F.col("outcome") == "ok"
    return rows.withColumn("outcome", outcome).select("req_id", "outcome", F.when(good, F.col("x.label")).alias("label"), F.when(good, F.try_element_at(code, F.col("x.category_165"))).alias("category"), F.when(good, F.array_sort(F.array_distinct("evidence"))).alias("evidence"))


def outcome_counts(checked: DataFrame) -> DataFrame:
    """(outcome, n) for every outcome, zero included."""
    all_ = checked.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return all_.join(checked.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").fillna(0, ["n"])


def model_signals(checked: DataFrame, ordinal: int) -> DataFrame:
    """Signals llm_scam and llm_suspicious of usable answers; failed ones are indeterminate."""
    hit = (F.col("outcome") == "ok") & (F.col("label") != LABELS[0])
    name = F.when(F.col("label") == "scam", "llm_scam").otherwise("llm_suspicious")
    rows = checked.where(hit | (F.col("outcome") != "ok"))
    return rows.select(
        "req_id", name.alias("name"), (F.lit(ordinal) * F.lit(STRIDE)).alias("ord"), hit.alias("hit"), F.lit(False).alias("hard"), (~hit).alias("indeterminate"),
        F.when(hit, F.concat(F.lit("語言模型判讀："), F.col("label"))).otherwise(F.concat(F.lit("語言模型輸出無效："), F.col("outcome"))).alias("detail"),
        F.coalesce("evidence", F.array().cast("array<struct<m:int,s:int>>")).alias("evidence"), F.when(hit & F.col("category").isNotNull(), F.array("category")).otherwise(F.array().cast("array<string>")).alias("scam_types"),
    )


def prompt_lines(window: DataFrame) -> DataFrame:
    """(req_id, prompt): the numbered sentences of a window, oldest first."""
    rows = F.array_sort(F.collect_list(F.struct("m", "s", "text")))
    return window.groupBy("req_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["m"], F.lit(","), r["s"], F.lit("] "), r["text"])), "\n").alias("prompt"))


def streamed_violations(texts: DataFrame, allowed_numbers: list[str], forbidden: list[str]) -> DataFrame:
    """(id, text, violation): text that cites a number that is no prefix of an allowed one, a link, or a forbidden word."""
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    allowed = F.array(*map(F.lit, allowed_numbers)) if allowed_numbers else F.array().cast("array<string>")
    bad = F.exists(numbers, lambda n: ~F.exists(allowed, lambda a: F.startswith(a, n)))
    link = F.regexp_like("text", F.lit(r"(?i)https?:|www\."))
    word = F.exists(F.array(*map(F.lit, forbidden)), lambda w: F.contains("text", w)) if forbidden else F.lit(False)
    return texts.withColumn("violation", F.when(link, "link").when(bad, "number").when(word, "category"))

"""Personal data in sentences: Taiwanese identity and phone numbers, cards; spans, highlights and redaction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwater.functions.text import SENTENCE_END, URL

# Kinds in order, placeholders, patterns, letter values and weights of identity numbers, issuer prefixes.
KINDS = ("TW_ID", "TW_MOBILE", "TW_LANDLINE", "CREDIT_CARD")
TW_ID = r"(?<![A-Za-z0-9])[A-Z][12][0-9]{8}(?![0-9])"
TW_MOBILE = r"(?<![0-9])09[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}(?![0-9])"
TW_LANDLINE = r"(?<![0-9])(?:\(0[2-8][0-9]?\)|0[2-8][0-9]?[- ])[0-9]{3,4}[- ]?[0-9]{3,4}(?![0-9])"
CARD_GROUPED = r"(?<![0-9])[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}(?![0-9])"
CARD_BARE = r"(?<![0-9])[0-9]{16}(?![0-9])"
LETTERS = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (10, 11, 12, 13, 14, 15, 16, 17, 34, 18, 19, 20, 21, 22, 35, 23, 24, 25, 26, 27, 28, 29, 32, 30, 31, 33)))
ID_WEIGHTS = (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1)
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35")
#: Placeholders must not contain what ends a sentence.
if any(set(k) & set(SENTENCE_END + "\n") or not k for k in KINDS):
    raise ValueError("a placeholder is empty or ends a sentence")
SPAN = "array<struct<start:int,end:int,kind:string>>"


def valid_identity(number: str) -> bool:
    """Checksum of an identity number: weighted digits sum to a multiple of ten."""
    tens, ones = divmod(LETTERS[number[0]], 10)
    return sum(w * int(d) for w, d in zip(ID_WEIGHTS, (tens, ones, *number[1:]))) % 10 == 0


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


_FINDERS = (
    ("TW_ID", TW_ID, valid_identity), ("TW_MOBILE", TW_MOBILE, lambda t: True), ("TW_LANDLINE", TW_LANDLINE, lambda t: len(_digits(t)) in (9, 10)),
    ("CREDIT_CARD", CARD_GROUPED, lambda t: luhn(_digits(t))), ("CREDIT_CARD", CARD_BARE, lambda t: t.startswith(ISSUERS) and luhn(t)),
)


def personal_spans(sentence: str) -> list[dict]:
    """Merged spans in order; matches that begin inside a link don't count, of overlapping ones the longer names the kind."""
    inside = [m.span() for m in re.finditer(URL, sentence)]
    found = [(m.start(), m.end(), kind) for kind, pattern, ok in _FINDERS for m in re.finditer(pattern, sentence) if ok(m[0]) and not any(a <= m.start() < b for a, b in inside)]
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(found, key=lambda x: x[0]):
        if out and start < out[-1][1]:
            a, b, before = out[-1]
            out[-1] = (a, max(b, end), before if b - a >= end - start else kind)
        else:
            out.append((start, end, kind))
    return [{"start": a, "end": b, "kind": k} for a, b, k in out]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])))
def find_spans(sentences: pd.Series) -> pd.Series:
    """Spans need offsets of every match and a fold over overlaps; batches go through Arrow."""
    return sentences.map(lambda s: personal_spans(s) if isinstance(s, str) else [])


#: No personal datum has fewer than nine digits, nor any without one.
MAYBE = "[0-9][0-9() -]{6,}[0-9]"


def spans(text: Column) -> Column:
    """Spans of a sentence; the Python function sees only sentences with a run of digits."""
    return F.coalesce(find_spans(F.when(F.regexp_like(text, F.lit(MAYBE)), text)), F.array().cast(SPAN))


def spliced(text: Column, found: Column) -> Column:
    """The sentence with each span replaced by its placeholder."""
    pieces = F.transform(found, lambda x, i: F.concat(F.substring(text, F.coalesce(F.get(found, i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(found, i - 1)["end"], F.lit(0))), F.lit("<"), x["kind"], F.lit(">")))
    rest = F.substring(text, F.coalesce(F.element_at(found, -1)["end"], F.lit(0)) + 1, F.length(text))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def redacted(sentences: DataFrame) -> DataFrame:
    """(req_id, m, s, text, counts...): one row per sentence, as many as came in."""
    rows = sentences.select("req_id", "m", "s", "text", spans(F.col("text")).alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).alias(kind.lower())

    return rows.select("req_id", "m", "s", spliced(F.col("text"), F.col("found")).alias("text"), *map(count, KINDS))


def redaction_violations(sentences: DataFrame) -> DataFrame:
    """(req_id, violations): sentences that redaction emptied, and links that it changed; requests without any don't appear."""
    rows = sentences.select("req_id", "m", "s", "text").join(redacted(sentences).select("req_id", "m", "s", F.col("text").alias("now")), ["req_id", "m", "s"], "left")
    links = F.regexp_extract_all("text", F.lit(URL), F.lit(0))
    bad = F.col("now").isNull().cast("int") + F.coalesce((F.col("now") == "").cast("int"), F.lit(0)) + F.size(F.filter(links, lambda u: ~F.contains(F.coalesce("now", F.lit("")), u)))
    return rows.groupBy("req_id").agg(F.sum(bad).alias("violations")).where("violations > 0")


def redaction_counts(sentences: DataFrame) -> DataFrame:
    """(req_id, tw_id, tw_mobile, tw_landline, credit_card): zero where a kind does not occur."""
    return redacted(sentences).groupBy("req_id").agg(*(F.sum(k.lower()).alias(k.lower()) for k in KINDS))


def span_overlap_rates(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(true_positives, predicted, gold, precision, recall) by interval overlap within a document; both have (doc_id, start, end, kind)."""
    g, p = gold.alias("g"), predicted.alias("p")
    touch = (F.col("g.doc_id") == F.col("p.doc_id")) & (F.col("p.start") < F.col("g.end")) & (F.col("g.start") < F.col("p.end")) & (F.col("g.kind") == F.col("p.kind"))
    counts = p.join(g, touch, "left_semi").agg(F.count("*").alias("tp")).join(predicted.agg(F.count("*").alias("predicted"))).join(gold.agg(F.count("*").alias("gold"))).join(g.join(p, touch, "left_semi").agg(F.count("*").alias("covered")))
    return counts.select("tp", "predicted", "gold", "covered", F.try_divide("tp", "predicted").alias("precision"), F.try_divide("covered", "gold").alias("recall"))

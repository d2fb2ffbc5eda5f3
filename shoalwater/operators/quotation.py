"""Quotation: signs that a message reports a trick instead of playing it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwater.functions import lexicon
from shoalwater.functions.text import found_words, normalised
from shoalwater.operators.rules import STRIDE

# Quotation marks, the least length of a quote, and the shape of a line that begins with a time.
PAIRS = (("「", "」"), ("『", "』"), ("“", "”"), ('"', '"'), ("'", "'"))
MIN_QUOTE = 8
TIMESTAMP = r"^\s*(?:上午|下午)?\s*(?:[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}[:/][0-9]{1,2})"
KINDS = ("引號", "來源歸屬", "轉傳格式", "宣導框架")


def quoted(sentence: str) -> list[str]:
    """Outermost quotes of at least the least length; pairs nest, plain marks alternate."""
    spans: list[tuple[int, int]] = []
    for left, right in PAIRS:
        depth, start = 0, -1
        for i, c in enumerate(sentence):
            if left == right:
                if c == left:
                    if depth:
                        spans.append((start, i))
                    depth, start = 1 - depth, i
            elif c == left:
                start, depth = (i if not depth else start), depth + 1
            elif c == right and depth:
                depth -= 1
                if not depth:
                    spans.append((start, i))
    outer = sorted(x for x in spans if not any(y[0] < x[0] and x[1] < y[1] for y in spans))
    return [sentence[a + 1 : b] for a, b in outer if b - a > MIN_QUOTE]


@F.pandas_udf(T.ArrayType(T.StringType()))
def long_quotes(sentences: pd.Series) -> pd.Series:
    """Nesting needs a counter, which no built-in expression has; batches go through Arrow."""
    return sentences.map(lambda s: quoted(s) if isinstance(s, str) else [])


def markers(text: Column, attribution=lexicon.ATTRIBUTION, forward=lexicon.FORWARD_MARKERS, awareness=lexicon.AWARENESS_FRAME) -> Column:
    """(kind number, marker) pairs of a sentence, quotes apart."""

    def of(kind: int, words) -> Column:
        return F.transform(found_words(text, words), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("marker")))

    return F.concat(of(1, attribution), of(2, forward), of(3, awareness))


def quotation_signals(sentences: DataFrame, messages: DataFrame, ordinal: int, **words) -> DataFrame:
    """One signal per request with any marker; ``messages`` has (req_id, msg_idx, text)."""
    at = F.struct("m", "s")
    quotes = F.when(F.regexp_like("text", F.lit("[「『“\"']")), F.transform(long_quotes("text"), lambda q: F.struct(F.lit(0).alias("kind"), q.alias("marker"))))
    none = F.array().cast("array<struct<kind:int,marker:string>>")
    own = sentences.select("req_id", at.alias("at"), F.explode(F.concat(F.coalesce(quotes, none), markers(F.col("text"), **words))).alias("x")).select("req_id", "at", "x.kind", "x.marker")
    lines = F.size(F.filter(F.split(normalised("text"), "\n"), lambda x: F.regexp_like(x, F.lit(TIMESTAMP))))
    timed = messages.select("req_id", F.col("msg_idx").alias("m"), lines.alias("n")).where("n >= 2").select("req_id", "m")
    stamped = sentences.join(timed, ["req_id", "m"]).select("req_id", F.when(F.regexp_like("text", F.lit(TIMESTAMP)), at).alias("at"), F.lit(2).alias("kind"), F.lit("時間戳行").alias("marker"))
    grouped = own.unionByName(stamped).groupBy("req_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("marker")).alias("markers"), F.array_sort(F.collect_set("at")).alias("evidence"))
    names = F.transform("kinds", lambda k: F.get(F.array(*map(F.lit, KINDS)), k))
    detail = F.concat(F.lit("命中 "), F.size("kinds"), F.lit(" 類引述標記："), F.concat_ws("、", names), F.lit("；具體標記："), F.concat_ws("、", "markers"))
    return grouped.select(
        "req_id", F.lit("quotation").alias("name"), (F.lit(ordinal) * F.lit(STRIDE)).alias("ord"), F.lit(True).alias("hit"), F.lit(False).alias("hard"), F.lit(False).alias("indeterminate"),
        detail.alias("detail"), "evidence", F.array().cast("array<string>").alias("scam_types"),
    )

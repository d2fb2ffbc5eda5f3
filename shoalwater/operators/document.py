"""Messages to documents: truncation by message and length, sentences with coordinates.

``messages`` has (req_id, msg_idx, sender, text).  A request is usually a few
messages but no task assumes it: truncation is one window by request, and the
later steps are row-wise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoalwater.functions.text import analysed, strip


@dataclass(frozen=True)
class Limits:
    """At most so many messages and normalised characters; the last message always stays."""

    max_messages: int = 100
    max_chars: int = 50_000

    def __post_init__(self) -> None:
        if self.max_messages < 1 or self.max_chars < 1:
            raise ValueError("limits start at 1")


def kept_messages(measured: DataFrame, limits: Limits) -> DataFrame:
    """Adds ``kept`` and the request's ``dropped`` count to rows (req_id, msg_idx, norm_len, ...).

    The newest messages stay while their number and total length allow; a
    message stays whole or goes, and dropping is a prefix.
    """
    back = W.partitionBy("req_id").orderBy(F.desc("msg_idx"))
    total = F.sum("norm_len").over(back.rowsBetween(W.unboundedPreceding, 0))
    rank = F.row_number().over(back)
    kept = (rank <= limits.max_messages) & ((total <= limits.max_chars) | (rank == 1))
    marked = measured.withColumn("kept", kept)
    return marked.withColumn("dropped", F.count_if(~F.col("kept")).over(W.partitionBy("req_id")))


def analysed_messages(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(req_id, msg_idx, sender, text, norm_len, sentences, kept, dropped)."""
    found = messages.select("req_id", F.col("msg_idx").cast("int").alias("msg_idx"), "sender", "text", analysed(F.col("text")).alias("a"))
    return kept_messages(found.select("req_id", "msg_idx", "sender", "text", "a.norm_len", "a.sentences"), limits)


def sentences_of(analysed_rows: DataFrame) -> DataFrame:
    """(req_id, m, s, text, raw, lead, offsets): sentences of kept messages; m is the index in the original request."""
    kept = analysed_rows.where("kept").select("req_id", F.col("msg_idx").alias("m"), F.posexplode("sentences").alias("s", "x"))
    return kept.select("req_id", "m", "s", "x.text", "x.raw", "x.lead", "x.offsets")


def requests_of(analysed_rows: DataFrame) -> DataFrame:
    """(req_id, n_messages, dropped, truncated): one row per request."""
    return analysed_rows.groupBy("req_id").agg(F.count("*").alias("n_messages"), F.max("dropped").alias("dropped")).withColumn("truncated", F.col("dropped") > 0)


def raw_bounds(sentence: dict[str, Column], start: Column, end: Column) -> tuple[Column, Column]:
    """Where characters [start, end) of a sentence stand in its raw text; positions outside raise an error."""
    text, raw, lead, offsets = (sentence[k] for k in ("text", "raw", "lead", "offsets"))

    def at(i: Column) -> Column:
        same = F.when(i == 0, 0).when(i == F.length(text), F.length(raw)).otherwise(lead + i)
        place = F.when(offsets.isNull(), same).otherwise(F.element_at(offsets, i + 1))
        return F.when((i >= 0) & (i <= F.length(text)), place).otherwise(F.raise_error(F.lit("a position outside its sentence")).cast("int"))

    return at(start), at(end)


def raw_span(sentence: dict[str, Column], start: Column, end: Column) -> Column:
    """The raw text of characters [start, end) of a sentence (its columns text, raw, lead, offsets)."""
    a, b = raw_bounds(sentence, start, end)
    return F.substring(sentence["raw"], a + 1, b - a)


def sentences_at(sentences: DataFrame, coords: DataFrame) -> DataFrame:
    """``coords`` (req_id, m, s, ...) with text and raw; a coordinate that does not exist raises an error."""
    found = coords.join(sentences.select("req_id", "m", "s", "text", "raw"), ["req_id", "m", "s"], "left")
    none = F.raise_error(F.format_string("no sentence %s", F.concat_ws("/", "req_id", "m", "s"))).cast("string")
    return found.withColumn("text", F.coalesce("text", none))


def message_range(sentences: DataFrame, m: int) -> DataFrame:
    """(req_id, first, n): the sentences of message ``m`` of every request, numbered through the request."""
    before = F.count_if(F.col("m") < m)
    own = F.count_if(F.col("m") == m)
    return sentences.groupBy("req_id").agg(before.alias("first"), own.alias("n"))


def latest(messages: DataFrame) -> DataFrame:
    """(req_id, text): the last message of each request."""
    return messages.groupBy("req_id").agg(F.max_by("text", "msg_idx").alias("text"))


def context(messages: DataFrame) -> DataFrame:
    """All messages but each request's last."""
    last = messages.groupBy("req_id").agg(F.max("msg_idx").alias("last"))
    return messages.join(last, "req_id").where("msg_idx < last").drop("last")


def from_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as requests of one message each."""
    return texts.select(F.col(id_col).alias("req_id"), F.lit(0).alias("msg_idx"), F.lit(None).cast("string").alias("sender"), F.col(text_col).alias("text"))


def document_text(sentences: DataFrame) -> DataFrame:
    """(req_id, text): a request's sentences in order, one a line."""
    rows = F.array_sort(F.collect_list(F.struct("m", "s", "text")))
    return sentences.groupBy("req_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def split_forwarded(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pasted conversations, messages separated by blank lines, as messages; empty parts vanish."""
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\n[^\S\n]*\n"), strip), lambda p: p != "")
    return texts.select(F.col(id_col).alias("req_id"), F.posexplode(parts).alias("msg_idx", "text")).withColumn("sender", F.lit(None).cast("string"))


def prompt_window(sentences: DataFrame, max_sentences: int = 120, max_chars: int = 4000) -> DataFrame:
    """The newest sentences within both budgets (the newest one always), as a language model would be shown them."""
    back = W.partitionBy("req_id").orderBy(F.desc("m"), F.desc("s"))
    size = F.sum(F.length("text")).over(back.rowsBetween(W.unboundedPreceding, 0))
    rank = F.row_number().over(back)
    return sentences.withColumn("inside", (rank <= max_sentences) & ((size <= max_chars) | (rank == 1))).where("inside").drop("inside")

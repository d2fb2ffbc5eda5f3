"""Speech-act rules as one projection over clauses.

A rule is data; the whole catalogue compiles into one array expression that is
evaluated once per clause, and hits are aggregated by message.  Strength 2
(FULL) means that the beneficiary is named, 1 (WEAK) that only an imperative is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.functions import lexicon
from shoalwater.functions.text import clauses, contains_any, predicate_with_negation, self_contained_code

SIGNAL_SCHEMA = "req_id long, name string, ord long, hit boolean, hard boolean, indeterminate boolean, detail string, evidence array<struct<m:int,s:int>>, scam_types array<string>"
#: Messages of one check keep their order within this many ordinals.
STRIDE = 1 << 32


@dataclass(frozen=True)
class Rule:
    """One rule; ``negative`` asks for a negated predicate."""

    name: str
    summary: str
    predicates: tuple[str, ...]
    objects: tuple[str, ...] = ()
    receivers: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    negative: bool = False
    hard: bool = False
    fact: str = ""

    def __post_init__(self) -> None:
        if not re.fullmatch("[a-z][a-z0-9_]*", self.name):
            raise ValueError(f"rule names are snake_case: {self.name!r}")
        if not self.predicates:
            raise ValueError(f"a rule needs predicates: {self.name}")
        if self.hard and not (self.receivers and self.fact):
            raise ValueError(f"a hard rule needs receivers and a fact: {self.name}")
        if "ROMANCE_INVESTMENT" in self.types:
            raise ValueError(f"that category is only ever synthesised: {self.name}")


@dataclass(frozen=True)
class Catalogue:
    """Rules and the word lists they share."""

    rules: tuple[Rule, ...]
    negators: tuple[str, ...]
    imperative: tuple[str, ...]
    other_directed: tuple[str, ...]
    relationship: tuple[tuple[str, tuple[str, ...]], ...] = ()
    code_exempt: tuple[str, ...] = ("solicit_otp", "secrecy_demand")

    def names(self) -> list[str]:
        return [r.name for r in self.rules] + (["relationship_building"] if self.relationship else [])


def _words(listed: str) -> tuple[str, ...]:
    out: list[str] = []
    for w in listed.split():
        out += getattr(lexicon, w[1:]) if w.startswith("$") else [w]
    return tuple(out)


def default_catalogue() -> Catalogue:
    """The zh-TW catalogue."""
    rules = tuple(
        Rule(
            r["name"], r["summary"], _words(r["predicates"]), _words(r.get("objects", "")), _words(r.get("receivers", "")), _words(r.get("context", "")),
            tuple(r["types"].split()), r["negative"], r["hard"], r["fact"],
        )
        for r in lexicon.RULES
    )
    kinds = (("自我揭露", tuple(lexicon.SELF_DISCLOSURE)), ("情感承諾", tuple(lexicon.EMOTIONAL_COMMITMENT)), ("通道轉移", tuple(lexicon.CHANNEL_SHIFT)))
    return Catalogue(rules, tuple(lexicon.NEGATION), tuple(lexicon.IMPERATIVE), tuple(lexicon.OTHER_DIRECTED), kinds)


def strength(rule: Rule, catalogue: Catalogue, clause: Column, sentence: Column) -> Column:
    """0, 1 (WEAK) or 2 (FULL) for one clause of a sentence."""
    fits = predicate_with_negation(clause, rule.predicates, catalogue.negators, rule.negative) & ~contains_any(clause, catalogue.other_directed)
    if rule.objects:
        fits = contains_any(clause, rule.objects) & fits
    if rule.context:
        fits = contains_any(sentence, rule.context) & fits
    level = F.lit(2)
    if rule.receivers:
        weak = F.lit(0) if rule.negative else F.when(contains_any(clause, catalogue.imperative), 1).otherwise(0)
        level = F.when(contains_any(clause, rule.receivers), 2).otherwise(weak)
    return F.when(fits, level).otherwise(0)


def clause_hits(sentences: DataFrame, catalogue: Catalogue) -> DataFrame:
    """(req_id, m, s, rule, level, single): the strongest clause of each sentence for each rule that it matches."""
    each = sentences.select("req_id", "m", "s", "text", clauses(F.col("text")).alias("parts")).select("req_id", "m", "s", "text", F.size("parts").alias("n"), F.explode("parts").alias("clause"))
    levels = F.array(*(F.struct(F.lit(i).alias("rule"), strength(r, catalogue, F.col("clause"), F.col("text")).alias("level")) for i, r in enumerate(catalogue.rules)))
    hits = each.select("req_id", "m", "s", "n", F.explode(F.filter(levels, lambda x: x["level"] > 0)).alias("x"))
    return hits.groupBy("req_id", "m", "s", "x.rule").agg(F.max("x.level").alias("level"), (F.max("n") <= 1).alias("single"))


def message_codes(sentences: DataFrame) -> DataFrame:
    """(req_id, m, code): the first self-contained code of each message that has one."""
    found = sentences.select("req_id", "m", "s", self_contained_code(F.col("text")).alias("code")).where("code is not null")
    return found.groupBy("req_id", "m").agg(F.min_by("code", "s").alias("code"))


def rule_signals(sentences: DataFrame, catalogue: Catalogue, first: int = 0) -> DataFrame:
    """One signal per rule and message with a match."""
    meta = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.summary).alias("summary"), F.lit(r.fact if r.hard else "").alias("fact"), F.lit(r.hard).alias("hard"), F.lit(r.name in catalogue.code_exempt).alias("exempt"), F.array(*map(F.lit, r.types)).cast("array<string>").alias("types")) for r in catalogue.rules))
    hits = clause_hits(sentences, catalogue).groupBy("req_id", "m", "rule").agg(
        F.array_sort(F.collect_list(F.struct("m", "s"))).alias("evidence"), (F.max("level") == 2).alias("full"), F.bool_or("single").alias("single"),
    )
    rows = hits.join(message_codes(sentences), ["req_id", "m"], "left").withColumn("r", F.get(meta, F.col("rule")))
    code = F.when(F.col("r.exempt"), F.col("code"))
    detail = F.concat_ws(
        "；", F.col("r.summary"), F.when(F.col("r.fact") != "", F.concat(F.lit("事實："), F.col("r.fact"))),
        F.when(code.isNotNull(), F.concat(F.lit("訊息內已含 "), F.length(code), F.lit(" 位數字 "), code, F.lit("，自帶碼豁免成立，降級為弱訊號"))),
        F.when(~F.col("full"), F.lit("子句內未出現接收者，僅憑祈使標記命中，降級為弱訊號")), F.when(F.col("single"), F.lit("本句未切出子句，否定範疇涵蓋全句")),
    )
    return rows.select(
        "req_id", F.col("r.name").alias("name"), ((F.lit(first) + F.col("rule")) * F.lit(STRIDE) + F.col("m")).alias("ord"), F.lit(True).alias("hit"),
        (F.col("r.hard") & code.isNull() & F.col("full")).alias("hard"), F.lit(False).alias("indeterminate"), detail.alias("detail"), "evidence", F.col("r.types").alias("scam_types"),
    )


def cooccurrence(sentences: DataFrame, kinds: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """(req_id, m, evidence) where two kinds of words occur in two sentences of a message.

    Two matches must differ in both kind and sentence.  If every two matches
    shared one of them, all would share the same kind or the same sentence, so
    distinct counts decide and no self-join is needed.
    """
    present = F.filter(F.array(*(F.when(contains_any(F.col("text"), words), F.lit(label)) for label, words in kinds)), lambda k: k.isNotNull())
    each = sentences.select("req_id", "m", "s", F.explode(present).alias("kind"))
    grouped = each.groupBy("req_id", "m").agg(F.collect_set("kind").alias("kinds"), F.array_sort(F.collect_set(F.struct("m", "s"))).alias("evidence"))
    return grouped.where((F.size("kinds") > 1) & (F.size("evidence") > 1)).drop("kinds")


def relationship_signals(sentences: DataFrame, catalogue: Catalogue, first: int) -> DataFrame:
    """The cross-sentence relationship signal."""
    return cooccurrence(sentences, catalogue.relationship).select(
        "req_id", F.lit("relationship_building").alias("name"), (F.lit(first) * F.lit(STRIDE) + F.col("m")).alias("ord"), F.lit(True).alias("hit"), F.lit(False).alias("hard"),
        F.lit(False).alias("indeterminate"), F.lit("關係經營：自我揭露、情感承諾與通道轉移中的兩類出現在不同句子").alias("detail"), "evidence", F.array().cast("array<string>").alias("scam_types"),
    )

"""Evasion signals: invisible characters, mixed widths, split words, variants, phonetic marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.functions.text import INVISIBLE, URL
from shoalwater.operators.rules import STRIDE, Catalogue

_SOFT_HYPHEN, _BOM, _JOINER = "\u00ad", "\ufeff", "\u200d"
_MARKS = "".join(c for c in INVISIBLE if c not in (_SOFT_HYPHEN, _BOM, _JOINER))
#: A joiner between two characters that are neither letters nor digits belongs to an emoji; a mark at the very start of a message is a byte order mark.
_JOINER_OUT = f"{_JOINER}(?=[\\p{{L}}\\p{{N}}]|\\z)|(?<=[\\p{{L}}\\p{{N}}]){_JOINER}|^{_JOINER}"
#: Separators that may be put between the characters of a word (fixed values).
SEPARATORS = r"[ \t*_\-.~·•/\\+|^#=]{0,2}"
_FULL_DIGIT, _FULL_LATIN = "[０-９]", "[Ａ-ｚ]"


def invisible_marks(raw: Column, at_start: Column) -> Column:
    """Invisible characters that count, in order."""
    inside = F.regexp_extract_all(raw, F.lit(f"[{_MARKS}]|{_BOM}|{_JOINER_OUT}"), F.lit(0))
    leading = at_start & F.startswith(raw, F.lit(_BOM))
    return F.when(leading, F.slice(inside, F.lit(2), F.greatest(F.size(inside), F.lit(1)))).otherwise(inside)


def mixed_width_tokens(raw: Column) -> Column:
    """Tokens (URLs apart) with digits, or Latin letters, of both widths."""
    masked = F.regexp_replace(raw, URL, " ")
    tokens = F.filter(F.split(masked, r"(?U)[\s\p{P}\x1c-\x1f]+"), lambda t: t != "")
    both = lambda t, wide, narrow: F.regexp_like(t, F.lit(wide)) & F.regexp_like(t, F.lit(narrow))
    return F.filter(tokens, lambda t: both(t, _FULL_DIGIT, "(?U)[\\p{Nd}&&[^０-９]]") | both(t, _FULL_LATIN, "[A-Za-z]"))


def split_words(sentence: Column, words: list[str]) -> Column:
    """(word, as written) for words whose characters are kept apart: the first longer match of each."""

    def written(word: str) -> Column:
        pattern = SEPARATORS.join(f"\\Q{c}\\E" for c in word)
        longer = F.filter(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0)), lambda x: F.length(x) > len(word))
        return F.when(F.regexp_like(sentence, F.lit(pattern)), F.get(longer, F.lit(0)))

    rows = F.array(*(F.struct(F.lit(w).alias("word"), written(w).alias("written")) for w in sorted(words)))
    return F.filter(rows, lambda r: r["written"].isNotNull())


def target_words(catalogue: Catalogue) -> list[str]:
    """Words of hard rules with two characters or more, without self-references of the first rule's receivers."""
    from shoalwater.functions.lexicon import SELF_DIRECTED

    words = {w for r in catalogue.rules if r.hard for w in (*r.predicates, *r.objects, *r.receivers)} - set(SELF_DIRECTED)
    return sorted(w for w in words if len(w) >= 2)


def phonetic_runs(sentence: Column) -> Column:
    """Runs of phonetic symbols between two Han characters."""
    return F.regexp_extract_all(sentence, F.lit("(?<=[一-鿿])([ㄅ-ㄯˇˊˋ˙]+)(?=[一-鿿])"), F.lit(1))


def _signals(found: DataFrame, name: str, ordinal: int, detail: Column, peak: bool) -> DataFrame:
    """Per message from (req_id, m, s, items); evidence is the sentence with most items, or all that have any."""
    at = F.struct("m", "s")
    grouped = found.groupBy("req_id", "m").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "items"))), lambda x: x["items"])).alias("items"),
        F.max_by(at, F.struct(F.size("items"), -F.col("s"))).alias("peak"),
        F.array_sort(F.collect_list(F.when(F.size("items") > 0, at))).alias("all"),
    ).where(F.size("items") > 0)
    return grouped.select(
        "req_id", F.lit(name).alias("name"), (F.lit(ordinal) * F.lit(STRIDE) + F.col("m")).alias("ord"), F.lit(True).alias("hit"), F.lit(False).alias("hard"), F.lit(False).alias("indeterminate"),
        detail.alias("detail"), (F.array("peak") if peak else F.col("all")).alias("evidence"), F.array().cast("array<string>").alias("scam_types"),
    )


def evasion_signals(sentences: DataFrame, catalogue: Catalogue, first: int, variants: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The five evasion checks; ``variants`` are (written, meant) pairs, by default none."""
    base = sentences.select("req_id", "m", "s", "text", "raw")
    counted = F.concat_ws("、", F.transform(F.array_distinct("items"), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit(" ×"), F.size(F.filter("items", lambda x: x == c)))))
    out = _signals(base.select("req_id", "m", "s", invisible_marks(F.col("raw"), F.col("s") == 0).alias("items")), "evasion_invisible", first, F.concat(F.lit("原文含 "), F.size("items"), F.lit(" 個不可見字元："), counted), True)
    out = out.unionByName(_signals(base.select("req_id", "m", "s", mixed_width_tokens(F.col("raw")).alias("items")), "evasion_width_mix", first + 1, F.concat(F.lit("同一 token 內全形與半形混用："), F.concat_ws("、", "items")), True))
    words = F.transform(split_words(F.col("text"), target_words(catalogue)), lambda x: F.concat(x["word"], F.lit(" 被寫成「"), x["written"], F.lit("」")))
    out = out.unionByName(_signals(base.select("req_id", "m", "s", words.alias("items")), "evasion_split_word", first + 2, F.concat(F.lit("目標詞被插入分隔字元拆開："), F.concat_ws("、", "items")), False))
    if variants:
        rows = F.filter(F.array(*(F.when(F.contains("text", F.lit(v)), F.lit(f"{v}（應為{o}）")) for v, o in variants)), lambda x: x.isNotNull())
        out = out.unionByName(_signals(base.select("req_id", "m", "s", rows.alias("items")), "evasion_homophone", first + 3, F.concat(F.lit("同音或形近變體："), F.concat_ws("、", "items")), False))
    return out.unionByName(_signals(base.select("req_id", "m", "s", phonetic_runs(F.col("text")).alias("items")), "evasion_zhuyin", first + 4, F.concat(F.lit("注音符號夾在漢字之間："), F.concat_ws("、", "items")), False))

"""Text kernels: character mapping, sentence and clause splitting, lexicon tests.

What Spark's built-in functions express is a column expression.  Normalisation
with offsets maps characters one to many and back, so it is an Arrow-batched
function; it returns a text's sentences with their offsets in one pass.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that are deleted, that become a space, and that become ASCII punctuation.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
EMPHASIS = {"❗": "!", "❕": "!", "❓": "?", "❔": "?"}
SENTENCE_END = "。!?;"
URL = r"https?://\S+|www\.\S+"
#: White space as Python sees it, for Java's regex engine.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_URL = re.compile(URL)
#: ``offsets`` is null where the text is its raw form: character k stands at ``lead`` + k.
_SENTENCE = T.StructType([T.StructField("text", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("lead", T.IntegerType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])
_ANALYSED = T.StructType([T.StructField("norm_len", T.IntegerType()), T.StructField("sentences", T.ArrayType(_SENTENCE))])
_CHANGES = re.compile(f"[\r{INVISIBLE}{SPACES}{''.join(EMPHASIS)}]")
_CUT = re.compile(f"[{SENTENCE_END}]+|\n")


@lru_cache(maxsize=65536)
def mapped(ch: str) -> str:
    """What one code point becomes; often itself, sometimes nothing or several."""
    if ch in INVISIBLE:
        return ""
    return "".join(" " if c in SPACES else EMPHASIS.get(c, c) for c in unicodedata.normalize("NFKC", ch))


def unchanged(raw: str) -> bool:
    """Whether normalisation leaves a text as it is."""
    return not _CHANGES.search(raw) and (raw.isascii() or unicodedata.is_normalized("NFKC", raw))


def normalise(raw: str) -> tuple[str, list[int]]:
    """Normalised text and, for each of its characters and its end, the position in ``raw``.

    ``\\r\\n`` and ``\\r`` become ``\\n``; deletions at the start belong to the first character.
    """
    if unchanged(raw):
        return raw, list(range(len(raw) + 1))
    out: list[str] = []
    at: list[int] = []
    for m in re.finditer("\r\n?|[^\r]", raw, re.S):
        piece = "\n" if m[0][0] == "\r" else mapped(m[0])
        out.append(piece)
        at += [m.start()] * len(piece)
    if at:
        at[0] = 0
    return "".join(out), [*at, len(raw)]


def _bounds(text: str) -> list[tuple[int, int]]:
    """Where sentences begin and end: at runs of end marks, which stay, and at newlines, which go; neither counts inside a URL."""
    inside = [m.span() for m in _URL.finditer(text)]
    starts = [a for a, _ in inside]

    def free(i: int) -> bool:
        k = bisect_right(starts, i) - 1
        return k < 0 or i >= inside[k][1]

    bounds, start = [], 0
    for m in _CUT.finditer(text):
        i, end = m.span()
        if not inside:
            bounds.append((start, i if text[i] == "\n" else end))
            start = end
            continue
        while i < end:  # a run may lie partly inside a URL
            if not free(i):
                i += 1
                continue
            j = i + 1
            if text[i] != "\n":
                while j < end and free(j):
                    j += 1
            bounds.append((start, i if text[i] == "\n" else j))
            start = i = j
    bounds.append((start, len(text)))
    return bounds


def sentences(raw: str) -> tuple[int, list[tuple[str, str, int, list[int] | None]]]:
    """Normalised length and (sentence, its raw text, lead, offsets into the raw text) of a message.

    A sentence is stripped, its raw text is not.  Offsets are None where text and raw text agree.
    """
    text, at = (raw, None) if unchanged(raw) else normalise(raw)
    found = []
    for a, b in _bounds(text):
        own = text[a:b]
        body = own.strip()
        if not body:
            continue
        lead = len(own) - len(own.lstrip())
        if at is None:
            found.append((body, own, lead, None))
        else:
            first = a + lead
            found.append((body, raw[at[a] : at[b]], lead, [0, *(x - at[a] for x in at[first + 1 : first + len(body)]), at[b] - at[a]]))
    return len(text), found


@F.arrow_udf(_ANALYSED)
def analysed(texts: pa.Array) -> pa.Array:
    """Normalised length and sentences of each message; a null message has none."""
    sizes: list[int] = []
    ends, columns = [0], ([], [], [], [])
    for t in texts:
        n, found = sentences(t.as_py() or "")
        sizes.append(n)
        for column, values in zip(columns, zip(*found) if found else ((), (), (), ()), strict=True):
            column.extend(values)
        ends.append(len(columns[0]))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()))
    each = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text", "raw", "lead", "offsets"])
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["norm_len", "sentences"])


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """Normalised text; null stays null."""
    return texts.map(lambda t: t if not isinstance(t, str) or unchanged(t) else normalise(t)[0], na_action=None).where(texts.notna(), None)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clauses(sentence: Column) -> Column:
    """Non-empty parts between commas and colons, stripped."""
    return F.filter(F.transform(F.split(sentence, "[,:]"), strip), lambda c: c != "")


def alternation(words: Iterable[str]) -> str:
    """A pattern for any of the words, taken literally."""
    return "|".join(f"\\Q{w}\\E" for w in words)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    words = list(words)
    return F.regexp_like(text, F.lit(alternation(words))) if words else F.lit(False)


def found_words(text: Column, words: Iterable[str]) -> Column:
    """The words that occur, in code-point order."""
    return F.filter(F.array(*map(F.lit, sorted(words))), lambda w: F.contains(text, w))


def predicate_with_negation(clause: Column, predicates: Iterable[str], negators: Iterable[str], negated: bool) -> Column:
    """Some predicate's first occurrence has (or lacks) a negator wholly before it in the clause."""
    out = F.lit(False)
    pattern = alternation(negators)
    for w in predicates:
        state = F.regexp_like(F.substring_index(clause, w, 1), F.lit(pattern))
        out = out | (F.contains(clause, F.lit(w)) & (state if negated else ~state))
    return out


def visual_form(label: Column) -> Column:
    """Look-alikes folded: rn to m, 0 to o, 1 to l."""
    return F.translate(F.replace(label, F.lit("rn"), F.lit("m")), "01", "ol")


#: Four to eight digits that are not an amount.
SELF_CONTAINED_CODE = r"(?<![0-9])([0-9]{4,8})(?![0-9])(?!\s*(?:元|塊|萬|NT\$|TWD))"


def self_contained_code(sentence: Column) -> Column:
    """The first code in a sentence, or null."""
    return F.nullif(F.regexp_extract(sentence, SELF_CONTAINED_CODE, 1), F.lit(""))

"""Positions of all regex matches, as column expressions.

Spark's regex functions return matched text, not offsets.  Splitting the text
at the same pattern gives what lies between the matches, so offsets are running
sums of lengths (in code points).  Every array that a later step reads is bound
once, and the sums are taken in chunks of chunks, so a text costs time in
proportion to its length and its number of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements in a chunk of running sums, and how often sums of chunks are chunked again.
CHUNK, LEVELS = 64, 2


def ignoring_case(words: str) -> str:
    """A pattern for ``words`` in either case of A to Z, without case-folding flags (engines fold differently)."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, use: str) -> str:
    """SQL of ``use``, in which ``name`` stands for ``value`` and is evaluated once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _offsets(steps: str, levels: int = LEVELS) -> str:
    """SQL of the exclusive running sums of a bound array of int."""
    total = lambda values: f"aggregate({values}, 0, (a, y) -> a + y)"
    short = f"transform({steps}, (y, i) -> {total(f'slice({steps}, 1, i)')})"
    if not levels:
        return short
    chunks, totals, before = (f"{name}{levels}" for name in ("chunks", "totals", "before"))
    own = f"transform(own, (y, i) -> base + {total('slice(own, 1, i)')})"
    each = f"flatten(transform({chunks}, (own, c) -> {_bound(f'get({before}, c)', 'base', own)}))"
    sums = _bound(f"transform({chunks}, own -> {total('own')})", totals, _bound(_offsets(totals, levels - 1), before, each))
    cut = f"transform(sequence(0, cast((size({steps}) - 1) div {CHUNK} as int)), c -> slice({steps}, c * {CHUNK} + 1, {CHUNK}))"
    return f"case when size({steps}) <= {CHUNK} then {short} else {_bound(cut, chunks, sums)} end"


def matches(text: str, pattern: str, make: Callable[[Column, Column, Column, Column, Column], Column], kind: str, group: int = 0, hint: str = "true") -> Column:
    """``make(start, end, value, before, after)`` of every leftmost non-overlapping match in the column named ``text``.

    ``value`` is group ``group`` of the match, ``before`` and ``after`` the text
    between it and its neighbours.  ``hint`` is a cheap SQL condition without
    which the pattern can't match.  The result is an array of type ``kind``,
    empty if there is no match.
    """
    p = _quoted(pattern)
    all_of = lambda g: f"regexp_extract_all({text}, {p}, {g})"
    zipped = f"arrays_zip({all_of(0)}, {all_of(group)}, slice(between, 1, size(between) - 1), slice(between, 2, size(between) - 1))"
    rows = f"transform({zipped}, x -> struct(x.`0` as whole, x.`1` as value, x.`2` as before, x.`3` as after))"
    at = _bound("transform(rows, x -> length(x.before) + length(x.whole))", "steps", _offsets("steps"))
    placed = "transform(arrays_zip(rows, at), z -> struct(z.at + length(z.rows.before) as start, z.at + length(z.rows.before) + length(z.rows.whole) as end, z.rows.value as value, z.rows.before as before, z.rows.after as after))"
    found = _bound(f"split({text}, {p}, -1)", "between", _bound(rows, "rows", _bound(at, "at", placed)))
    found = F.expr(f"case when {hint} and regexp_like({text}, {p}) then {found} end")
    return F.coalesce(F.transform(found, lambda x: make(x["start"], x["end"], x["value"], x["before"], x["after"])), F.array().cast(kind))


def listed(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end joined by commas, of an array of structs with kind (index into ``names``), start and end."""
    table = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(table, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

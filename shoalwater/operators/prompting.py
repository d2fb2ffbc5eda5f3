"""What a language model is shown, how its answer must look, and what a streamed answer may say.

The engine calls no model: prompts leave as a table, answers come back as one
(see ``replay``).  Whoever runs the model is a function from prompt to answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.functions.weights import CATEGORIES
from shoalwater.operators import document
from shoalwater.operators.replay import KEYS, LABELS

#: Places of evidence and characters of notes that an answer may hold (fixed values).
MOST_PLACES, MOST_NOTES = 5, 200
#: Where an address begins (fixed values).
LINK_MARKS = ("http", "www.")


def grammar() -> str:
    """A grammar (in llama.cpp's notation) of exactly the answers that ``replay.validated`` takes for well formed."""
    literal = lambda text: '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    quoted = lambda values: " | ".join(literal(f'"{v}"') for v in values)
    key = lambda i: literal(("," if i else "{") + f'"{KEYS[i]}":')
    rules = {
        "root": f'{key(0)} notes {key(1)} places {key(2)} category {key(3)} label "}}"',
        "notes": f'"\\"" [^"\\\\\\n]{{0,{MOST_NOTES}}} "\\""',
        "places": f'"[" ( pair ( "," pair ){{0,{MOST_PLACES - 1}}} )? "]"',
        "pair": '"[" number "," number "]"',
        "number": "[0-9] | [1-9] [0-9] [0-9]?",
        "category": f'"null" | {quoted(label for _, label in CATEGORIES)}',
        "label": quoted(LABELS),
    }
    return "".join(f"{name} ::= {rule}\n" for name, rule in rules.items())


def prompts(sentences: DataFrame, requests: DataFrame, groups: DataFrame, instructions: str, nonce: Column, max_sentences: int = 120, max_chars: int = 4000) -> DataFrame:
    """(req_id, prompt, dropped_sentences): instructions, what the rules found, what is left out, and the newest sentences.

    ``groups`` has (req_id, groups), the names of groups with hits.  Sections
    carry a nonce of eight hexadecimal digits; another form raises an error.
    Sentences appear as they are, numbered [message, sentence]; requests
    without a sentence have no prompt.
    """
    shown = document.prompt_window(sentences, max_sentences, max_chars)
    rows = F.array_sort(F.collect_list(F.struct("m", "s", "text")))
    window = shown.groupBy("req_id").agg(rows.alias("shown"), F.count("*").alias("n"))
    total = sentences.groupBy("req_id").agg(F.count("*").alias("total"))
    joined = window.join(total, "req_id").join(requests.select("req_id", "dropped"), "req_id").join(groups, "req_id", "left").withColumn("nonce", nonce)
    tag = F.when(F.regexp_like("nonce", F.lit("^[0-9a-f]{8}$")), F.col("nonce")).otherwise(F.raise_error(F.concat(F.lit("not a nonce: "), "nonce")).cast("string"))
    section = lambda name, body: F.concat(F.lit(f"<{name}-"), tag, F.lit(">\n"), body, F.lit(f"\n</{name}-"), tag, F.lit(">"))
    left_out = F.col("total") - F.col("n")
    hit = F.coalesce(F.array_join("groups", ", "), F.lit(""))
    found = F.when(hit == "", "no rule matched").otherwise(F.concat(F.lit("rules matched: "), hit))
    note = F.when((F.col("dropped") > 0) | (left_out > 0), section("context", F.format_string("%d messages and %d sentences before message %d are not shown", "dropped", left_out, F.get("shown", F.lit(0))["m"])))
    lines = F.array_join(F.transform("shown", lambda r: F.concat(F.lit("["), r["m"], F.lit(","), r["s"], F.lit("] "), r["text"])), "\n")
    return joined.select("req_id", F.concat_ws("\n\n", section("instructions", F.lit(instructions)), section("rules", found), note, section("message", lines)).alias("prompt"), left_out.alias("dropped_sentences"))


def nonce_of(column: str, secret: str) -> Column:
    """Eight hexadecimal digits that can't be told from the request without the secret."""
    return F.substring(F.sha2(F.concat(F.lit(secret), F.lit(":"), F.col(column).cast("string")), 256), 1, 8)


def answered(prompts: DataFrame, runtime: Callable[[str], str], attempts: int = 2) -> DataFrame:
    """(req_id, raw, failure) of a runtime that is called for every prompt in place, tried again after an error; a failure leaves no answer but its kind."""
    kind = prompts.schema["req_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, failure = [], []
            for text in batch.column(1).to_pylist():
                answer = failed = None
                for _ in range(attempts):
                    try:
                        answer, failed = runtime(text), None
                        break
                    except Exception as error:  # the runtime's own: a judgement that is missing is a result
                        failed = type(error).__name__
                raw.append(answer)
                failure.append(failed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string()), pa.array(failure, pa.string())], names=["req_id", "raw", "failure"])

    return prompts.select("req_id", "prompt").mapInArrow(run, f"req_id {kind}, raw string, failure string")


def allowed_numbers(segments: Column) -> Column:
    """The digit runs of what was found: all that an answer may cite."""
    return F.array_distinct(F.flatten(F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)))))


def allowed_types(verdict_type: Column, hit_types: Column) -> Column:
    """Categories that the verdict or any hit names."""
    return F.array_distinct(F.filter(F.concat(F.array(verdict_type), F.flatten(hit_types)), lambda t: t.isNotNull()))


def first_violation(text: Column, numbers: Column, forbidden: Column) -> Column:
    """Where a streamed text first breaks a rule: the number of characters that were fed by then; null if it never does.

    A digit run must be the beginning of an allowed number, no address may
    begin, no forbidden word may be completed.  Each rule is decided by the
    prefix, so the earliest end of any breach is where a stream stops.
    """
    ends_of = lambda word: F.nullif(F.call_function("locate", word, text), F.lit(0)) + F.length(word) - 1
    links = F.array(*(F.nullif(F.call_function("locate", F.lit(m), text), F.lit(0)) + len(m) - 1 for m in LINK_MARKS))
    words = F.transform(forbidden, ends_of)
    chars = F.split(text, "")
    digit = lambda i: F.regexp_like(F.get(chars, i), F.lit("^[0-9]$"))

    def cited(i: Column) -> Column:  # the digits up to and with character i
        run = F.regexp_extract(F.substring(text, F.lit(1), i + 1), "([0-9]+)$", 1)
        return F.when(digit(i) & ~F.exists(numbers, lambda n: F.startswith(n, run)), i + 1)

    own = F.transform(F.sequence(F.lit(0), F.length(text) - 1), cited)
    ends = F.concat(links, words, F.when(F.length(text) > 0, own).otherwise(F.array().cast("array<int>")))
    return F.array_min(F.filter(ends, lambda x: x.isNotNull()))


class Tokens:
    """One-time tokens of pending second passes: at most ``most`` at a time, the oldest goes first and is remembered as expired."""

    def __init__(self, most: int = 8, remembered: int = 64):
        self.most, self.remembered = most, remembered
        self.pending: dict[str, object] = {}
        self.gone: dict[str, str] = {}
        self.count = 0

    def issue(self, state: object, secret: str) -> str:
        self.count += 1
        token = hashlib.sha256(f"{secret}:{self.count}".encode()).hexdigest()[:32]
        self.pending[token] = state
        while len(self.pending) > self.most:
            self._end(next(iter(self.pending)), "evicted")
        return token

    def redeem(self, token: str) -> object:
        """The state of a token, once; a second time, after eviction or for an unknown one a KeyError says why."""
        if token not in self.pending:
            raise KeyError(self.gone.get(token, "unknown"))
        return self._end(token, "used")

    def _end(self, token: str, why: str) -> object:
        self.gone[token] = why
        while len(self.gone) > self.remembered:
            del self.gone[next(iter(self.gone))]
        return self.pending.pop(token)


def two_pass(detection, prompt_table: DataFrame, weights, local_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verdicts of the first pass, prompts of what it leaves open): requests with conclusive evidence need no second pass."""
    from shoalwater.operators.fuse import short_circuited

    open_ = prompt_table.join(short_circuited(detection.signals, weights), "req_id", "left_anti")
    return detection.verdicts, open_.limit(0) if local_only else open_

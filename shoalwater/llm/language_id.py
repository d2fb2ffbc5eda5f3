"""Language identification by hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1 (derived from its code point).  A
trigram binds three of them: the first rotated twice, the second once, the
third not at all, multiplied element by element.  A document bundles (adds) the
vectors of all its trigrams; a language prototype bundles those of its training
documents.  A document gets the language whose prototype has the largest cosine.

Plan.  Training is one scan; every task returns one vector per language, which
are added natively (languages x dimensions rows, whatever the corpus size), so
prototypes do not depend on partitioning.  Prediction is a narrow Arrow map with
the prototypes broadcast.  Trigrams of a chunk are counted together and bundled
by one matrix product, in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.session import small_batches

UNKNOWN = "und"
_CODES = 0x110000
_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(_CODES)), dtype=bool, count=_CODES))
    return _LETTER[0]


class Space:
    """Letter vectors of ``dims`` elements; code 0 stands for what is between words."""

    def __init__(self, dims: int, seed: int, remember: int = 8192):
        self.dims, self.seed, self.remember = dims, seed, remember
        self.known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dims, dtype=np.int8)
            self.known[code] = bits * 2 - 1
        return self.known[code]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each trigram in the texts: text number, trigram number; and the letters of each trigram number."""
        lower = [t.lower() for t in texts]
        codes = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
        letter = _is_letter()[codes]
        codes = np.where(letter, codes, 0)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one gap after each word
        codes, owner = np.concatenate([[0], codes[keep]]), np.concatenate([[0], owner[keep]])
        present = np.zeros(_CODES, dtype=bool)
        present[codes] = True
        alphabet = np.flatnonzero(present)
        rank = np.cumsum(present, dtype=np.int64)[codes] - 1
        n = len(alphabet)
        middle = rank[1:-1] > 0
        joint = ((rank[:-2] * n + rank[1:-1]) * n + rank[2:])[middle]
        owner = owner[1:-1][middle]
        if n**3 <= 1 << 22:
            seen = np.zeros(n**3, dtype=bool)
            seen[joint] = True
            distinct = np.flatnonzero(seen)
            number = (np.cumsum(seen) - 1)[joint]
        else:
            distinct, number = np.unique(joint, return_inverse=True)
        return owner, number, alphabet[np.stack([distinct // n // n, distinct // n % n, distinct % n])]

    def bind(self, letters: np.ndarray) -> np.ndarray:
        """Vectors of trigrams given as three rows of letters."""
        alphabet, at = np.unique(letters, return_inverse=True)
        table = np.stack([self.letter(int(c)) for c in alphabet])
        first, second, third = at.reshape(3, -1)
        return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]

    def bundle(self, texts: list[str], groups: np.ndarray | None = None, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The sum of trigram vectors of each text, or of each group of texts, and how many trigrams it has."""
        owner, number, letters = self.count(texts)
        n = letters.shape[1]
        rows = len(texts) if groups is None else int(groups.max(initial=-1)) + 1
        owner = owner if groups is None else groups[owner]
        out, times = np.zeros((rows, self.dims), dtype=np.float64), np.bincount(owner, minlength=rows)
        if not len(number):
            return out, times
        if rows * n <= 1 << 21:
            counts = np.bincount(owner * n + number, minlength=rows * n).reshape(rows, n).astype(np.float32)
            for a in range(0, n, block):
                out += counts[:, a : a + block] @ self.bind(letters[:, a : a + block]).astype(np.float32)  # below 2^24: exact
            return out, times
        order = np.argsort(owner, kind="stable")  # large alphabets: each row by its own trigrams
        owner, number = owner[order], number[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own, often = np.unique(number[a:b], return_counts=True)
            for c in range(0, len(own), block):
                out[owner[a]] += often[c : c + block].astype(np.float64) @ self.bind(letters[:, own[c : c + block]]).astype(np.float64)
        return out, times


def _pieces(texts: Iterable[str], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) of at most ``most`` characters together; a longer text comes in pieces."""
    numbers: list[int] = []
    held: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _cut(text, most):
            if held and size + len(piece) > most:
                yield numbers, held
                numbers, held, size = [], [], 0
            numbers.append(i)
            held.append(piece)
            size += len(piece)
    if held:
        yield numbers, held


def _cut(text: str, most: int) -> Iterator[str]:
    """A text, or pieces of it that end at what is no letter, so no trigram changes; a run of letters beyond half of ``most`` is cut as if a gap stood there."""
    at = 0
    while len(text) - at > most:
        to = at + most
        while to > at + most // 2 and text[to - 1].isalpha():
            to -= 1
        to = to if to > at + most // 2 else at + most
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def bundled(space: Space, texts: Iterable[str], count: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of trigram vectors of each of ``count`` texts and its number of trigrams, a few pieces at a time."""
    out, times = np.zeros((count, space.dims), dtype=np.float64), np.zeros(count, dtype=np.int64)
    for numbers, some in _pieces(texts, most):
        v, n = space.bundle(some)
        np.add.at(out, numbers, v)
        np.add.at(times, numbers, n)
    return out, times


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 0 modulo 5 (null as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, seed: int = 7, most: int = 1 << 18, max_languages: int = 10_000) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages that occur in ``docs`` with a text; rows with a null label or text are left out.

    The result has one vector per language (8 KB at 1,024 dimensions) on the
    driver; more than ``max_languages`` labels raise an error before any is made.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = Space(dims, seed), {}
        for batch in batches:
            for part in _slices(batch):
                langs = part.column(1).to_pylist()
                for numbers, some in _pieces((t.as_py() for t in part.column(0)), most):
                    own = sorted({langs[i] for i in numbers})
                    for lang, v in zip(own, space.bundle(some, np.array([own.index(langs[i]) for i in numbers]))[0], strict=True):
                        total[lang] = total.get(lang, 0) + v.astype(np.int64)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x] for x in names], pa.list_(pa.int64()))], names=["lang", "v"])

    small_batches(docs.sparkSession)
    if docs.select(F.col(lang_col).cast("string").alias("lang")).where("lang is not null").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = labelled.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    rows = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = {r.lang: np.array(r.v, dtype=np.float64) for r in rows.select("lang", F.transform("v", lambda e: e["x"]).alias("v")).collect()}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dims: int = 1024, seed: int = 7, most: int = 1 << 18) -> DataFrame:
    """One row per row of ``docs``: (id, lang_pred, score, margin).

    ``score`` is the cosine with the winning prototype (below 0: 0), ``margin``
    its lead over the second.  A text that is null, empty or without a letter,
    or any text if there are no prototypes, gets ``und`` and score 0.  Equal
    cosines go to the label that sorts first.  Repeated rows get equal results,
    an empty table none; only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((list(prototypes), np.array([prototypes[k] for k in prototypes]).reshape(len(prototypes), dims)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        space = Space(dims, seed)
        for batch in batches:
            for part in _slices(batch):
                n = part.num_rows
                v, times = bundled(space, (t.as_py() or "" for t in part.column(1)), n, most)
                size = np.linalg.norm(v, axis=1)
                if names:
                    cosine = np.clip(v @ table.T / np.maximum(size, 1e-12)[:, None], 0.0, 1.0)
                    best = cosine.argmax(axis=1)
                    top = cosine[np.arange(n), best]
                    lead = top - np.partition(cosine, -2, axis=1)[:, -2] if len(names) > 1 else top
                else:
                    best, top, lead = np.zeros(n, dtype=int), np.zeros(n), np.zeros(n)
                known = (times > 0) & bool(names)
                pred = [names[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, top, 0.0)), pa.array(np.where(known, lead, 0.0))], names=["doc", "lang_pred", "score", "margin"])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, lang_pred string, score double, margin double").withColumnRenamed("doc", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, margin), learned from the labelled rows of ``docs`` that are not held out."""
    prototypes = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    return predict(docs, prototypes, id_col, text_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "margin")


def least_cosine(trigrams: np.ndarray, full: float = 0.25, half: float = 150.0) -> np.ndarray:
    """The cosine that a text of so many trigrams needs: ``full`` for long texts, less for short ones, whose cosine is small by chance alone."""
    return full * np.sqrt(trigrams / (trigrams + half))


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", full: float = 0.25, dims: int = 1024, seed: int = 7, most: int = 1 << 18) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: a letter, and ``least_cosine`` with some prototype.

    A narrow map: rows are filtered where they are.  Without prototypes, or
    for null and letterless texts, a row is rejected.  On the test documents
    noise and scripts that were not learned go, and so do one or two words
    repeated over and over; other texts pass.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[k] for k in prototypes]).reshape(len(prototypes), dims))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, space = shared.value, Space(dims, seed)
        for batch in batches:
            for part in _slices(batch):
                v, times = bundled(space, (t.as_py() or "" for t in part.column(at)), part.num_rows, most)
                size, keep = np.linalg.norm(v, axis=1), np.zeros(part.num_rows, dtype=bool)
                if len(table):
                    keep = (times > 0) & (size > 0) & ((v @ table.T).max(axis=1) >= least_cosine(times, full) * size)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

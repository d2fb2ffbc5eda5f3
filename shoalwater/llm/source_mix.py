"""Mixing sources to target weights by cube-method balanced sampling.

Every document gets an expected number of copies: its source's target divided
by the source's size.  The whole part is taken outright; the fraction is an
inclusion probability.  The flight phase moves three fractional probabilities
at a time along the null space of two balancing constraints (number of
documents, number of words) until one of them reaches 0 or 1, so both totals
are kept exactly while probabilities are rounded.  A block of documents leaves
at most two fractional ones; those of all blocks form new blocks, and so on
until one block per source is left.  Its last two documents are the landing
problem: the words constraint is given up, then the documents constraint.

Plan.  A source, however large, is dealt into hashed blocks of a few thousand
documents; a block's flight streams over sorted rows with three documents in
memory.  Rows carry identifier, source and size only.  Randomness is a function
of (seed, source, level, block), so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwater.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: A probability this close to 0 or 1 is settled.
SETTLED = 1e-9


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float) -> dict[str | None, float]:
    """Target words of each source.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all words; a source stops at ``cap`` times its own words and
    the excess is shared again by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    most = {s: cap * n for s, n in order}
    left, open_, target = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most[s]
        left -= sum(most[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def _step(sizes: list[float], chances: list[float], draw: float) -> list[float]:
    """Move two or three probabilities inside the null space until one is settled."""
    if len(chances) == 3:
        a, b, c = sizes
        move = [c - b, a - c, b - a]
        if not any(move):
            move = [1.0, -1.0, 0.0]
    else:
        move = [1.0, -1.0]
    up = min([(1 - p) / m if m > 0 else p / -m for p, m in zip(chances, move) if m] or [0.0])
    down = min([p / m if m > 0 else (1 - p) / -m for p, m in zip(chances, move) if m] or [0.0])
    by = up if draw * (up + down) < down else -down
    return [p + by * m for p, m in zip(chances, move)]


def flight(rows: Iterable[tuple], rng: random.Random, land: bool) -> Iterator[tuple[object, float]]:
    """(row, probability) for rows (payload, size, probability) in order; at most two stay fractional, none if ``land``."""
    held: list[list] = []

    def settle() -> Iterator[tuple[object, float]]:
        for x in held[:]:
            if x[2] <= SETTLED or x[2] >= 1 - SETTLED:
                held.remove(x)
                yield x[0], float(x[2] > 0.5)

    for row in rows:
        held.append(list(row))
        yield from settle()
        while len(held) == 3:
            for x, p in zip(held, _step([x[1] for x in held], [x[2] for x in held], rng.random()), strict=True):
                x[2] = p
            yield from settle()
    while land and len(held) == 2:  # documents stay balanced, words no longer
        for x, p in zip(held, _step([x[1] for x in held], [x[2] for x in held], rng.random()), strict=True):
            x[2] = p
        yield from settle()
    if land and held:
        yield held[0][0], float(rng.random() < held[0][2])
        held.clear()
    for x in held:
        yield x[0], x[2]


_STATE = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("src", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("blocks", T.LongType()), T.StructField("block", T.LongType()), T.StructField("chance", T.DoubleType()),
])


def _fly(seed: int, level: int):
    names = _STATE.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)

        stream, out = rows(), []
        row = next(stream, None)
        while row is not None:
            src, blocks, block = row[1], row[3], row[4]

            def block_rows(first: tuple, src=src, block=block) -> Iterator[tuple]:
                nonlocal row
                row = first
                while row is not None and (row[1], row[4]) == (src, block):
                    now, row = row, next(stream, None)
                    yield now, float(now[2]), now[5]

            for state, chance in flight(block_rows(row), random.Random(f"{seed}/{level}/{src}/{block}"), blocks == 1):
                out.append((*state[:5], chance))
                if len(out) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW, strict=True)], names=names)

    return run


_ARROW = [pa.int64()] * 5 + [pa.float64()]


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    block_rows: int = 4096, seed: int = 42, max_sources: int = 1_000_000,
) -> DataFrame:
    """One row per row of ``docs``: (id, size, source_size, target, taken, copies, source).

    ``size`` is the number of words (null text: 0), ``taken`` = size x copies.
    Identifiers are integers; a null identifier sorts first in its block.  A
    null source is a source of its own, last in order.  Ties in size only make
    a null vector shorter; repeated rows are separate units.  A text without
    words is taken with its source's probability and adds 0 words.  An empty
    table, or one without any word, gives copies 0.  Extra columns are ignored.
    The table of sources (one row each, like the weights a user would name)
    is held by the driver; more than ``max_sources`` of them raise an error.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "source-mix")
    sized = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = work.put(sized, "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    target = mix_targets([(r.source, r.source_size) for r in totals], weights, share, cap)
    mixed = [(i, r.source, r.source_size, float(target[r.source]), target[r.source] / r.source_size if r.source_size else 0.0, max(1, -(-r.n // block_rows))) for i, r in enumerate(sorted(totals, key=lambda r: (r.source is None, r.source or "")))]
    table = spark.createDataFrame(mixed, "src long, source string, source_size long, target double, ratio double, blocks long")
    if len(mixed) <= 100_000:
        table = F.broadcast(table)

    def dealt(df: DataFrame, level: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.col("doc"), F.lit(seed + level)), F.col("blocks"))
        df = df.withColumn("block", block).select(*_STATE.names).repartition("src", "block")
        return df.sortWithinPartitions("src", "block", "doc", "size").mapInArrow(_fly(seed, level), _STATE)

    joined = sized.join(table.drop("source_size", "target"), sized["source"].eqNullSafe(table["source"])).drop("source")
    whole = F.floor("ratio")
    level, decided = 0, []
    open_ = joined.select("doc", "src", "size", "blocks", (F.col("ratio") - whole).alias("chance"))
    while True:
        flown = work.put(dealt(open_, level), f"flown{level}")
        loose = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(flown.where(~loose))
        rest = {r.src: r.n for r in flown.where(loose).groupBy("src").agg(F.count("*").alias("n")).collect()}
        if not rest:
            break
        level += 1
        again = spark.createDataFrame([(s, max(1, -(-n // block_rows))) for s, n in rest.items()], "src long, blocks long")
        open_ = flown.where(loose).drop("blocks", "block").join(again, "src")
    chosen = decided[0]
    for more in decided[1:]:
        chosen = chosen.unionByName(more)
    copies = (F.floor("ratio") + F.col("chance")).cast("long")
    return chosen.select("doc", "src", "size", "chance").join(table.drop("blocks"), "src").select(
        F.col("doc").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("source").alias("source"),
    )

"""Connected components of a table of links, without gathering links anywhere.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round
is two joins on node numbers and aggregates that combine before shuffling; the
number of rounds grows with the square of the logarithm of the largest
component at most, and is three or four for near-duplicate groups.  Joined
sides are scans of written tables, so that a node with very many links is split
by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwater.scratch import Scratch


def _star(pairs: DataFrame, work: Scratch, name: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v), at most ``rows`` of them, and the least of u and its partners, by u."""
    pairs = work.put(pairs, f"{name}-pairs", rows)
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return pairs, work.put(least, f"{name}-least", rows)


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b); root is the least node of its component."""
    edges = work.put(links.select("a", "b").where("a <> b").distinct(), "links")
    rows, seen = edges.count(), None
    while rows:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        pairs, least = _star(both, work, "large", 2 * rows)
        large = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        pairs, least = _star(large, work, "small", 2 * rows)
        small = pairs.join(least, "u").where("v <> least").select(F.col("v").alias("a"), F.col("least").alias("b"))
        small = small.union(least.select("u", "least").where("u <> least")).distinct()
        edges = work.put(small, "links", 2 * rows)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, rows = state, state[0]
        work.drop("large-pairs", "large-least", "small-pairs", "small-least")
    member = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return member.union(edges.select("b", "b").distinct())

"""Exact duplicates by deterministic block naming.

A text (white space removed) is cut into fixed-size blocks of its UTF-8 bytes.
The distinct blocks are sorted and numbered, so a block becomes an integer
name; equal blocks get equal names and different blocks different names.  Then
adjacent names are paired, the distinct pairs are sorted and numbered in turn,
and so on until one name is left for each document.  Two documents have the
same (level, name) exactly if their texts are equal; no digest decides it.

Plan.  Block contents cross the network once, after map-side elimination of
repeats, to be sorted and numbered inside their hash partition: names are
integers in the order of (partition, contents).  (One order over all contents
would move them twice and send samples of them to the driver.)  Occurrences fetch their numbers by a
64-bit routing digest instead of by content; the digest is first shown to be
injective on the sorted blocks of this very corpus, and if it is not, the join
runs on the contents.  Later levels move rows of a few integers, only for
documents that still have more than one name.  Every table that is joined is a
plain scan of a written table, so a name held by a third of all rows is split
by adaptive skew handling; numbering and grouping aggregate before shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.scratch import Scratch

#: Deleted before comparison: space and the controls 09 to 0D.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text that is compared; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _cut(norm: Column, size: int) -> Column:
    """Consecutive blocks of ``size`` bytes, one empty block for the empty text."""
    data = norm.cast("binary")
    last = F.greatest(F.floor((F.octet_length(norm) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _digest(block: Column, bits: int) -> Column:
    h = F.xxhash64(block)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted within their shuffle partition and numbered; (partition, rank) packs into one integer."""
    return distinct.sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("name"))


def document_names(docs: DataFrame, id_col: str, text_col: str, work: Scratch, block_bytes: int = 4096, digest_bits: int = 64) -> DataFrame:
    """Rows (rid, doc, n_points, text_sha256, level, name): the collision-free identity of each row of ``docs``."""
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    norm = base.select(
        F.monotonically_increasing_id().alias("rid"), "doc",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), normalised(F.col("text")).alias("norm"),
    )

    def described(contents: bool) -> DataFrame:
        cut = norm.select("rid", "doc", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), _cut(F.col("norm"), block_bytes).alias("blocks"))
        cut = cut.withColumn("digests", F.transform("blocks", lambda b: _digest(b, digest_bits))).withColumn("n_blocks", F.size("digests"))
        return cut if contents else cut.drop("blocks")

    meta = work.put(described(False), "meta")
    blocks = norm.select(F.explode(_cut(F.col("norm"), block_bytes)).alias("block")).select(_digest(F.col("block"), digest_bits).alias("digest"), "block")
    blocks = blocks.groupBy("digest", "block").agg(F.lit(1).alias("one"))
    # Sorted by content; the content itself is not written.
    named = blocks.sortWithinPartitions("block").select("digest", F.monotonically_increasing_id().alias("name"))
    named = work.put(named, "names")
    if named.groupBy("digest").count().where("count > 1").isEmpty():
        at = meta.select("rid", "n_blocks", F.posexplode("digests").alias("pos", "digest"))
        current = at.join(named, "digest").select("rid", "n_blocks", "pos", "name")
    else:  # two blocks share a digest: join on the contents
        meta = work.put(described(True), "meta_blocks")
        at = meta.select("rid", "n_blocks", F.posexplode("blocks").alias("pos", "block"))
        named = work.put(_numbered(at.select("block").distinct(), ["block"]), "names_by_content")
        current = at.join(named, "block").select("rid", "n_blocks", "pos", "name")
    current = work.put(current, "level0")

    widest = meta.agg(F.max("n_blocks")).first()[0] or 1
    done, level, width = [], 0, 1
    while True:
        done.append(current.where(F.col("n_blocks") <= width).select("rid", F.lit(level).alias("level"), "name"))
        if widest <= width:
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = current.where(F.col("n_blocks") > width).groupBy("rid", "n_blocks", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        level, width = level + 1, width * 2
        pairs = work.put(pairs, f"pairs{level}")
        named = work.put(_numbered(pairs.select("left", "right").distinct(), ["left", "right"]), f"names{level}")
        current = work.put(pairs.join(named, ["left", "right"]).select("rid", "n_blocks", "pos", "name"), f"level{level}")
        work.drop(f"pairs{level}", f"names{level}")
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    return meta.select("rid", "doc", "n_points", "text_sha256").join(names, "rid")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, digest_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical without white space.  Of equal texts the row
    with the most code points stays, then the smallest id (a null id sorts
    first).  A null text counts as empty; a row repeated whole counts in
    ``group_size`` each time and its twins share ``kept``.  Columns other than
    the two named are ignored, whatever they are called; an empty table gives
    an empty result.  ``digest_bits`` narrows the routing digest (for tests of
    the path on contents).
    """
    work = Scratch(docs.sparkSession, "exact-dedup")
    named = work.put(document_names(docs, id_col, text_col, work, block_bytes, digest_bits), "named")
    work.keep("named")
    groups = named.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_points")).alias("shortness"), F.col("doc"))).alias("best"),
    )
    groups = work.put(groups.select("level", "name", "group_size", F.col("best.doc").alias("keep_id"), (-F.col("best.shortness")).alias("keep_points")), "groups")
    kept = F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return named.join(groups, ["level", "name"]).select(F.col("doc").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

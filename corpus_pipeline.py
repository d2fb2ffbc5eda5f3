"""A corpus pipeline of five operators over ``documents``.

Each stage is a function of (spark, docs, sf_dir).  ``run`` writes every stage's
result as Parquet in the shared scratch folder and reads it again for the next,
so a lost executor costs at most one stage's tasks.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalwater.llm import byte_bpe, exact_dedup, language_id, simhash, source_mix
from shoalwater.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go.

    Null, empty and letterless texts have none.  Each row is judged alone:
    repeated rows and null ids change nothing, an empty table stays empty, other
    columns pass through, whatever they are called.
    """
    prototypes = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, prototypes)


#: A row's identity: two independent digests of id and text, so nothing is written or numbered.
KEYS = ["_k1", "_k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEYS``; ids may be null or repeated, and rows with both id and text in common share them."""
    return docs.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit(1), "doc_id", "text")})


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` less the rows named by ``gone``, and one row of those named by ``repeated``."""
    rest = keyed(docs).join(gone, KEYS, "left_anti")
    if not repeated.isEmpty():
        rest = rest.join(repeated, KEYS, "left_anti").unionByName(rest.join(repeated, KEYS, "left_semi").dropDuplicates(KEYS))
    return rest.select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the longest original stays, then the smallest id (null first), one row of it.

    A null text counts as empty.  Rows that share id and text are copies of one
    row, of which any stays; an empty table stays empty; names that begin with
    ``_k`` are reserved.
    """
    work = Scratch(spark, "exact-stage")
    named = keyed(docs).select(F.struct("doc_id", *KEYS).alias("id"), "text")
    judged = work.put(exact_dedup.exact_duplicates(named, "id").groupBy("id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).select("id.*", "kept", "n"), "judged")
    gone = work.put(judged.where("not kept").select(*KEYS), "gone")
    return without(docs, gone, work.put(judged.where("kept and n > 1").select(*KEYS), "repeated"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; a null id only if all are null.

    Near are texts whose five-word shingles have a Jaccard similarity of 0.8 or
    more: fingerprints propose, the texts decide.  Null and blank texts are near
    no other; of rows that share id and text any one stays; an empty table stays
    empty; names that begin with ``_k`` are reserved.
    """
    work = Scratch(spark, "near-stage")
    rows = keyed(docs)
    names = work.put(rows.groupBy(*KEYS).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "names")
    group = simhash.similar_groups(rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text"), work)
    group = group.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "root")
    member = work.put(group.join(names.select(*KEYS, "doc_id"), KEYS), "member")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS)).alias("first")
    stays = work.put(member.groupBy("root").agg(first), "stays")
    gone = member.join(stays, "root").where("_k1 <> first._k1 or _k2 <> first._k2").select(*KEYS)
    return without(docs, work.put(gone, "gone"), work.put(names.where("n > 1").select(*KEYS), "repeated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is there as often as the mix takes it.

    Rows of one id, source and size are alike to the mix: their decisions go to
    them in the order of their texts, one each.  Null ids and sources count as
    values, a null or blank text has size 0; an empty table stays empty; the
    names ``_alike``, ``_copies``, ``_nth``, ``_often`` and ``_copy`` are reserved.
    """
    def alike(size: Column) -> Column:
        return F.xxhash64(F.col("doc_id").cast("long"), "source", size.cast("long")).alias("_alike")

    taken = source_mix.mix_sources(docs).select(alike(F.col("size")), "copies").groupBy("_alike").agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    taken = Scratch(spark, "mix-stage").put(taken.where(F.array_max("_copies") > 0), "taken")
    # A row for each document: joined by sorting at every size, never broadcast.
    each = docs.withColumn("_alike", alike(source_mix.word_count(F.col("text")))).join(taken.hint("merge"), "_alike")
    nth = F.row_number().over(Window.partitionBy("_alike").orderBy(F.xxhash64("text")))
    each = each.withColumn("_nth", nth).withColumn("_often", F.get("_copies", F.col("_nth") - 1))
    often = F.sequence(F.lit(1).cast("long"), F.col("_often"))
    return each.where("_often > 0").withColumn("_copy", F.explode(often)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row's text; a null text has no tokens, repeated rows give repeated results."""
    tokenizer = byte_bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokenizer.round_trip(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash", near), ("source_mix", mix), ("byte_bpe", tokens)]

#: Fingerprints, balanced sampling and byte-level merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Snapshots of reference lists: readers with guards, merging, atomic writing.

Every reader has an explicit schema and fails on malformed rows.  A snapshot is
a folder with data and a manifest; it loads only if the manifest is complete,
the checksum holds, every source may be redistributed and is fresh enough.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY = "host string, url string, source string, first_seen string, last_seen string, nature string, site_created_on string, target string"
REQUIRED = ("host", "url", "source", "first_seen", "last_seen")


def guarded(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows of ``df``; one that fails the condition raises an error when it is read."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines split at line feeds only; missing required fields raise an error."""
    rows = spark.read.schema(ENTRY).option("mode", "FAILFAST").option("lineSep", "\n").json(path)
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & F.col(name).isNotNull()
    return guarded(rows, complete, "an entry lacks a required field")


def read_manifest(spark: SparkSession, path: str, fields: tuple[str, ...]) -> dict:
    """A manifest as a dictionary (one small file); missing fields raise KeyError."""
    text = spark.read.text(path, wholetext=True).first()[0]
    loaded = json.loads(text)
    if missing := [f for f in fields if f not in loaded]:
        raise KeyError(f"the manifest lacks {missing}")
    return loaded


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def check_sources(sources: dict[str, dict], as_of: str, max_age_days: dict[str, int], redistributable: bool = True) -> None:
    """Every source may be redistributed and is covered by an age limit on the date of its data; retired ones may be old."""
    from datetime import date

    for name, meta in sources.items():
        if redistributable and not meta["redistributable"]:
            raise ValueError(f"{name} may not be redistributed")
        if meta.get("retired"):
            continue
        if name not in max_age_days:
            raise KeyError(f"no age limit for {name}")
        age = (date.fromisoformat(as_of) - date.fromisoformat(meta["data_through"][:10])).days
        if age > max_age_days[name]:
            raise ValueError(f"{name} is {age} days old")


def load_blocklist(spark: SparkSession, folder: str, as_of: str, max_age_days: dict[str, int]) -> DataFrame:
    """The entries of a blocklist snapshot after all its guards, with titles and domain-level flags of their sources."""
    manifest = read_manifest(spark, f"{folder}/manifest.json", ("entries_file", "entries_sha256", "sources"))
    data = f"{folder}/{manifest['entries_file']}"
    if checksum(spark, data) != manifest["entries_sha256"]:
        raise ValueError("the snapshot's checksum differs from its manifest")
    check_sources(manifest["sources"], as_of, max_age_days)
    meta = [(k, v["title"], bool(v.get("domain_level_matching", True))) for k, v in manifest["sources"].items()]
    table = F.broadcast(spark.createDataFrame(meta, "source string, title string, domain_level boolean"))
    rows = read_entries(spark, data)
    if rows.isEmpty():
        raise ValueError("an empty blocklist")
    return guarded(rows.join(table, "source", "left"), F.col("title").isNotNull(), "an entry's source is not in the manifest")


def load_allowlist(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(domain, rank) up to a rank."""
    rows = spark.read.schema("domain string, rank int").option("mode", "FAILFAST").json(path)
    return guarded(rows, F.col("domain").isNotNull() & F.col("rank").between(1, most), "a rank beyond the list's limit")


def read_ranked_csv(spark: SparkSession, path: str) -> DataFrame:
    """(domain, rank) of a headerless file rank,domain whose ranks run from 1 without gaps."""
    rows = spark.read.schema("rank int, domain string").option("mode", "FAILFAST").csv(path)
    span = rows.agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d")).first()
    if span.n and (span.a != 1 or span.b != span.n or span.d != span.n):
        raise ValueError("ranks are not contiguous from 1")
    return rows.select("domain", "rank")


def require_header(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` if it has the fields; otherwise an error that names the actual header."""
    if missing := [f for f in fields if f not in df.columns]:
        raise ValueError(f"missing {missing}; the header is {df.columns}")
    return df


def roc_month(text: Column) -> Column:
    """YYYMM of the Republic of China calendar as YYYY-MM; anything else raises an error."""
    ok = F.regexp_like(text, F.lit("^[0-9]{3}(?:0[1-9]|1[0-2])$"))
    year = F.substring(text, 1, 3).cast("int") + 1911
    return F.when(ok, F.concat(year.cast("string"), F.lit("-"), F.substring(text, 4, 2))).otherwise(F.raise_error(F.concat(F.lit("not a month: "), text)))


def month_end(month: Column) -> Column:
    """The last day of YYYY-MM."""
    return F.last_day(F.to_date(month, "yyyy-MM"))


def slash_date(text: Column) -> Column:
    return F.date_format(F.to_date(text, "yyyy/MM/dd"), "yyyy-MM-dd")


def compact_date(text: Column) -> Column:
    return F.date_format(F.to_date(text, "yyyyMMdd"), "yyyy-MM-dd")


def http_date(text: Column) -> Column:
    """The day of an HTTP date; its weekday is not parsed."""
    return F.to_date(F.to_timestamp(F.substring(text, 6, 100), "dd MMM yyyy HH:mm:ss z"))


def parse_monthly_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Entries of a CSV with a month, a domain and a nature."""
    rows = require_header(spark.read.option("header", True).csv(path), ["民國年月", "網域", "網站性質"])
    month, host = roc_month(F.col("民國年月")), F.lower(F.trim("網域"))
    return rows.select(F.lit(source).alias("source"), host.alias("host"), host.alias("url"), month.alias("seen"), F.nullif(F.trim("網站性質"), F.lit("")).alias("nature"), F.lit(None).cast("string").alias("site_created_on"), F.monotonically_increasing_id().alias("ord"))


def parse_daily_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Entries of a CSV with a name, an address and dates with slashes; the host ends before the first slash."""
    rows = require_header(spark.read.option("header", True).csv(path), ["網站名稱", "網址", "統計起始日期", "統計結束日期"])
    url = F.trim("網址")
    host = F.lower(F.substring_index(F.regexp_replace(url, "^https?://", ""), "/", 1))
    return rows.select(F.lit(source).alias("source"), host.alias("host"), url.alias("url"), slash_date(F.col("統計結束日期")).alias("seen"), F.col("網站名稱").alias("nature"), F.lit(None).cast("string").alias("site_created_on"), F.monotonically_increasing_id().alias("ord"))


def parse_reports_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Entries of a JSON array with compact dates."""
    rows = require_header(spark.read.option("multiLine", True).json(path), ["偽冒網址", "網域名稱", "詐騙網站創建日期", "接獲通報日期"])
    return rows.select(F.lit(source).alias("source"), F.lower("網域名稱").alias("host"), F.col("偽冒網址").alias("url"), compact_date(F.col("接獲通報日期")).alias("seen"), F.lit(None).cast("string").alias("nature"), compact_date(F.col("詐騙網站創建日期")).alias("site_created_on"), F.monotonically_increasing_id().alias("ord"))


def parse_verified_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Entries of a (compressed) CSV feed that promises verified addresses which are online; others raise an error."""
    rows = require_header(spark.read.option("header", True).csv(path), ["phish_id", "url", "submission_time", "verified", "online", "target"])
    rows = guarded(rows, (F.col("verified") == "yes") & (F.col("online") == "yes"), "an unverified or offline address")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return rows.select(F.lit(source).alias("source"), F.regexp_replace(host, r"^www\.", "").alias("host"), "url", F.substring("submission_time", 1, 10).alias("seen"), F.lit(None).cast("string").alias("nature"), F.lit(None).cast("string").alias("site_created_on"), F.nullif("target", F.lit("Other")).alias("target"), F.monotonically_increasing_id().alias("ord"))


def parse_plain_feed(spark: SparkSession, path: str, source: str, seen: str) -> DataFrame:
    """Entries of a text file with one address a line, dated by the transfer."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    host = F.lower(F.regexp_extract("value", r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return rows.select(F.lit(source).alias("source"), F.regexp_replace(host, r"^www\.", "").alias("host"), F.trim("value").alias("url"), F.lit(seen).alias("seen"), F.lit(None).cast("string").alias("nature"), F.lit(None).cast("string").alias("site_created_on"), F.monotonically_increasing_id().alias("ord"))


def merge_entries(feed: DataFrame) -> DataFrame:
    """One entry per source and host: first and last day, the first address and known nature, the earliest creation."""
    return feed.groupBy("source", "host").agg(
        F.min_by("url", "ord").alias("url"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
        F.min_by("nature", F.when(F.col("nature").isNotNull(), F.col("ord"))).alias("nature"), F.min("site_created_on").alias("site_created_on"),
    )


def replace_sources(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """A merged list in which the sources of ``fresh`` are replaced and the others stay."""
    return kept.join(F.broadcast(fresh.select("source").distinct()), "source", "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_snapshot(df: DataFrame, path: str, before: int | None = None, shrink: float = 0.5) -> int:
    """Write beside the old snapshot, then swap by renaming; refuses to shrink below half of ``before``.  Returns the number of rows.

    The old snapshot keeps a name (``path``.old) until the new one is in place:
    after a crash between the two renames, calling again or renaming it back restores it.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}.new")
    n = spark.read.schema(df.schema).json(f"{path}.new").count()
    if before is not None and n < shrink * before:
        raise ValueError(f"only {n} rows, {before} before")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new, kept = where(path), where(f"{path}.new"), where(f"{path}.old")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(kept, True)
        if not fs.rename(old, kept):
            raise OSError(f"{path} can't be renamed")
    if not fs.rename(new, old):
        fs.rename(kept, old)
        raise OSError(f"{path}.new can't be renamed")
    fs.delete(kept, True)
    return n


def put_lookups(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """A cache of lookups (domain, outcome, registered_on, fetched_at) with newer rows taken over: one row per domain, the newest."""
    rows = cache.unionByName(fresh)
    best = rows.groupBy("domain").agg(F.max(F.struct("fetched_at", "outcome", "registered_on")).alias("x"))
    return best.select("domain", "x.outcome", "x.registered_on", "x.fetched_at")


def latest_lookups(cache: DataFrame, as_of: str, known_days: int = 180, other_days: int = 1) -> DataFrame:
    """The newest row per domain of (domain, outcome, registered_on, fetched_at) that has not expired; known answers live longer."""
    rank = F.row_number().over(W.partitionBy("domain").orderBy(F.desc("fetched_at")))
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("fetched_at"))
    return cache.withColumn("rn", rank).where("rn = 1").where(age <= F.when(F.col("outcome") == "KNOWN", known_days).otherwise(other_days)).drop("rn")


def chat_export(lines: DataFrame, file_col: str | None = None) -> DataFrame:
    """Messages (file, msg, day, clock, sender, text) of exported chats (line_no, value): a header, day rows, and rows of three tab fields.

    Other rows continue the message before them.  ``file_col`` tells several
    exports apart; lines of one export are read in order, exports in parallel.
    """
    lines = lines.withColumn("file", F.col(file_col) if file_col else F.lit(None).cast("string"))
    w = W.partitionBy("file").orderBy("line_no")
    dated = F.regexp_like("value", F.lit(r"^[0-9]{4}[./][0-9]{1,2}[./][0-9]{1,2}"))
    day = F.last(F.when(dated, F.regexp_extract("value", r"^([0-9./]+)", 1)), ignorenulls=True).over(w)
    field = F.split("value", "\t")
    start = F.size(field) == 3
    rows = lines.withColumn("day", day).withColumn("field", field).withColumn("msg", F.sum(start.cast("int")).over(w)).where("msg > 0").where(~F.regexp_like("value", F.lit(r"^[0-9]{4}[./]")))
    text = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.when(start, F.get("field", F.lit(2))).otherwise(F.col("value")).alias("t")))), lambda x: x["t"])
    return rows.groupBy("file", "msg").agg(F.min_by("day", "line_no").alias("day"), F.min_by(F.get("field", F.lit(0)), "line_no").alias("clock"), F.min_by(F.get("field", F.lit(1)), "line_no").alias("sender"), F.array_join(text, "\n").alias("text"))


def minutes_of(clock: Column) -> Column:
    """Minutes since midnight of a twelve-hour clock with 上午 or 下午, or a plain one."""
    h, m = F.regexp_extract(clock, r"([0-9]{1,2}):([0-9]{2})", 1).cast("int"), F.regexp_extract(clock, r"([0-9]{1,2}):([0-9]{2})", 2).cast("int")
    return F.when(F.startswith(clock, F.lit("下午")), h % 12 + 12).when(F.startswith(clock, F.lit("上午")), h % 12).otherwise(h) * 60 + m

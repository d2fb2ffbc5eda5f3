"""URL filters on dated lists: validity intervals and an as-of join.

A list changes over time: entries are added and removed on known days.  The
events of an entry become validity intervals (from an addition up to the next
removal, or open), and every capture is judged by the entries that were active
on the day it was fetched.  An allow entry wins over block entries.

Plan.  A capture asks for a handful of keys (its host, every parent domain, its
host with the first path segment).  Intervals are cut into bins of days, so the
join is an equality on (key, bin) with the interval as residual: a capture
meets the entries of its own time only, however often an entry has changed.
Lists are small next to captures, but that is measured: they are broadcast
below ``broadcast_rows``, and otherwise joined with skewed keys split.  Results
are grouped by capture, never by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shoalwater.scratch import Scratch

_AUTHORITY = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)"
BIN_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without a final dot (an IPv6 address keeps its brackets); null if there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), _AUTHORITY, 1), r"\.+$", "")
    return F.when(host != "", host)


def keys_of(host: Column, url: Column) -> Column:
    """What entries may name: host, every domain it lies in, host with first path segment."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segment = F.regexp_extract(url, _SEGMENT, 1)
    return F.concat(F.array(F.concat(F.lit("host:"), host)), domains, F.when(segment != "", F.array(F.concat(F.lit("path:"), host, segment))).otherwise(F.array().cast("array<string>")))


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals (list, verdict, key, since, until) of events (list, verdict, key, day, action).

    ``action`` is add or remove; of several on one day a removal counts last.
    Repeated additions extend the interval they fall in, removals of what is not
    listed do nothing, ``until`` is null while an entry is listed.
    """
    each = events.where("key is not null and day is not null and action in ('add', 'remove')").groupBy("list", "verdict", "key", "day").agg(F.max("action").alias("action"))
    w = W.partitionBy("list", "verdict", "key").orderBy("day")
    changes = each.withColumn("before", F.lag("action").over(w)).where(~F.col("action").eqNullSafe(F.coalesce("before", F.lit("remove"))))
    return changes.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("list", "verdict", "key", F.col("day").alias("since"), "until")


def _bin(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BIN_DAYS)


def judge_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched", broadcast_rows: int = 200_000) -> DataFrame:
    """One row per capture: (id, host, fetched, status, lists, n_active, since).

    ``status`` is allowed, blocked or clear; unparsed if the URL has no host
    (or is null), undated if the day is null.  ``lists`` joins the names of
    active lists in order, ``n_active`` counts active entries, ``since`` is
    the earliest start among them (null if none).  Repeated captures are judged
    each; empty captures give no rows, empty events make all clear; other columns
    are ignored.  An entry is active from its day on and not on its removal day.
    """
    work = Scratch(captures.sparkSession, "url-lists")
    rows = captures.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("fetched"))
    rows = work.put(rows.withColumn("host", host_of(F.col("url"))), "captures")
    last = rows.agg(F.max("fetched")).first()[0]
    spans = intervals(events)
    bins = F.sequence(_bin(F.col("since")), _bin(F.greatest(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.col("since"))))
    spans = work.put(spans.where(F.col("since") <= F.lit(last).cast("date")).withColumn("bin", F.explode(bins)), "intervals")
    if spans.count() <= broadcast_rows:
        spans = F.broadcast(spans)
    asked = rows.where("host is not null and fetched is not null").select("rid", "fetched", _bin(F.col("fetched")).alias("bin"), F.explode(F.array_distinct(keys_of(F.col("host"), F.col("url")))).alias("key"))
    active = (asked["key"] == spans["key"]) & (asked["bin"] == spans["bin"]) & (asked["fetched"] >= spans["since"]) & (spans["until"].isNull() | (asked["fetched"] < spans["until"]))
    hits = asked.join(spans, active).groupBy("rid").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("n_active"), F.min("since").alias("since"), F.max(F.col("verdict") == "allow").alias("allowed"),
    )
    status = F.when(F.col("host").isNull(), "unparsed").when(F.col("fetched").isNull(), "undated").when(F.col("n_active").isNull(), "clear").when(F.col("allowed"), "allowed").otherwise("blocked")
    return rows.join(hits, "rid", "left").select(F.col("doc").alias(id_col), "host", "fetched", status.alias("status"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "since")


def sample_events(pages: DataFrame) -> DataFrame:
    """Dated lists for the test tables: every host and domain of ``pages`` enters a list on a day that its digest sets.

    (The tables hold no lists.)  Entries leave 60 to 259 days later, and every third returns after 30 to 119 days.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    keys = hosts.select(F.concat(F.lit("host:"), "host").alias("key")).union(hosts.select(F.concat(F.lit("domain:"), F.substring_index("host", ".", -3)).alias("key")).distinct())
    h = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")
    keys = keys.withColumn("h", h).withColumn("a", F.date_add(F.lit("2024-01-01").cast("date"), F.col("h") % 400))
    keys = keys.withColumn("b", F.date_add("a", 60 + F.col("h") % 200)).withColumn("c", F.date_add("b", 30 + F.col("h") % 90))
    name = F.element_at(F.array(*map(F.lit, ("malware", "adult", "spam", "trusted"))), F.col("h") % 4 + 1)
    events = F.array(
        F.struct(F.col("a").alias("day"), F.lit("add").alias("action")), F.struct(F.col("b").alias("day"), F.lit("remove").alias("action")),
        F.when(F.col("h") % 3 == 0, F.struct(F.col("c").alias("day"), F.lit("add").alias("action"))),
    )
    return keys.withColumn("list", name).select("list", F.when(F.col("list") == "trusted", "allow").otherwise("block").alias("verdict"), "key", F.explode(events).alias("e")).where("e is not null").select("list", "verdict", "key", "e.day", "e.action")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day set by their number (the tables hold none): two years from 2024-01-01."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 730).cast("int")).alias("fetched"))


ORACLE = r"""
WITH c AS (
  SELECT page_id, lower(url) AS low, url,
         CAST(DATE '2024-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS DATE) AS fetched FROM pages),
h AS (
  SELECT *, nullif(regexp_replace(regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)', 1), '\.+$', ''), '') AS host FROM c),
k AS (
  SELECT DISTINCT 'host:' || host AS key FROM h WHERE host IS NOT NULL
  UNION
  SELECT DISTINCT 'domain:' || array_to_string(string_split(host, '.')[-3:], '.') FROM h WHERE host IS NOT NULL),
d AS (SELECT key, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) AS n FROM k),
a AS (SELECT key, n, CAST(DATE '2024-01-01' + n % 400 AS DATE) AS a FROM d),
b AS (SELECT *, CAST(a + (60 + n % 200) AS DATE) AS b FROM a),
s AS (
  SELECT key, n, a AS since, b AS until FROM b
  UNION ALL SELECT key, n, CAST(b + (30 + n % 90) AS DATE), NULL FROM b WHERE n % 3 = 0),
l AS (SELECT *, list_extract(['malware', 'adult', 'spam', 'trusted'], n % 4 + 1) AS list FROM s),
q AS (
  SELECT DISTINCT h.page_id, l.key, l.list, l.since FROM h JOIN l
    ON (l.key = 'host:' || h.host OR starts_with(l.key, 'domain:') AND ends_with('.' || h.host, '.' || substr(l.key, 8)))
   AND h.fetched >= l.since AND (l.until IS NULL OR h.fetched < l.until)),
g AS (
  SELECT page_id, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, count(*) AS n_active, CAST(min(since) AS VARCHAR) AS since,
         bool_or(list = 'trusted') AS allowed FROM q GROUP BY page_id)
SELECT h.page_id, h.host, CAST(h.fetched AS VARCHAR) AS fetched,
       CASE WHEN h.host IS NULL THEN 'unparsed' WHEN g.page_id IS NULL THEN 'clear' WHEN g.allowed THEN 'allowed' ELSE 'blocked' END AS status,
       coalesce(g.lists, '') AS lists, coalesce(g.n_active, 0) AS n_active, g.since
FROM h LEFT JOIN g ON h.page_id = g.page_id
"""

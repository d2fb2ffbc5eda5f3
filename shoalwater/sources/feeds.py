"""Fetching and unpacking: downloads, archives, pages of articles, registry lookups.

The transport is a parameter (any function from a request to status and body),
so everything is testable without a network, and nothing here runs inside a
query: feeds become files first, and tables are read from files.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.sources import snapshots

#: From (url, body or None) to (status, bytes).
Transport = Callable[[str, bytes | None], tuple[int, bytes]]
#: Words that keep a text out of a harmless corpus (fixed values).
SCAM_MARKERS = ("監管帳戶", "保證獲利", "穩賺", "包賺", "加賴", "加 line", "私訊領取", "私訊我", "投資群組", "帶你賺", "老師帶單", "內線", "博弈", "點數卡", "解除分期", "解除設定", "monitored")
#: Articles on a page.
PAGE = 100


def over_http(url: str, body: bytes | None = None, timeout: float = 60.0) -> tuple[int, bytes]:
    """The standard transport."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"} if body else {}), timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as failed:
        return failed.code, failed.read()


def download(url: str, name: str, transport: Transport = over_http) -> bytes:
    """The body of an answer of status 200 that is not empty; anything else raises an error that names the source."""
    status, body = transport(url, None)
    if status != 200:
        raise RuntimeError(f"{name}: status {status}")
    if not body:
        raise RuntimeError(f"{name}: an empty answer")
    return body


def fetch_all(sources: dict[str, str], transport: Transport = over_http) -> dict[str, bytes]:
    """Every source by name: lists, corpora, feeds, suffixes, registry endpoints; one failure fails all, so no half snapshot is made."""
    return {name: download(url, name, transport) for name, url in sources.items()}


def members(archives: DataFrame, member: str) -> DataFrame:
    """(path, line_no, value): the lines of one member of every ZIP archive of a binaryFile frame; an archive without it raises an error that lists its names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                if member not in archive.namelist():
                    raise ValueError(f"no {member} in the archive, only {archive.namelist()}")
                with archive.open(member) as lines:  # streamed, a slice of lines at a time
                    held, at = [], 0
                    for line in io.TextIOWrapper(lines, "utf-8"):
                        held.append(line.rstrip("\n"))
                        if len(held) == 65536:
                            yield pa.RecordBatch.from_pydict({"path": [path] * len(held), "line_no": list(range(at, at + len(held))), "value": held})
                            at, held = at + len(held), []
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(held), "line_no": pa.array(range(at, at + len(held)), pa.int64()), "value": pa.array(held, pa.string())})

    return archives.select("path", "content").mapInArrow(run, "path string, line_no long, value string")


def read_ranked_zip(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(domain, rank) of rank,domain lines inside an archive; ranks count from 1 in line order without gaps, blank lines aside."""
    lines = members(spark.read.format("binaryFile").load(path), member).where(F.trim("value") != "")
    ok = F.regexp_like("value", F.lit(r"^[0-9]+,\s*\S"))
    rows = snapshots.guarded(lines, ok, "a line that is not rank,domain").select("line_no", F.substring_index("value", ",", 1).cast("int").alias("rank"), F.trim(F.expr("substring(value, locate(',', value) + 1)")).alias("domain"))
    span = rows.agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d")).first()
    if span.n and (span.a != 1 or span.b != span.n or span.d != span.n):
        raise ValueError("ranks are not contiguous from 1")
    return rows.select("domain", "rank")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(answer) of a CSV corpus whose header begins with question, answer; a corpus without an answer raises an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if rows.columns[:2] != ["question", "answer"]:
        raise ValueError(f"the header is {rows.columns}")
    found = rows.select("answer").where("answer is not null")
    if found.isEmpty():
        raise ValueError("a corpus without answers")
    return found


def has_scam_marker(text: Column) -> Column:
    """Whether any of the marker words occurs, in either case."""
    return F.exists(F.array(*(F.lit(w.lower()) for w in SCAM_MARKERS)), lambda w: F.contains(F.lower(text), w))


def article_pages(query: str, selector: dict, url: str, transport: Transport = over_http, most: int | None = None) -> Iterator[list[dict]]:
    """Pages of articles, newest first, by cursor.

    The cursor of the last article leads on; one that stays, an article that
    came before, or any status but 200 raises an error.
    """
    cursor, seen = None, set()
    while most is None or len(seen) < most:
        status, body = transport(url, json.dumps({"query": query, "variables": {**selector, "first": PAGE, "after": cursor}}).encode())
        if status != 200:
            raise RuntimeError(f"articles: status {status}")
        edges = json.loads(body)["data"]["ListArticles"]["edges"]
        if not isinstance(edges, list):
            raise ValueError("edges is no list")
        if not edges:
            return
        page = [e["node"] for e in edges][: None if most is None else most - len(seen)]
        if again := seen & {n["id"] for n in page}:
            raise ValueError(f"articles came twice: {sorted(again)}")
        seen |= {n["id"] for n in page}
        yield page
        if edges[-1]["cursor"] == cursor:
            raise ValueError("the cursor does not advance")
        cursor = edges[-1]["cursor"]


def article_records(nodes: DataFrame) -> DataFrame:
    """(id, text, created_at, category_ids, reply_types) of articles; only categories and replies of status NORMAL count."""
    normal = lambda column, key: F.transform(F.filter(column, lambda x: x["status"] == "NORMAL"), lambda x: x[key])
    return nodes.select("id", "text", F.col("createdAt").alias("created_at"), normal("articleCategories", "categoryId").alias("category_ids"), normal("articleReplies", "replyType").alias("reply_types"))


def host_of(url: Column) -> Column:
    """The host that a feed's address names (with or without scheme), lower case, without www; none raises an error."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^.*?://", "")).otherwise(url)
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    port = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"^([^:]*):[^:]*$", "$1")
    host = F.regexp_replace(F.regexp_replace(F.lower(port), r"\.+$", ""), r"^www\.", "")
    return F.when(host != "", host).otherwise(F.raise_error(F.concat(F.lit("an address without a host: "), url)).cast("string"))


def lookups(domains: DataFrame, cache: DataFrame, endpoints: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """(domain, outcome, registered_on, source): registry answers from the cache while fresh, else from ``fetched`` (domain, status, payload).

    A domain whose top-level domain has no endpoint is UNSUPPORTED, one without an answer or a status
    other than 200 and 404 is FAILED, 404 is NOT_FOUND; ``endpoints`` has (tld, url).
    """
    from shoalwater.operators.presentation import registration

    live = snapshots.latest_lookups(cache, as_of).select("domain", "outcome", "registered_on")
    rows = domains.select("domain", F.substring_index("domain", ".", -1).alias("tld")).join(live, "domain", "left").join(endpoints.select("tld", "url"), "tld", "left").join(fetched, "domain", "left")
    answer = registration(F.col("payload"))
    fresh = F.when(F.col("url").isNull(), "UNSUPPORTED").when(F.col("status") == 200, answer["outcome"]).when(F.col("status") == 404, "NOT_FOUND").otherwise("FAILED")
    cached = F.col("outcome").isNotNull()
    return rows.select(
        "domain", F.coalesce("outcome", fresh).alias("outcome"), F.when(cached, F.col("registered_on")).when(F.col("url").isNotNull() & (F.col("status") == 200), answer["registered_on"]).alias("registered_on"), F.when(cached, "cache").otherwise("registry").alias("source"),
    )

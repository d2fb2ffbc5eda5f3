"""Queries that write what a source would deliver, derived from the test tables, and read it back through the readers."""

from __future__ import annotations

import bz2
import hashlib
import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions.weights import Weights
from shoalwater.operators import ngram, presentation, reporting, urls
from shoalwater.plans.text_queries import table
from shoalwater.scratch import Scratch, write_file
from shoalwater.sources import feeds, loaders, snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name with the same question in SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).root


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, host) of every page."""
    return table(spark, sf_dir, "pages").select("page_id", "url", feeds.host_of(F.col("url")).alias("host"))


_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '[.]+$', ''), '^www[.]', '')"


@query("SELECT doc_id, text, lang, (SELECT count(*) FROM documents) AS n FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines and back, with the number of lines that the writer saw."""
    path = _folder(spark, "jsonl")
    n = loaders.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return loaders.read_jsonl(spark, path, "doc_id long, text string, lang string").withColumn("n", F.lit(n).cast("long"))


@query("SELECT CAST(page_id AS VARCHAR) AS id, subset, (SELECT count(*) FROM pages) AS n_pool FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'cofacts_scam' ELSE 'cofacts_ham_ad' END AS subset FROM pages WHERE page_id % 3 <> 2)")
def test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of test samples by subset; a subset without a file is told, not made up."""
    folder = _folder(spark, "testset")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("text"), "page_id")
    for rest, subset in ((0, "cofacts_scam"), (1, "cofacts_ham_ad")):
        loaders.write_jsonl(rows.where(F.col("page_id") % 3 == rest).select("id", "text"), f"{folder}/{subset}.jsonl")
    found, missing = loaders.load_testset(spark, folder, ["cofacts_scam", "cofacts_ham_ad", "conversation_ham"])
    if missing != ["conversation_ham"]:
        raise ValueError(f"missing: {missing}")
    return found.select("id", "subset").withColumn("n_pool", F.lit(rows.count()))


@query(f"""SELECT host, source, count(*) AS n, 'title ' || source AS title, source = 'a' AS domain_level FROM (SELECT {_HOST} AS host, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM pages) GROUP BY host, source""")
def blocklist_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blocklist with its manifest through all guards: fields, checksum, sources, licences, age."""
    folder = _folder(spark, "blocklist")
    rows = hosts(spark, sf_dir).select("host", "url", F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("2024-01").alias("first_seen"), F.lit("2024-02").alias("last_seen"))
    rows.withColumns({c: F.lit(None).cast("string") for c in ("nature", "site_created_on", "target")}).coalesce(1).write.mode("overwrite").json(f"{folder}/entries.jsonl")
    part = spark.read.format("binaryFile").load(f"{folder}/entries.jsonl").first()
    write_file(spark, f"{folder}/list.jsonl", bytes(part.content))
    meta = {k: {"title": f"title {k}", "redistributable": True, "data_through": "2024-03-01", "domain_level_matching": k == "a"} for k in "ab"}
    write_file(spark, f"{folder}/manifest.json", json.dumps({"entries_file": "list.jsonl", "entries_sha256": hashlib.sha256(bytes(part.content)).hexdigest(), "sources": meta}).encode())
    found = snapshots.load_blocklist(spark, folder, "2024-03-10", {"a": 30, "b": 30})
    return found.groupBy("host", "source", "title", "domain_level").agg(F.count("*").alias("n"))


@query(f"SELECT host AS domain, rank FROM (SELECT host, row_number() OVER (ORDER BY host) AS rank FROM (SELECT DISTINCT {_HOST} AS host FROM pages)) WHERE rank <= 40")
def allowlist_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ranks out of a ZIP archive, kept up to a rank, with its manifest, and loaded again."""
    names = [r.host for r in hosts(spark, sf_dir).select("host").distinct().orderBy("host").collect()]  # the source: one small file
    folder, packed = _folder(spark, "ranks"), io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("top-1m.csv", "\n".join(f"{i},{n}" for i, n in enumerate(names, 1)) + "\n")
    write_file(spark, f"{folder}/list.zip", packed.getvalue())
    ranked = feeds.read_ranked_zip(spark, f"{folder}/list.zip", "top-1m.csv").where("rank <= 40")
    loaders.write_jsonl(ranked, f"{folder}/entries.jsonl")
    write_file(spark, f"{folder}/manifest.json", json.dumps({"threshold": 40, "data_through": "2024-03-01"}).encode())
    return loaders.load_allowlist(spark, folder, "2024-03-05", 30).select("domain", F.col("rank").cast("long").alias("rank"))


_FEED = f"(SELECT page_id, url, {_HOST} AS host FROM pages)"


@query(f"""SELECT source, host, count(*) AS n, min(seen) AS first_seen, max(seen) AS last_seen FROM (
  SELECT 'monthly' AS source, host, '2024-' || lpad(CAST(1 + page_id % 12 AS VARCHAR), 2, '0') AS seen FROM {_FEED} UNION ALL
  SELECT 'daily', host, CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS VARCHAR)[1:10] FROM {_FEED} UNION ALL SELECT 'reports', host, CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS VARCHAR)[1:10] FROM {_FEED} UNION ALL
  SELECT 'verified', host, CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS VARCHAR)[1:10] FROM {_FEED} UNION ALL SELECT 'plain', host, '2024-10-02' FROM {_FEED}) GROUP BY source, host""")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five list formats: month CSV, day CSV, JSON array, compressed feed of verified addresses, plain feed dated by its transfer."""
    folder = _folder(spark, "lists")
    rows = hosts(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    month = F.concat(F.lit("113"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"))
    csv = lambda df, name: df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    csv(rows.select(month.alias("民國年月"), F.col("host").alias("網域"), F.lit("").alias("網站性質")), "monthly")
    csv(rows.select(F.lit("x").alias("網站名稱"), F.concat("host", F.lit("/p")).alias("網址"), F.lit("2024/01/01").alias("統計起始日期"), F.date_format(day, "yyyy/MM/dd").alias("統計結束日期")), "daily")
    lines = rows.select("page_id", "host", "url", F.concat(F.lit("https://"), "host").alias("u"), F.date_format(day, "yyyy-MM-dd").alias("d")).orderBy("page_id").collect()  # the source: one small file
    text = "phish_id,url,submission_time,verified,verification_time,online,target\n" + "".join(f"{r.page_id},{r.u},{r.d}T00:00:00+00:00,yes,{r.d},yes,Other\n" for r in lines)
    reports = [{"編號": r.page_id, "偽冒網址": r.url, "網域名稱": r.host, "詐騙網站創建日期": "20230101", "接獲通報日期": r.d.replace("-", "")} for r in lines]
    write_file(spark, f"{folder}/reports", json.dumps(reports, ensure_ascii=False, indent=1).encode())
    write_file(spark, f"{folder}/verified.csv.bz2", bz2.compress(text.encode()))
    rows.select(F.concat(F.lit("https://"), "host").alias("value")).write.mode("overwrite").text(f"{folder}/plain")
    seen = spark.range(1).select(snapshots.http_date(F.lit("Wed, 02 Oct 2024 10:00:00 GMT")).cast("string")).first()[0]
    parts = [
        snapshots.parse_monthly_csv(spark, f"{folder}/monthly", "monthly"), snapshots.parse_daily_csv(spark, f"{folder}/daily", "daily"), snapshots.parse_reports_json(spark, f"{folder}/reports", "reports"),
        snapshots.parse_verified_csv(spark, f"{folder}/verified.csv.bz2", "verified"), snapshots.parse_plain_feed(spark, f"{folder}/plain", "plain", seen),
    ]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p, allowMissingColumns=True)
    counts = all_.groupBy("source", "host").agg(F.count("*").alias("n"))
    return snapshots.merge_entries(all_).select("source", "host", "first_seen", "last_seen").join(counts, ["source", "host"])


@query(f"""SELECT host, source, url FROM (SELECT host, 'b' AS source, min(url) AS url FROM {_FEED} GROUP BY host UNION ALL SELECT host, 'a', 'new' FROM {_FEED} WHERE page_id % 5 = 0 GROUP BY host)""")
def snapshot_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged list of which one source is replaced, written beside the old snapshot and swapped in."""
    path = _folder(spark, "swap") + "/list"
    old = hosts(spark, sf_dir).groupBy("host").agg(F.min("url").alias("url")).withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"))))
    n = snapshots.write_snapshot(old.select("host", "source", "url"), path)
    fresh = hosts(spark, sf_dir).where("page_id % 5 = 0").select("host").distinct().select("host", F.lit("a").alias("source"), F.lit("new").alias("url"))
    kept = spark.read.schema("host string, source string, url string").json(path)
    snapshots.write_snapshot(snapshots.replace_sources(kept, fresh).select("host", "source", "url"), path, n)
    return spark.read.schema("host string, source string, url string").json(path)


@query("SELECT doc_id, 'answer ' || doc_id || chr(10) || 'line \"two\", end' AS answer FROM documents WHERE doc_id % 4 <> 3")
def answer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a CSV corpus with line feeds, quotes and empty fields."""
    path = _folder(spark, "corpus") + "/qa.csv"
    answer = F.when(F.col("doc_id") % 4 != 3, F.concat(F.lit("answer "), F.col("doc_id"), F.lit('\nline "two", end')))
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("question"), answer.alias("answer")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return feeds.read_answers(spark, path).select(F.regexp_extract("answer", "answer ([0-9]+)", 1).cast("long").alias("doc_id"), "answer")


#: Bytes of text that the driver holds at once, about, while it plays a service and its client.
AT_ONCE = 8 << 20


def _in_order(rows: DataFrame, key: str, text: str) -> Iterator[Row]:
    """All rows by ``key``, from ranges of about AT_ONCE bytes; the driver fetches one range at a time."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    return rows.repartitionByRange(1 + size // AT_ONCE, key).sortWithinPartitions(key).toLocalIterator()


def _lines(pages: Iterable[list[dict]]) -> Iterator[bytes]:
    """JSON lines of all pages, in pieces of about AT_ONCE bytes; no pages, no lines: one empty piece."""
    held, size = [], 0
    for page in pages:
        held.append("".join(json.dumps(n, ensure_ascii=False) + "\n" for n in page).encode())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN doc_id % 2 = 0 THEN 'c1' ELSE '' END AS categories, CASE WHEN doc_id % 3 = 0 THEN 'RUMOR' ELSE '' END AS replies FROM documents")
def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by cursor from pages of 100, only categories and replies that still stand."""
    docs = _in_order(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")  # plays the remote service
    served = None

    def service(url: str, body: bytes) -> tuple[int, bytes]:
        nonlocal served
        after = json.loads(body)["variables"]["after"]
        if after != served:
            raise ValueError(f"the service goes forward only: {after} after {served}")
        at = 0 if after is None else int(after) + 1
        edges = [{"cursor": str(at + i), "node": {
            "id": str(d), "text": t, "createdAt": "2024-01-01", "articleCategories": [{"categoryId": "c1", "status": "NORMAL" if d % 2 == 0 else "DELETED"}], "articleReplies": [{"replyType": "RUMOR", "status": "NORMAL" if d % 3 == 0 else "DELETED"}],
        }} for i, (d, t) in enumerate(islice(docs, feeds.PAGE))]
        served = edges[-1]["cursor"] if edges else served
        return 200, json.dumps({"data": {"ListArticles": {"edges": edges}}}).encode()

    folder = _folder(spark, "articles")
    for i, lines in enumerate(_lines(feeds.article_pages("query", {}, "https://service", service))):
        write_file(spark, f"{folder}/{i:05d}.jsonl", lines)
    nodes = loaders.read_jsonl(spark, folder, "id string, text string, createdAt string, articleCategories array<struct<categoryId:string,status:string>>, articleReplies array<struct<replyType:string,status:string>>")
    return feeds.article_records(nodes).select("id", "text", F.array_join("category_ids", ",").alias("categories"), F.array_join("reply_types", ",").alias("replies"))


_KIND = ("KNOWN", "NOT_FOUND", "FAILED", "UNSUPPORTED")


@query("""SELECT 'd' || page_id || '.' || ['com', 'net', 'zz'][page_id % 3 + 1] AS domain,
  CASE WHEN page_id % 7 = 0 THEN 'KNOWN' WHEN page_id % 3 = 2 THEN 'UNSUPPORTED' WHEN page_id % 4 = 0 THEN 'NOT_FOUND' WHEN page_id % 4 = 1 THEN 'FAILED' ELSE 'KNOWN' END AS outcome,
  CASE WHEN page_id % 7 = 0 THEN '2020-01-01' WHEN page_id % 3 = 2 OR page_id % 4 < 2 THEN NULL ELSE '2021-06-05' END AS registered_on, CASE WHEN page_id % 7 = 0 THEN 'cache' ELSE 'registry' END AS source FROM pages""")
def registry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration days: fresh cache rows first, then registry answers by endpoint; expired rows don't count."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("d"), F.col("page_id"), F.lit("."), F.get(F.array(*map(F.lit, ("com", "net", "zz"))), (F.col("page_id") % 3).cast("int"))).alias("domain"))
    services = spark.createDataFrame([(0, ["com"], ["http://old", "https://com.registry/"]), (1, ["net", "com"], ["https://net.registry/"]), (2, ["zz"], ["http://plain"])], "position int, tlds array<string>, urls array<string>")
    old = pages.where("page_id % 7 = 0").select("domain", F.lit("FAILED").alias("outcome"), F.lit(None).cast("string").alias("registered_on"), F.lit("2024-05-01").alias("fetched_at"))
    fresh = pages.where("page_id % 7 = 0").select("domain", F.lit("KNOWN").alias("outcome"), F.lit("2020-01-01").alias("registered_on"), F.lit("2024-05-20").alias("fetched_at"))
    stale = pages.where("page_id % 7 = 1").select("domain", F.lit("FAILED").alias("outcome"), F.lit(None).cast("string").alias("registered_on"), F.lit("2024-01-01").alias("fetched_at"))
    cache = snapshots.put_lookups(old.unionByName(stale), fresh).withColumn("registered_on", F.to_date("registered_on"))
    fetched = pages.select("domain", F.when(F.col("page_id") % 4 == 0, 404).when(F.col("page_id") % 4 == 1, 500).otherwise(200).alias("status"), F.lit('{"events":[{"eventAction":"registration","eventDate":"2021-06-05T00:00:00Z"}]}').alias("payload"))
    found = feeds.lookups(pages.select("domain"), cache, presentation.lookup_endpoints(services), fetched, "2024-06-01")
    return found.withColumn("registered_on", F.col("registered_on").cast("string"))


@query("""WITH t AS (SELECT DISTINCT regexp_extract(url, '([a-z]+)(?:[:/?#]|$)', 1) AS x FROM pages) SELECT 4 AS delegated, 2 AS covered, 2 AS missing, 1 AS missing_two_letter, (SELECT count(*) FROM pages) AS n""")
def endpoint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many top-level domains have a registry endpoint."""
    tlds = spark.createDataFrame([("com",), ("net",), ("tw",), ("shop",)], "tld string")
    services = spark.createDataFrame([(0, ["COM"], ["https://a/"]), (1, ["net"], ["https://b/"]), (2, ["tw"], ["http://c/"])], "position int, tlds array<string>, urls array<string>")
    return reporting.endpoint_coverage(tlds, presentation.lookup_endpoints(services)).withColumn("n", F.lit(table(spark, sf_dir, "pages").count()))


# ---------------------------------------------------------------- configuration tables


def weights_toml(weights: Weights) -> str:
    """A weight table as TOML: measured weights with probabilities that give them, the others as placeholders."""
    import math

    def sub(value: float) -> dict:
        if value in loaders.PLACEHOLDERS:
            return {"value": value, "basis": "placeholder", "inherited_from": "a first guess", "blocked_on": "samples"}
        ham = 0.01 if value > 0 else 0.5
        return {"value": value, "basis": "measured", "p_hit_given_scam": ham * math.exp(value), "p_hit_given_ham": ham, "measured_on": "tune"}

    lines = []
    for name, group, soft, hard, strong in weights.signals:
        lines += ["[[signal]]", f'name = "{name}"', f'group = "{group}"', f"hard_capable = {str(hard is not None).lower()}", f"strong = {str(strong).lower()}"]
        for key, value in (("weight_soft", soft), ("weight_hard", hard)):
            if value is not None:
                lines += [f"[signal.{key}]", *(f"{k} = {json.dumps(v)}" for k, v in sub(value).items())]
    groups: dict[str, int] = {}
    for s in weights.signals:
        groups[s[1]] = groups.get(s[1], 0) + 1
    lines += ["[group_rationale]", *(f'{g} = "one act makes them hit together"' for g, n in groups.items() if n > 1)]
    lines += ["[roles]", f'quotation = "{weights.quotation}"', f'relationship = "{weights.relationship}"', f'blocklist_exact = "{weights.blocklist}"']
    for key, value in weights.thresholds.items():
        lines += [f"[thresholds.{key}]", f"value = {value}", 'basis = "placeholder"', 'rationale = "chosen"', 'blocked_on = "samples"']
    for i, (name, _) in enumerate(weights.categories):
        lines += ["[[type_priority]]", f'name = "{name}"', f"cases = {1000 - i}", 'source = "statistics"']
    return "\n".join(lines) + "\n"


_ROWS = ", ".join(f"('{n}', '{g}', {str(h).lower()}, {w}, {str(s).lower()})" for n, g, h, w, s in Weights().rows())


@query(f"SELECT name, grp, hard, weight::DOUBLE AS weight, strong, (SELECT count(*) FROM documents) AS n FROM (VALUES {_ROWS}) AS v(name, grp, hard, weight, strong)")
def weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight table from TOML after every check, one row for each name and hardness."""
    folder = _folder(spark, "weights")
    write_file(spark, f"{folder}/weights.toml", weights_toml(Weights()).encode())
    return loaders.load_weights(spark, f"{folder}/weights.toml").frame(spark).withColumn("n", F.lit(table(spark, sf_dir, "documents").count()))


@query("SELECT name, hard, round(w, 6)::DOUBLE AS weight FROM (VALUES ('solicit_otp', false, ln(0.25 / 0.125)), ('solicit_otp', true, ln(0.5 / 0.03125)), ('quotation', false, ln(0.1 / 0.4))) AS v(name, hard, w) WHERE (SELECT count(*) FROM documents) > 0")
def weights_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured weights written back into the table's text, which still passes every check."""
    measured = {("solicit_otp", False): (0.25, 0.125), ("solicit_otp", True): (0.5, 0.03125), ("quotation", False): (0.1, 0.4)}
    text = loaders.render_weights(weights_toml(Weights()), measured, "tune")
    if loaders.measured_probabilities(text, "solicit_otp") != (0.25, 0.125) or table(spark, sf_dir, "documents").isEmpty():
        raise ValueError("probabilities are lost")
    rows = loaders.parse_weights(text).frame(spark)
    return rows.where("(name = 'solicit_otp') or (name = 'quotation')").select("name", "hard", "weight")


_SHORT, _RISKS = (("bit.ly", "Bitly"), ("reurl.cc", "reurl")), (("top", 310.5), ("xyz", 120.0))


@query("SELECT kind, name, value FROM (VALUES " + ", ".join([*(f"('brand', '{n}', '{d}')" for n, d, _ in urls.BRANDS), *(f"('shortener', '{d}', '{s}')" for d, s in _SHORT), *(f"('tld', '{t}', '{v}')" for t, v in _RISKS), "('baseline', 'com', '10.0')"]) + ") AS v(kind, name, value) WHERE (SELECT count(*) FROM pages) > 0")
def lookup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, shorteners and risky top-level domains from their files."""
    folder, note = _folder(spark, "tables"), {"source": "s", "verified_on": "2024-01-01"}
    write_file(spark, f"{folder}/brands.json", json.dumps({"brands": [{"chinese_name": n, "english_name": n, "official_domains": d.split(), "label_tokens": t.split(), **note} for n, d, t in urls.BRANDS]}).encode())
    write_file(spark, f"{folder}/shorteners.json", json.dumps({"shorteners": [{"domain": d, "service": s, **note} for d, s in _SHORT]}).encode())
    write_file(spark, f"{folder}/tld_risk.json", json.dumps({"tlds": [{"tld": t, "metric": "m", "value": v, "as_of": "2024", "source": "s"} for t, v in _RISKS], "baseline": {"tld": "com", "value": 10.0}}).encode())
    found = loaders.load_tables(spark, folder)
    rows = [("brand", n, d) for n, d, _ in found.brands] + [("baseline", found.baseline[0], str(found.baseline[1]))]
    listed = spark.createDataFrame(rows, "kind string, name string, value string").union(found.shorteners.select(F.lit("shortener"), "domain", "service")).union(found.tld_risks.select(F.lit("tld"), "tld", F.col("value").cast("string")))
    return listed if not table(spark, sf_dir, "pages").isEmpty() else listed.limit(0)


MANIFEST = {"trained_on": "x", "testset_manifest_sha256": "0", "n_scam": 1, "n_ham": 1, "sklearn_version": "-", "max_features": 3, "value_decimals": 4, "threshold": 0.1}


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  c AS (SELECT doc_id, len(string_split(' ' || array_to_string(list_filter(regexp_split_to_array(lower(t), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> ''), '  ') || ' ', 'th')) - 1 AS a FROM d)
  SELECT doc_id, round(CASE WHEN a > 0 THEN 0.8 ELSE 0 END - 0.25, 6)::DOUBLE AS score FROM c""")
def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of one gram, written with its manifest, loaded through its guards, and applied."""
    folder = _folder(spark, "model")
    own = ngram.Model((("th", 1.23456789, 0.8),), -0.25, (2, 2))
    write_file(spark, f"{folder}/model.json", loaders.render_model(own, MANIFEST).encode())
    loaded = loaders.load_model(spark, f"{folder}/model.json")
    if loaded.terms != (("th", 1.2346, 0.8),):
        raise ValueError(f"terms: {loaded.terms}")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("req_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ngram.gram_scores(texts, loaded).select(F.col("req_id").alias("doc_id"), F.round("ngram_score", 6).alias("score"))


_PSL = "// ===BEGIN ICANN DOMAINS===\ncom\nnet\norg\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nexample.org\n// ===END PRIVATE DOMAINS===\n"


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), s AS (SELECT host, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'example.org' ELSE string_split(host, '.')[-1] END AS suffix FROM h)
  SELECT host, suffix, CASE WHEN host = suffix THEN NULL ELSE string_split(host[1:length(host) - length(suffix) - 1], '.')[-1] || '.' || suffix END AS domain FROM s""")
def suffix_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suffix list through checksum, age and rule count, applied to every host."""
    folder = _folder(spark, "suffixes")
    write_file(spark, f"{folder}/suffixes.dat", _PSL.encode())
    write_file(spark, f"{folder}/manifest.json", json.dumps({"sha256": hashlib.sha256(_PSL.encode()).hexdigest(), "fetched_at": "2024-03-01", "rule_count": 4}).encode())
    found = loaders.load_suffixes(spark, folder, "2024-03-02", 30)
    return urls.registrable_domains(hosts(spark, sf_dir).select("host").distinct(), found.frame(spark)).select("host", "suffix", F.col("registrable_domain").alias("domain"))


@query("SELECT 'degraded' AS status, 3 AS checks, 'url_blocklist: stale' AS unregistered, 'old' AS stale, 36 AS signals, (SELECT count(*) FROM pages) AS n")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a service would be healthy: checks, what is missing and why, stale sources, the oldest date."""
    sources = spark.createDataFrame([("new", "2024-05-30", False, 7), ("old", "2024-01-01", False, 7), ("gone", "2020-01-01", True, None)], "source string, data_through string, retired boolean, max_age_days int")
    if str(reporting.data_through(sources).first()[0]) != "2020-01-01":
        raise ValueError("not the oldest date")
    found = presentation.health(spark.createDataFrame([(n,) for n in "abc"], "name string"), spark.createDataFrame([("url_blocklist", "stale")], "name string, reason string"), presentation.freshness(sources, "2024-06-01"), len(Weights().signals))
    told = F.array_join(F.transform("unregistered", lambda x: F.concat(x["name"], F.lit(": "), x["reason"])), ",")
    return found.select("status", "checks", told.alias("unregistered"), F.array_join("stale", ",").alias("stale"), F.col("signals").cast("long").alias("signals")).withColumn("n", F.lit(table(spark, sf_dir, "pages").count()))

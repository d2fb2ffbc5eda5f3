"""Link queries over ``pages``, with their SQL.  Lists are fixed values that fit the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.operators import document, urls
from shoalwater.plans.text_queries import table

SUFFIXES = urls.Suffixes((("com", "normal", "icann"), ("net", "normal", "icann"), ("org", "normal", "icann"), ("*.example.net", "wildcard", "private"), ("tionsh.example.net", "exception", "private"), ("example.org", "normal", "private")))
BLOCKLIST = [
    ("blog.tionble.example.com", "example.com", "176455", "list A", "2024-03-01", None, None, True), ("ththre.example.com", "example.com", "phishtank", "feed B", "2024-02-01", None, "brand", False),
    ("spam-farm.example.org", "spam-farm.example.org", "160055", "list C", "2024-01-01", "invest", None, True), ("m.thther.example.org", "thther.example.org", "165027", "list D", "2024-04-01", None, None, True),
]
ALLOWLIST = [("thther.example.org", 7), ("ththth.example.org", 9)]
SHORTENERS = [("ththon.example.com", "svc"), ("tionsh.example.net", "svc2"), ("ththan.example.net", "svc3")]
RISKS = [("org", 310.0, "src", "2024"), ("net", 296.0, "src", "2024")]
BRANDS = [("tionsh", "tionsh.example.com thther.example.net", "tionsh"), ("ththre", "ththze.example.com", "pills"), ("shop", "theth1e.example.com", "")]


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as messages that mention their link."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("req_id"), F.lit(0).alias("msg_idx"), F.lit(None).cast("string").alias("sender"), F.concat(F.lit("tionsh says see "), "url", F.lit(" now!")).alias("text"))


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sentences, links) of page messages."""
    found = document.sentences_of(document.analysed_messages(page_messages(spark, sf_dir)))
    return found, urls.extract_urls(found, SUFFIXES)


def url_host_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, scheme and flags of every link."""
    return links(spark, sf_dir)[1].select(F.col("req_id").alias("page_id"), "url", "host", "is_ip", "has_userinfo", "scheme_present")


def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public suffix and registrable domain of every host."""
    hosts = links(spark, sf_dir)[1].select("host").distinct()
    return urls.registrable_domains(hosts, SUFFIXES.frame(spark))


def blocklist_match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page's domain stands on the blocklist."""
    black = spark.createDataFrame(BLOCKLIST, "host string, registrable_domain string, source string, title string, last_seen string, nature string, target string, domain_level boolean")
    allow = spark.createDataFrame(ALLOWLIST, "domain string, rank int")
    rows = urls.blocklist_matches(urls.by_domain(links(spark, sf_dir)[1]), black, allow, ["ththon.example.com"])
    return rows.select(F.col("req_id").alias("page_id"), "registrable_domain", "level", "hard", F.size("entries").cast("long").alias("n_entries"))


def shortener_and_tld_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened links, and domains under risky top-level domains."""
    found = links(spark, sf_dir)[1]
    short = urls.shortener_signals(found, spark.createDataFrame(SHORTENERS, "domain string, service string"), 0)
    risky = urls.tld_signals(urls.by_domain(found), spark.createDataFrame(RISKS, "tld string, value double, source string, as_of string"), [d for d, _ in SHORTENERS], 1)
    return short.unionByName(risky).select(F.col("req_id").alias("page_id"), "name", "detail")


def host_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with an odd host; the test tables have some with user information at most."""
    return urls.shape_signals(links(spark, sf_dir)[1], 0).groupBy(F.col("req_id").alias("page_id")).agg(F.count("*").alias("n"))


def brand_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that carry a brand's token or nearly its label."""
    rows = urls.brand_host_findings(links(spark, sf_dir)[1], urls.brand_table(spark, BRANDS))
    return rows.select(F.col("req_id").alias("page_id"), "brand", F.col("token").isNotNull().alias("by_token"), F.col("near.label").alias("label"), F.col("near.distance").cast("long").alias("distance"))


def brand_mention_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that mention a brand but link only elsewhere."""
    found, own = links(spark, sf_dir)
    rows = urls.brand_signals(own, found, urls.brand_table(spark, BRANDS), 0).where(F.startswith("detail", F.lit("第 ")))
    return rows.select(F.col("req_id").alias("page_id"), F.size("evidence").cast("long").alias("n_evidence"))


def merge_snapshot_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a feed, merged by host: first and last seen, first URL."""
    from shoalwater.sources.snapshots import merge_entries

    feed = table(spark, sf_dir, "pages").select(
        F.lit("feed").alias("source"), F.lower(F.regexp_extract("url", "://([^/:?#]+)", 1)).alias("host"), "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).cast("string").alias("seen"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("n"), (F.col("page_id") % 2).cast("string"))).alias("nature"), F.lit(None).cast("string").alias("site_created_on"), F.col("page_id").alias("ord"),
    )
    return merge_entries(feed).select("host", "url", "first_seen", "last_seen", "nature")


QUERIES = {f.__name__: f for f in (url_host_parts, registrable_domain, blocklist_match_levels, shortener_and_tld_risk, host_shape, brand_edit_distance, brand_mention_mismatch, merge_snapshot_hosts)}

_URL = r"""
u0 AS (SELECT page_id, 'tionsh says see ' || url || ' now' AS t, regexp_extract(url, '(?i)(https?://[^ <>"'')]+)', 1) AS raw FROM pages),
u1 AS (SELECT page_id, regexp_replace(raw, '[!?;.,:]+$', '') AS raw FROM u0),
u2 AS (SELECT page_id, lower(regexp_extract(raw, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(raw, '^[A-Za-z]+://([^/?#]*)', 1) AS auth, regexp_extract(raw, '^[A-Za-z]+://[^/?#]*(.*)$', 1) AS tail FROM u1),
u3 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]+$', '')), '^[.]+|[.]+$', '', 'g'), '^www\.', '') AS host, regexp_extract(auth, '(:[0-9]+)$', 1) AS port FROM u2),
u AS (SELECT page_id, scheme || '://' || host || port || tail AS url, host, regexp_matches(host, '^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$') AS is_ip, contains(auth, '@') AS has_userinfo, true AS scheme_present FROM u3 WHERE host <> '')
"""


def _values(rows, names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f"'{v}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


_DOMAIN = rf"""
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM u),
t AS (SELECT host, l, generate_subscripts(l, 1) AS i FROM h),
t2 AS (SELECT host, l, i, array_to_string(l[i:], '.') AS tail, '*' || CASE WHEN i < len(l) THEN '.' || array_to_string(l[i + 1:], '.') ELSE '' END AS starred, array_to_string(l[i + 1:], '.') AS less FROM t),
r AS (SELECT * FROM {_values(SUFFIXES.rules, "suffix, kind, section")}),
m AS (SELECT host, i, coalesce(CASE WHEN e.kind = 'exception' THEN less END, tail) AS suffix FROM t2 LEFT JOIN r e ON e.suffix = tail AND e.kind <> 'wildcard' LEFT JOIN r w ON w.suffix = starred AND w.kind = 'wildcard'
      WHERE e.kind IS NOT NULL OR w.kind IS NOT NULL),
b AS (SELECT h.host, h.l, coalesce(arg_min(m.suffix, m.i), h.l[len(h.l)]) AS suffix FROM h LEFT JOIN m ON m.host = h.host GROUP BY h.host, h.l),
d AS (SELECT host, suffix, CASE WHEN NOT regexp_matches(host, '^(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') AND len(l) > len(string_split(suffix, '.')) THEN array_to_string(l[len(l) - len(string_split(suffix, '.')):], '.') END AS registrable_domain FROM b)
"""
_BRANDS = "(VALUES " + ", ".join(f"({i}, '{n}', {d.split()!r}, {t.split()!r})" if t else f"({i}, '{n}', {d.split()!r}, CAST([] AS VARCHAR[]))" for i, (n, d, t) in enumerate(BRANDS)) + ") AS v(brand_no, brand, official, tokens)"
_FOLD = "translate(replace({}, 'rn', 'm'), '01', 'ol')"
ORACLES = {
    "url_host_parts": f"WITH {_URL} SELECT * FROM u",
    "registrable_domain": f"WITH {_URL}, {_DOMAIN} SELECT host, suffix, registrable_domain FROM d",
    "blocklist_match_levels": f"""WITH {_URL}, {_DOMAIN},
      bl AS (SELECT * FROM {_values(BLOCKLIST, "host, registrable_domain, source, title, last_seen, nature, target, domain_level")}), al AS (SELECT * FROM {_values(ALLOWLIST, "domain, rank")}),
      p AS (SELECT page_id, d.registrable_domain AS rd, u.host FROM u JOIN d ON d.host = u.host WHERE d.registrable_domain IS NOT NULL),
      x AS (SELECT page_id, rd, count(*) AS n, bool_or(bl.host = rd) AS apex, bool_or(source IN ('176455', '160055', '165027')) AS official FROM p JOIN bl ON bl.host = p.host GROUP BY ALL),
      y AS (SELECT registrable_domain AS rd, count(*) AS n FROM bl WHERE domain_level GROUP BY 1)
      SELECT p.page_id, p.rd AS registrable_domain, CASE WHEN x.n IS NOT NULL THEN 'exact' ELSE 'neighbour' END AS level,
      CASE WHEN x.n IS NOT NULL THEN official AND NOT (rank IS NOT NULL AND NOT apex) ELSE false END AS hard, coalesce(x.n, y.n) AS n_entries
      FROM p LEFT JOIN x ON x.page_id = p.page_id AND x.rd = p.rd LEFT JOIN y ON y.rd = p.rd LEFT JOIN al ON al.domain = p.rd
      WHERE x.n IS NOT NULL OR (y.n IS NOT NULL AND rank IS NULL AND p.rd <> 'ththon.example.com')""",
    "shortener_and_tld_risk": f"""WITH {_URL}, {_DOMAIN}, p AS (SELECT u.page_id, u.url, d.registrable_domain AS rd FROM u JOIN d ON d.host = u.host WHERE d.registrable_domain IS NOT NULL),
      sh AS (SELECT * FROM {_values(SHORTENERS, "domain, service")}), ri AS (SELECT * FROM {_values(RISKS, "tld, value, source, as_of")})
      SELECT page_id, 'url_shortener' AS name, '短網址 ' || url || '（' || service || '），目的地未知；黑名單、TLD 風險與網域年齡對此連結不具資訊量' AS detail FROM p JOIN sh ON sh.domain = rd
      UNION ALL SELECT DISTINCT page_id, 'url_tld_risk', '網域 ' || rd || ' 的 TLD .' || tld || ' 每萬網域的釣魚分數為 ' || CAST(CAST(value AS DOUBLE) AS VARCHAR) || '（' || source || '，' || as_of || '），約為 .com（29.6）的 ' || CAST(round(value / 29.6) AS INTEGER) || ' 倍'
      FROM p JOIN ri ON ri.tld = regexp_extract(rd, '([^.]+)$', 1) WHERE rd NOT IN (SELECT domain FROM sh)""",
    "host_shape": f"WITH {_URL} SELECT page_id, sum(is_ip::INT + has_userinfo::INT)::BIGINT AS n FROM u GROUP BY 1 HAVING sum(is_ip::INT + has_userinfo::INT) > 0",
    "brand_edit_distance": f"""WITH {_URL}, {_DOMAIN}, p AS (SELECT u.page_id, u.url, u.host, d.registrable_domain AS rd FROM u JOIN d ON d.host = u.host WHERE d.registrable_domain IS NOT NULL),
      b2 AS (SELECT * FROM {_BRANDS}),
      q AS (SELECT page_id, brand, official, rd, len(list_filter(official, lambda x: contains(host, x))) + len(list_filter(tokens, lambda x: contains(host, x))) > 0 AS by_token FROM p, b2 WHERE NOT list_contains(official, rd)),
      o AS (SELECT page_id, brand, by_token, rd, string_split(unnest(official), '.')[1] AS label, generate_subscripts(official, 1) AS i FROM q WHERE NOT by_token),
      e AS (SELECT *, levenshtein({_FOLD.format("string_split(rd, '.')[1]")}, {_FOLD.format("label")}) AS distance FROM o WHERE length(label) >= 5),
      n AS (SELECT page_id, brand, arg_min(label, distance * 100 + i) AS label, min(distance) AS distance FROM e WHERE distance <= CASE WHEN length(label) <= 8 THEN 1 ELSE 2 END GROUP BY ALL)
      SELECT page_id, brand, true AS by_token, NULL AS label, NULL::BIGINT AS distance FROM q WHERE by_token UNION ALL SELECT page_id, brand, false, label, distance FROM n""",
    "brand_mention_mismatch": f"""WITH {_URL}, {_DOMAIN} SELECT u.page_id, 2::BIGINT AS n_evidence FROM u JOIN d ON d.host = u.host, (SELECT * FROM {_BRANDS}) b
      WHERE (contains('tionsh says see ' || u.url, b.brand) OR contains((SELECT min(p.url) FROM pages p WHERE p.page_id = u.page_id), b.brand)) AND NOT coalesce(list_contains(b.official, d.registrable_domain), false)""",
    "merge_snapshot_hosts": """WITH f AS (SELECT lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host, url, CAST(CAST(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER) AS DATE) AS VARCHAR) AS seen,
      CASE WHEN page_id % 3 = 0 THEN 'n' || CAST(page_id % 2 AS VARCHAR) END AS nature, page_id AS ord FROM pages)
      SELECT host, arg_min(url, ord) AS url, min(seen) AS first_seen, max(seen) AS last_seen, arg_min(nature, ord) FILTER (nature IS NOT NULL) AS nature FROM f GROUP BY host""",
}

"""Secrets, told from copied examples by how many owners they have.

Candidates are found by patterns in every text.  Their digests (never the
secrets themselves) are aggregated over the whole corpus by distinct
repositories and owners.  A candidate that many owners have, or that stands in
many repositories (however few own them), is a widely copied example; one that
few of both have and that looks random is live-looking.
Spans of the three base kinds always stay; the two wider kinds (keys with a
provider's prefix, and long mixed-case tokens) are added only where live-looking.

Plan.  One scan extracts spans as expressions and writes a row per document
without its text.  Frequencies aggregate in three steps (owner and repository,
owner, digest), each with map-side combination, so a key that a third of all
documents hold is never gathered.  Verdicts join back on the digest between
written tables, whose hot keys are split.  Functions are built-in throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.llm.spans import ignoring_case, listed, matches
from shoalwater.scratch import Scratch

KINDS = ("assign", "access", "hex", "provider", "opaque")
_WORDS = "(?:" + "|".join(map(ignoring_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
_LEAD = _WORDS + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = _LEAD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
#: Runs of 24 or more are exactly the runs of any length that are not dropped.
HEX = "[0-9a-f]{24,}"
#: Public prefixes of issued keys (fixed values).
PROVIDER = "(?:ghp_|gho_|ghs_|glpat-|xoxb-|xoxp-|sk_live_|rk_live_|AIza|SG\\.)[A-Za-z0-9_.-]{16,}"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
_CANDIDATE = "array<struct<kind:int,start:int,end:int,digest:string,looks:boolean>>"


def looks_random(value: Column) -> Column:
    """Many different characters, and no word that examples are made of."""
    variety = F.size(F.array_distinct(F.split(value, "")))
    placeholder = F.regexp_like(value, F.lit("(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234567"))
    return (variety >= 8) & ~placeholder


def candidates(text: str) -> Column:
    """All candidate spans of the column ``text``, unordered across kinds."""

    def make(kind: int):
        return lambda start, end, value, before, after: F.struct(
            F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.sha2(value, 256).alias("digest"), looks_random(value).alias("looks"), F.length(value).alias("size"), value.alias("value"), before.alias("before"),
        )

    full = "array<struct<kind:int,start:int,end:int,digest:string,looks:boolean,size:int,value:string,before:string>>"

    def of(kind: int, pattern: str, group: int, fits, hint: str = "true") -> Column:
        found = F.filter(matches(text, pattern, make(kind), full, group, hint), fits)
        return F.transform(found, lambda c: F.struct(*(c[n].alias(n) for n in ("kind", "start", "end", "digest", "looks"))))

    mixed = lambda c: F.regexp_like(c["value"], F.lit("[0-9]")) & F.regexp_like(c["value"], F.lit("[a-z]")) & F.regexp_like(c["value"], F.lit("[A-Z]"))
    assigned = lambda c: F.regexp_like(c["before"], F.lit(_LEAD + "$"))
    return F.concat(
        of(0, ASSIGN, 1, lambda c: c["size"] >= 6),
        of(1, ACCESS, 0, lambda c: c["size"] >= 20, f"contains({text}, 'AKIA')"),
        of(2, HEX, 0, lambda c: F.lit(True)),
        of(3, PROVIDER, 0, lambda c: ~assigned(c)),
        of(4, OPAQUE, 0, lambda c: mixed(c) & ~assigned(c) & ~F.regexp_like(c["value"], F.lit("AKIA|^(?:" + PROVIDER + ")"))),
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, most_owners: int = 2, most_repos: int = 8) -> DataFrame:
    """One row per row of ``docs``: (id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example).

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then
    kind; ``base_sha256`` digests the list of base spans.  A candidate value is
    an example if more than ``most_owners`` owners have it or if it stands in
    more than ``most_repos`` repositories, counted over all owners;
    ``n_example`` and ``n_live`` count this row's candidates of either sort.
    Without ``repo_col`` each document is its own repository.  A null text counts as empty (no
    spans), a null owner or repository is a value of its own, equal spans of
    repeated rows are counted once per repository.  Texts are read whole; an
    empty table gives no rows; other columns are ignored.
    """
    work = Scratch(docs.sparkSession, "secrets")
    text = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col or id_col).cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = work.put(text.select("rid", "doc", "owner", "repo", candidates("text").alias("found")), "found")
    each = found.where(F.size("found") > 0).select("rid", "doc", "owner", "repo", F.explode("found").alias("c")).select("rid", "doc", "owner", "repo", "c.*")
    places = each.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = places.groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    spread = work.put(owners.groupBy("digest").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")), "spread")
    each = work.put(each.drop("owner", "repo"), "each")
    judged = each.join(spread, "digest").withColumn("example", (F.col("n_owners") > most_owners) | (F.col("n_repos") > most_repos)).withColumn("live", F.col("looks") & ~F.col("example"))
    span = F.struct("start", "kind", "end", "live", "example")
    grouped = judged.groupBy("rid", "doc").agg(F.array_sort(F.collect_list(span)).alias("all"))
    empty = found.where(F.size("found") == 0).select("rid", "doc", F.array().cast(grouped.schema["all"].dataType).alias("all"))
    base = F.filter("all", lambda s: s["kind"] <= 2)
    count = lambda n: F.size(F.filter("all", lambda s: s["kind"] == n)).cast("long")
    return grouped.unionByName(empty).select(
        F.col("doc").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base, KINDS), 256).alias("base_sha256"),
        listed(F.filter("all", lambda s: (s["kind"] <= 2) | s["live"]), KINDS).alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: s["example"])).cast("long").alias("n_example"),
    )


def _oracle() -> str:
    """The registered query in DuckDB SQL."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = ((0, ASSIGN, 1), (1, ACCESS, 0), (2, HEX, 0), (3, PROVIDER, 0), (4, OPAQUE, 0))
    found = "\n  UNION ALL\n  ".join(
        f"SELECT doc_id, source, {k} AS kind, regexp_extract_all(t, {quote(p)}) AS w, regexp_extract_all(t, {quote(p)}, {g}) AS v, string_split_regex(t, {quote(p)}) AS b FROM d WHERE regexp_matches(t, {quote(p)})"
        for k, p, g in kinds
    )
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT doc_id, source, kind, w, v, b, unnest(generate_series(1, len(w))) AS i FROM m),
f AS (
  SELECT doc_id, source, kind, v[i] AS value, b[i] AS before, length(w[i]) AS size,
         CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
c AS (
  SELECT *, len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234567') AS looks
  FROM f WHERE CASE kind WHEN 0 THEN length(value) >= 6 WHEN 1 THEN length(value) >= 20 WHEN 2 THEN true WHEN 3 THEN NOT regexp_matches(before, {quote(_LEAD + "$")})
    ELSE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND NOT regexp_matches(before, {quote(_LEAD + "$")})
         AND NOT regexp_matches(value, {quote("AKIA|^(?:" + PROVIDER + ")")}) END),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) > 2 OR count(DISTINCT coalesce(source, chr(1)) || chr(2) || doc_id) > 8 AS example FROM c GROUP BY value),
j AS (SELECT c.*, looks AND NOT example AS live, example, list_extract({list(KINDS)}, kind + 1) || ':' || a || ':' || (a + size) AS span FROM c JOIN o ON o.value = c.value),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY a, kind) FILTER (kind <= 2) AS base,
         string_agg(span, ',' ORDER BY a, kind) FILTER (kind <= 2 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


ORACLE = _oracle()

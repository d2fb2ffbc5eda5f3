"""Links: extraction, public suffixes, reputation lists, host shape and brands.

Extraction peels brackets and punctuation until nothing changes and encodes
international names, so it is an Arrow-batched function; everything after it
is relational.  Lists join as broadcast relations while they are small, and by
shuffle with skewed domains split otherwise: the planner decides by file size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions.text import visual_form
from shoalwater.operators.rules import STRIDE

# Link patterns, characters of a URI, bracket pairs, endings that are rather file names.
_STOP = "\\s<>\"'）」』】"
SCHEME = f"https?://[^{_STOP}]+"
BARE = f"(?<![A-Za-z0-9.\\-@/])(?:[a-z0-9](?:[a-z0-9\\-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,63}}(?::\\d{{1,5}})?(?:/[^{_STOP}]*)?"
_URI = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*")
BRACKETS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "】": "【"}
FILE_LIKE = frozenset("zip mov app dev sh py md pl rs so".split())
IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
URL_FIELDS = "url:string,host:string,raw_host:string,is_ip:boolean,has_userinfo:boolean,scheme_present:boolean,idna_failed:boolean"


def _authority(text: str) -> tuple[int, int]:
    start = text.find("://") + 3 if "://" in text else 0
    ends = [i for c in "/?#" if (i := text.find(c, start)) >= 0]
    return start, min(ends, default=len(text))


def _ascii_label(label: str) -> str | None:
    try:
        return label if label.isascii() else label.encode("idna").decode("ascii")
    except UnicodeError:
        return None


def peel(text: str, tlds: frozenset[str]) -> str:
    """A candidate without what the sentence put behind it."""
    start, end = _authority(text)
    text = text[: end + _URI.match(text[end:]).end()]
    start, end = _authority(text)
    host = text[start:end].rpartition("@")[2]
    host = host.partition(":")[0] if host.count(":") == 1 else host
    last = host.rpartition(".")[2].lower()
    if "." in host and last not in tlds and _ascii_label(last) not in tlds:
        foreign = next((i for i, c in enumerate(last) if not c.isascii()), None)
        if foreign is not None:  # words glued to the host
            text = text[: text.index(host, start) + len(host) - len(last) + foreign]
    while text:
        shorter = text.rstrip("!?;.,:")
        if shorter == text and text[-1] in BRACKETS and text.count(BRACKETS[text[-1]]) < text.count(text[-1]):
            shorter = text[:-1]
        if shorter == text:
            break
        text = shorter
    return text


def parts(text: str, with_scheme: bool) -> dict | None:
    """Host and normal form of a peeled candidate; None if it names no host."""
    scheme, rest = ("", text)
    if with_scheme:
        scheme, _, rest = text.partition("://")
        scheme = scheme.lower() + "://"
    _, end = _authority("x://" + rest)
    authority, tail = rest[: end - 4], rest[end - 4 :]
    userinfo, host = "@" in authority, authority.rpartition("@")[2]
    if host.startswith("["):
        inner, closed, port = host[1:].partition("]")
        if not closed or not re.fullmatch("[0-9a-fA-F:.]+", inner):
            return None
        ip, shown, raw = True, f"[{inner}]", inner
    else:
        head, _, last = host.rpartition(":")
        raw, port = (head, f":{last}") if head and last.isdigit() else (host, "")
        if not raw:
            return None
        ip, shown = bool(re.match(IPV4, raw)), raw.lower()
    plain = raw.strip().strip(".").lower()
    plain = plain[4:] if plain.startswith("www.") else plain
    if not plain:
        return None
    labels = [_ascii_label(x) if x else None for x in plain.split(".")]
    failed = None in labels
    name = plain if failed else ".".join(labels)
    return {
        "url": f"{scheme}{shown if ip else name}{port}{tail}", "host": name, "raw_host": plain, "is_ip": ip, "has_userinfo": userinfo, "scheme_present": with_scheme, "idna_failed": failed,
    }


def links(sentence: str, tlds: frozenset[str]) -> list[dict]:
    """Links of a sentence in order of position."""
    found, covered = [], []
    for m in re.finditer(SCHEME, sentence, re.I):
        covered.append(m.span())
        found.append((m.start(), peel(m[0], tlds), True))
    for m in re.finditer(BARE, sentence, re.I):
        if any(a <= m.start() < b for a, b in covered):
            continue
        text = peel(m[0], tlds)
        tld = text.partition("/")[0].partition(":")[0].rpartition(".")[2].lower()
        if tld in tlds and tld not in FILE_LIKE:
            found.append((m.start(), text, False))
    return [p for _, text, scheme in sorted(found, key=lambda x: x[0]) if text and (p := parts(text, scheme))]


@dataclass(frozen=True)
class Suffixes:
    """Public suffix rules: text to (kind, section); kinds normal, wildcard, exception."""

    rules: tuple[tuple[str, str, str], ...]

    @classmethod
    def parse(cls, text: str) -> Suffixes:
        """From the public list's format: section marks in comments, ! for exceptions, *. for wildcards."""
        section, out = None, {}
        for line in text.splitlines():
            rule = line.strip()
            if rule.startswith("//"):
                for name, mark in (("icann", "ICANN"), ("private", "PRIVATE")):
                    if f"===BEGIN {mark} DOMAINS===" in rule:
                        section = name
                    elif f"===END {mark} DOMAINS===" in rule:
                        section = None
            elif rule and section:
                rule = rule.split()[0].lower()
                kind = "exception" if rule[0] == "!" else "wildcard" if rule[:2] == "*." else "normal"
                labels = [x if x == "*" else _ascii_label(x) for x in rule.lstrip("!").split(".")]
                if None in labels:
                    raise ValueError(f"a suffix that can't be encoded: {rule}")
                out[".".join(labels)] = (kind, section)
        if not any(s == "icann" for _, s in out.values()):
            raise ValueError("no ICANN section in the suffix list")
        return cls(tuple((k, *v) for k, v in out.items()))

    @property
    def tlds(self) -> frozenset[str]:
        return frozenset(r.rpartition(".")[2] for r, _, section in self.rules if section == "icann")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rules), "suffix string, kind string, section string")


def is_ip(host: Column) -> Column:
    return F.regexp_like(host, F.lit(IPV4)) | (F.startswith(host, F.lit("[")) & F.endswith(host, F.lit("]")))


def registrable_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix, registrable_domain) for distinct ``hosts``; both null where there is none.

    Every tail of a host asks the rules for an exact and a wildcard match; the
    longest tail with a match decides, an exception gives one label less, and
    without any match the last label is the suffix.
    """
    label = F.split("host", r"\.")
    tails = hosts.select("host", label.alias("labels")).where("host <> '' and not array_contains(labels, '')").select("host", "labels", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("i", "tail"))
    rest = F.substring("tail", F.length(F.element_at("labels", F.col("i") + 1)) + 1, F.length("tail"))
    tails = tails.withColumn("starred", F.concat(F.lit("*"), rest))
    exact = rules.where("kind <> 'wildcard'").select(F.col("suffix").alias("tail"), "kind")
    wild = rules.where("kind = 'wildcard'").select(F.col("suffix").alias("starred"), F.lit(True).alias("wild"))
    matched = tails.join(exact, "tail", "left").join(wild, "starred", "left").where("kind is not null or wild")
    best = matched.groupBy("host").agg(F.min_by(F.struct("tail", F.when(F.col("kind") == "exception", F.substring(rest, F.lit(2), F.length("tail"))).alias("less")), "i").alias("b"))
    out = hosts.join(best, "host", "left").withColumn("valid", (F.col("host") != "") & ~F.array_contains(label, ""))
    suffix = F.when(F.col("valid"), F.coalesce("b.less", "b.tail", F.element_at(label, -1)))
    n = F.size(F.split(suffix, r"\."))
    domain = F.when(~is_ip(F.col("host")) & (F.size(label) > n), F.array_join(F.slice(label, F.size(label) - n, n + 1), "."))
    return out.select("host", suffix.alias("suffix"), domain.alias("registrable_domain"))


def extract_urls(sentences: DataFrame, suffixes: Suffixes) -> DataFrame:
    """(req_id, url_ord, url, host, raw_host, ..., registrable_domain, coords): links of each request, in order of first appearance."""
    spark = sentences.sparkSession
    tlds = spark.sparkContext.broadcast(suffixes.tlds)

    @F.pandas_udf(f"array<struct<{URL_FIELDS}>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: links(t, tlds.value) if isinstance(t, str) else [])

    each = sentences.where(F.regexp_like("text", F.lit("[.]|://"))).select("req_id", "m", "s", F.posexplode(found("text")).alias("k", "u"))
    place = F.struct("m", "s", "k")
    urls = each.groupBy("req_id", "u.url").agg(F.min_by("u", place).alias("u"), F.min(place).alias("first"), F.transform(F.array_sort(F.collect_list(place)), lambda p: F.struct(p["m"].alias("m"), p["s"].alias("s"))).alias("coords"))
    urls = urls.select("req_id", "first", "coords", "u.*")
    domains = registrable_domains(urls.select("host").distinct(), suffixes.frame(spark))
    urls = urls.join(domains.drop("suffix"), "host", "left")
    usable = ~F.col("idna_failed") & ~F.col("is_ip")
    return urls.withColumn("registrable_domain", F.when(usable, F.col("registrable_domain")))


def _signal(rows: DataFrame, name: str, ordinal: int, place: Column, detail: Column, evidence: Column, types: Column, hard: Column | None = None) -> DataFrame:
    return rows.select(
        "req_id", F.lit(name).alias("name"), (F.lit(ordinal) * F.lit(STRIDE) + place["m"] * F.lit(1 << 16) + F.least(place["s"], F.lit((1 << 16) - 1))).alias("ord"), F.lit(True).alias("hit"),
        (F.lit(False) if hard is None else hard).alias("hard"), F.lit(False).alias("indeterminate"), detail.alias("detail"), evidence.alias("evidence"), types.cast("array<string>").alias("scam_types"),
    )


def _phishing() -> Column:
    return F.array(F.lit("PHISHING_LINK"))


def by_domain(urls: DataFrame) -> DataFrame:
    """(req_id, registrable_domain, hosts, first, coords) of links with a registrable domain; coordinates distinct, in order of the links."""
    rows = F.array_sort(F.collect_list(F.struct("first", "coords")))
    return urls.where("registrable_domain is not null").groupBy("req_id", "registrable_domain").agg(
        F.array_sort(F.collect_set("host")).alias("hosts"), F.min("first").alias("first"), F.array_distinct(F.flatten(F.transform(rows, lambda r: r["coords"]))).alias("coords"),
    )


# Blocklist sources, their category, whether official, and how they are quoted.
SOURCES = [
    ("176455", "PHISHING_LINK", True, "{host} 於 {date} 列入 {title}"), ("160055", "FAKE_INVESTMENT", True, "{host} 於 {date} 列入 {title}"), ("165027", "PHISHING_LINK", True, "{host} 於 {date} 列入 {title}"),
    ("phishtank", "PHISHING_LINK", False, "{host} 於 {date} 經 {title} 驗證為釣魚網址，且在該時點仍在線上"), ("openphish", "PHISHING_LINK", False, "{host} 於 {date} 出現在 {title}"),
]


def blocklist_matches(domains: DataFrame, blocklist: DataFrame, allowlist: DataFrame | None, known_services: list[str]) -> DataFrame:
    """(req_id, registrable_domain, level, hard, entries, rank, ...): exact hosts first, then reported neighbours of the same domain.

    ``blocklist`` has (host, registrable_domain, source, title, last_seen,
    nature, target, domain_level); ``allowlist`` has (domain, rank).  A ranked
    domain takes hardness from an exact hit unless the domain itself is
    reported, and hides neighbours; so do known services.
    """
    entry = F.struct("host", "source", "title", "last_seen", "nature", "target")
    hosts = domains.select("req_id", "registrable_domain", F.explode("hosts").alias("host"))
    exact = hosts.join(blocklist.drop("registrable_domain"), "host").groupBy("req_id", "registrable_domain").agg(F.array_sort(F.collect_list(entry)).alias("exact"))
    near = blocklist.where("domain_level").groupBy("registrable_domain").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    rows = domains.join(exact, ["req_id", "registrable_domain"], "left").join(near, "registrable_domain", "left")
    if allowlist is not None:
        rows = rows.join(allowlist.select(F.col("domain").alias("registrable_domain"), "rank"), "registrable_domain", "left")
    else:
        rows = rows.withColumn("rank", F.lit(None).cast("int"))
    apex = F.exists("exact", lambda e: e["host"] == F.col("registrable_domain"))
    lowered = F.col("rank").isNotNull() & ~apex
    official = F.exists("exact", lambda e: e["source"].isin([s for s, _, o, _ in SOURCES if o]))
    service = F.col("registrable_domain").isin(known_services) if known_services else F.lit(False)
    level = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull() & F.col("rank").isNull() & ~service, "neighbour")
    rows = rows.withColumn("level", level).where("level is not null")
    return rows.withColumn("entries", F.coalesce("exact", "near")).withColumn("lowered", F.coalesce(lowered, F.lit(False))).withColumn("hard", (F.col("level") == "exact") & official & ~lowered)


def _source_map(i: int) -> Column:
    return F.create_map(*(F.lit(x) for row in SOURCES for x in (row[0], row[i])))


def blocklist_signals(matches: DataFrame, ordinal: int, list_id: str = "") -> DataFrame:
    """One signal per reported domain; a source without a category raises an error."""
    category, form = _source_map(1), _source_map(3)

    def told(e: Column) -> Column:
        text = F.element_at(form, e["source"])
        for mark, value in (("{host}", e["host"]), ("{date}", e["last_seen"]), ("{title}", F.coalesce(e["title"], e["source"]))):
            text = F.replace(text, F.lit(mark), value)
        return F.concat(text, F.coalesce(F.concat(F.lit("，網站性質："), e["nature"]), F.lit("")), F.coalesce(F.concat(F.lit("，冒用品牌："), e["target"]), F.lit("")))

    domain = F.col("registrable_domain")
    suffix = F.when(F.col("level") == "neighbour", F.concat(F.lit("。訊息中的主機為 "), F.array_join("hosts", "、"), F.lit("，與被通報的主機不同，同屬可註冊網域 "), domain))
    suffix = suffix.when(F.col("lowered"), F.concat(F.lit("。可註冊網域 "), domain, F.lit(f" 為 Tranco 清單 {list_id} 第 "), F.col("rank"), F.lit(" 名，被通報的主機為其子網域"))).otherwise(F.lit(""))
    types = F.array_distinct(F.transform("entries", lambda e: F.coalesce(F.try_element_at(category, e["source"]), F.raise_error(F.lit("a source without a category")).cast("string"))))
    return _signal(matches, "url_blocklist", ordinal, F.col("first"), F.concat(F.array_join(F.transform("entries", told), "；"), suffix), F.col("coords"), types, F.col("hard"))


def shortener_signals(urls: DataFrame, shorteners: DataFrame, ordinal: int) -> DataFrame:
    """One signal per shortened link; ``shorteners`` has (domain, service)."""
    rows = urls.join(shorteners, urls["registrable_domain"] == shorteners["domain"])
    detail = F.concat(F.lit("短網址 "), F.col("url"), F.lit("（"), F.col("service"), F.lit("），目的地未知；黑名單、TLD 風險與網域年齡對此連結不具資訊量"))
    return _signal(rows, "url_shortener", ordinal, F.col("first"), detail, F.col("coords"), F.array())


def tld_signals(domains: DataFrame, risks: DataFrame, known_services: list[str], ordinal: int, baseline: tuple[str, float] = ("com", 29.6)) -> DataFrame:
    """One signal per domain under a risky top-level domain; ``risks`` has (tld, value, source, as_of)."""
    known = F.col("registrable_domain").isin(known_services) if known_services else F.lit(False)
    rows = domains.where(~known).withColumn("tld", F.substring_index("registrable_domain", ".", -1)).join(risks, "tld")
    times = F.bround(F.col("value") / F.lit(baseline[1]), 0).cast("long")
    detail = F.concat(F.lit("網域 "), F.col("registrable_domain"), F.lit(" 的 TLD ."), F.col("tld"), F.lit(" 每萬網域的釣魚分數為 "), F.col("value"), F.lit("（"), F.col("source"), F.lit("，"), F.col("as_of"), F.lit(f"），約為 .{baseline[0]}（{baseline[1]}）的 "), times, F.lit(" 倍"))
    return _signal(rows, "url_tld_risk", ordinal, F.col("first"), detail, F.col("coords"), _phishing())


#: Scripts whose letters look alike, as character ranges (fixed values).
SCRIPTS = (("拉丁", "A-Za-zÀ-ɏ"), ("西里爾", "Ѐ-ӿԀ-ԯⷠ-ⷿꙀ-ꚟ"), ("希臘", "Ͱ-Ͽἀ-῿"))


def mixed_scripts(host: Column) -> Column:
    """Names of the scripts in the first label that mixes several."""
    present = F.transform(F.split(host, r"\."), lambda x: F.filter(F.array(*(F.when(F.regexp_like(x, F.lit(f"[{r}]")), F.lit(n)) for n, r in SCRIPTS)), lambda s: s.isNotNull()))
    return F.get(F.filter(present, lambda p: F.size(p) > 1), F.lit(0))


def shape_signals(urls: DataFrame, ordinal: int) -> DataFrame:
    """Up to four signals per link: IP address, user information, undecodable name, mixed scripts."""
    link = F.concat(F.lit("連結 "), F.col("url"), F.lit(" 的"))
    mixed = mixed_scripts(F.col("raw_host"))
    told = F.array(
        F.when(F.col("is_ip"), F.concat(link, F.lit("主機為 IP 位址 "), F.col("host"), F.lit("，不是網域名稱"))),
        F.when(F.col("has_userinfo"), F.concat(link, F.lit("實際主機為 "), F.col("host"), F.lit("，`@` 之前的部分位於使用者資訊欄位而不是主機"))),
        F.when(F.col("idna_failed"), F.concat(link, F.lit("主機 "), F.col("raw_host"), F.lit(" 無法以 IDNA 編碼為 punycode"))),
        F.when(mixed.isNotNull(), F.concat(link, F.lit("主機 "), F.col("raw_host"), F.lit(" 混用"), F.array_join(mixed, "與"), F.lit("字母"))),
    )
    rows = urls.withColumn("told", F.explode(F.filter(told, lambda t: t.isNotNull())))
    return _signal(rows, "url_host_shape", ordinal, F.col("first"), F.col("told"), F.col("coords"), _phishing())


# Brand, official domains, label tokens.
BRANDS = [
    ("中華郵政", "post.gov.tw", ""), ("玉山銀行", "esunbank.com esunbank.com.tw", "esunbank"), ("中國信託", "ctbcbank.com ctbcbank.com.tw", "ctbcbank"), ("蝦皮購物", "shopee.tw", "shopee"),
    ("7-ELEVEN 賣貨便", "7-11.com.tw", ""), ("全家便利商店", "family.com.tw famiport.com.tw", "famiport"), ("黑貓宅急便", "t-cat.com.tw", ""), ("新竹物流", "hct.com.tw", ""),
    ("台灣宅配通", "e-can.com.tw", ""), ("順豐速運", "sf-express.com", "sf-express"), ("嘉里大榮物流", "kerrytj.com", "kerrytj"), ("綠界科技", "ecpay.com.tw", "ecpay"),
    ("藍新金流", "newebpay.com", "newebpay"), ("LINE Pay", "line.me lin.ee", "linepay"), ("旋轉拍賣", "carousell.tw", "carousell"),
]


def brand_table(spark: SparkSession, brands: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(brand_no, brand, official, tokens): a handful of rows, broadcast by construction."""
    rows = [(i, n, d.split(), t.split()) for i, (n, d, t) in enumerate(brands or BRANDS)]
    return F.broadcast(spark.createDataFrame(rows, "brand_no int, brand string, official array<string>, tokens array<string>"))


def nearest_label(domain: Column, official: Column) -> Column:
    """(label, distance): the official main label within edit distance after folding look-alikes.

    Labels under five characters are skipped; up to eight characters one edit is
    allowed, beyond two; the nearest wins, then the first.
    """
    own = visual_form(F.substring_index(domain, ".", 1))
    main = F.filter(F.transform(official, lambda d: F.substring_index(d, ".", 1)), lambda x: F.length(x) >= 5)
    rows = F.transform(main, lambda x, i: F.struct(F.levenshtein(own, visual_form(x)).alias("distance"), i.alias("i"), x.alias("label")))
    near = F.filter(rows, lambda r: r["distance"] <= F.when(F.length(r["label"]) <= 8, 1).otherwise(2))
    return F.array_min(near)


def brand_host_findings(urls: DataFrame, brands: DataFrame) -> DataFrame:
    """Links whose host carries a brand's name, or nearly its label, outside its official domains."""
    rows = urls.where("registrable_domain is not null").join(brands).where(~F.array_contains("official", F.col("registrable_domain")))
    by_domain_text = F.get(F.filter("official", lambda d: F.contains(F.col("host"), d)), F.lit(0))
    by_token = F.get(F.filter("tokens", lambda t: F.contains(F.col("host"), t)), F.lit(0))
    token = F.coalesce(F.concat(F.lit("官方網域字串 "), by_domain_text), F.concat(F.lit("主標籤 "), by_token))
    rows = rows.withColumn("token", token).withColumn("near", F.when(token.isNull(), nearest_label(F.col("registrable_domain"), F.col("official"))))
    return rows.where("token is not null or near is not null")


def brand_signals(urls: DataFrame, sentences: DataFrame, brands: DataFrame, ordinal: int) -> DataFrame:
    """Host findings, and messages that mention a brand but link only elsewhere."""
    domain, link = F.col("registrable_domain"), F.concat(F.lit("連結 "), F.col("url"), F.lit(" 的"))
    official = F.array_join("official", "、")
    by_token = F.concat(link, F.lit("主機含 "), F.col("brand"), F.lit(" 的 "), F.col("token"), F.lit("，但其可註冊網域為 "), domain, F.lit("，不屬 "), F.col("brand"), F.lit(" 的官方網域（"), official, F.lit("）"))
    by_label = F.concat(link, F.lit("可註冊網域 "), domain, F.lit(" 其主標籤與 "), F.col("brand"), F.lit(" 的官方主標籤 "), F.col("near.label"), F.lit(" 編輯距離為 "), F.col("near.distance"), F.lit("（套用視覺替換後）"))
    hosts = _signal(brand_host_findings(urls, brands), "url_brand", ordinal, F.col("first"), F.coalesce(by_token, by_label), F.col("coords"), _phishing())
    inside = urls.select("req_id", "registrable_domain", "host", "first", "coords", F.explode(F.array_distinct(F.transform("coords", lambda c: c["m"]))).alias("m"))
    mentions = sentences.join(brands).where(F.contains("text", F.col("brand"))).groupBy("req_id", "m", "brand_no", "brand", "official").agg(F.array_sort(F.collect_list(F.struct("m", "s"))).alias("mentions"))
    rows = F.array_sort(F.collect_list(F.struct("first", "coords")))
    joined = mentions.join(inside, ["req_id", "m"]).groupBy("req_id", "m", "brand_no", "brand", "official", "mentions").agg(
        F.bool_or(F.array_contains("official", domain) & domain.isNotNull()).alias("ok"), F.array_sort(F.collect_set(F.coalesce(domain, "host"))).alias("offenders"),
        F.array_distinct(F.flatten(F.transform(rows, lambda r: r["coords"]))).alias("links"),
    ).where("not coalesce(ok, false)")
    told = F.concat(F.lit("第 "), F.col("m"), F.lit(" 則訊息提到 "), F.col("brand"), F.lit("，但其中的連結屬 "), F.array_join("offenders", "、"), F.lit("，不在 "), F.col("brand"), F.lit(" 的官方網域（"), official, F.lit("）中"))
    place = F.struct(F.col("m").alias("m"), F.lit((1 << 16) - 1).alias("s"))
    return hosts.unionByName(_signal(joined, "url_brand", ordinal, place, told, F.concat("mentions", "links"), _phishing()))


def age_signals(domains: DataFrame, ages: DataFrame, shorteners: DataFrame, as_of: str, ordinal: int, young_days: int = 30) -> DataFrame:
    """Domains registered under ``young_days`` before ``as_of``; unknown ages are indeterminate, not negative.

    ``ages`` has (domain, outcome, registered_on); shorteners are skipped.
    """
    rows = domains.join(shorteners.select(F.col("domain").alias("registrable_domain")), "registrable_domain", "left_anti").join(ages.withColumnRenamed("domain", "registrable_domain"), "registrable_domain", "left")
    days = F.datediff(F.lit(as_of).cast("date"), F.col("registered_on"))
    known = F.coalesce(F.col("outcome") == "KNOWN", F.lit(False))
    rows = rows.where(~known | (days < young_days))
    detail = F.when(known, F.concat(F.lit("網域 "), F.col("registrable_domain"), F.lit(" 註冊於 "), F.col("registered_on").cast("string"), F.lit("，距今 "), days, F.lit(" 天"))).otherwise(F.concat(F.lit("網域 "), F.col("registrable_domain"), F.lit(" 的註冊日期無法取得")))
    out = _signal(rows.withColumn("known", known), "domain_age", ordinal, F.col("first"), detail, F.col("coords"), F.when(known, _phishing()).otherwise(F.array().cast("array<string>")))
    return out.withColumn("hit", F.startswith("detail", F.lit("網域 ")) & F.contains("detail", F.lit("註冊於"))).withColumn("indeterminate", ~F.col("hit"))

"""Derived views of verdicts and checks: states, rankings, shares, recommendations, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoalwater.functions.weights import CATEGORIES, Weights

STATES = ("conclusive", "indicative", "clear", "skipped")
SOURCES = ("rule", "url", "classifier", "semantic")


def check_state(hit: Column, hard: Column, detail: Column) -> Column:
    """Of a check row: conclusive, indicative, clear or skipped; any other miss raises an error."""
    other = F.raise_error(F.concat(F.lit("a miss of unknown kind: "), detail)).cast("string")
    return F.when(hit & hard, "conclusive").when(hit, "indicative").when(detail == "未命中", "clear").when(detail == "因短路未執行", "skipped").otherwise(other)


def source_of(name: Column) -> Column:
    """Which layer a signal belongs to, by its name."""
    return F.when(F.startswith(name, F.lit("url_")), "url").when(name == "ngram_classifier", "classifier").when(name.isin("llm_scam", "llm_suspicious"), "semantic").otherwise("rule")


def source_statuses(checks: DataFrame) -> DataFrame:
    """(req_id, source, state, n_hit): hit, clear, standby or unloaded by priority over a layer's checks (req_id, name, hit, hard, detail)."""
    rows = checks.select("req_id", "name", "hit", source_of(F.col("name")).alias("source"), check_state(F.col("hit"), F.col("hard"), F.col("detail")).alias("state"))
    seen = rows.groupBy("req_id", "source").agg(F.bool_or("hit").alias("h"), F.bool_or(F.col("state") == "clear").alias("c"), F.bool_or(F.col("state") == "skipped").alias("s"), F.count_distinct(F.when(F.col("hit"), F.col("name"))).alias("n_hit"))
    spark = checks.sparkSession
    grid = checks.select("req_id").distinct().join(F.broadcast(spark.createDataFrame([(s,) for s in SOURCES], "source string")))
    state = F.when(F.col("h"), "hit").when(F.col("c"), "clear").when(F.col("s"), "standby").otherwise("unloaded")
    return grid.join(seen, ["req_id", "source"], "left").select("req_id", "source", state.alias("state"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"))


def hit_ranking(signals: DataFrame) -> DataFrame:
    """(req_id, name, state, n_places, rank): conclusive first, then by distinct places (unplaced last), then name."""
    hits = signals.where("hit")
    places = hits.select("req_id", "name", F.explode("evidence").alias("at")).groupBy("req_id", "name").agg(F.count_distinct("at").alias("n_places"))
    rows = hits.groupBy("req_id", "name").agg(F.min_by("hard", "ord").alias("hard")).join(places, ["req_id", "name"], "left")
    state = F.when(F.col("hard"), "conclusive").otherwise("indicative")
    order = W.partitionBy("req_id").orderBy(F.when(F.col("hard"), 0).otherwise(1), F.coalesce(-F.col("n_places"), F.lit(1)), "name")
    return rows.select("req_id", "name", state.alias("state"), "n_places", F.row_number().over(order).alias("rank"))


def confidence_band(confidence: Column, weights: Weights) -> Column:
    """high, medium or low; null below the floor."""
    t = weights.threshold
    return F.when(confidence < t("confidence_floor"), F.lit(None)).when(confidence >= t("base_hard"), "high").when(confidence >= t("base_multi_group"), "medium").otherwise("low")


def verdict_state(probability: Column, decided: Column) -> Column:
    return F.when(probability.isNull(), "undecided").when(decided, "scam").otherwise("signals")


def verdict_text(verdicts: DataFrame) -> DataFrame:
    """(req_id, text): a verdict as lines of plain text."""
    label = F.create_map(*(F.lit(v) for row in CATEGORIES for v in row))
    head = F.when(F.col("scam_probability").isNull(), F.lit("資訊不足，無法判斷")).otherwise(F.concat(F.lit("判斷結果（"), F.bround(F.col("scam_probability") * 100).cast("int"), F.lit("%）")))
    kind = F.when(F.col("scam_probability").isNotNull() & F.col("scam_type").isNotNull(), F.concat(F.lit("類型："), F.try_element_at(label, "scam_type")))
    body = F.when(F.size("evidence") > 0, F.concat(F.lit("依據：\n"), F.array_join(F.transform("evidence", lambda x: F.concat(F.lit("・"), x)), "\n")))
    return verdicts.select("req_id", F.concat_ws("\n", head, kind, body).alias("text"))


def evidence_parts(line: Column) -> Column:
    """title, notes and quote of an evidence line."""
    head = F.substring_index(line, "：「", 1)
    tail = F.regexp_replace(F.substring(line, F.length(head) + 3, F.length(line)), "」$", "")
    return F.struct(F.substring_index(head, "；", 1).alias("title"), F.slice(F.split(head, "；"), 2, 100).alias("notes"), F.when(F.contains(line, F.lit("：「")), tail).alias("quote"))


def masked_title(line: Column) -> Column:
    """A line's title without addresses and percentages."""
    title = F.regexp_replace(evidence_parts(line)["title"], r"https?://\S+|www\.\S+", "[網址已省略]")
    return F.regexp_replace(title, r"[0-9]+(?:\.[0-9]+)?\s*[%％]", "[比率已省略]")


def type_shares(verdicts: DataFrame, official: DataFrame) -> DataFrame:
    """(scam_type, predicted, predicted_share, official_cases, official_share) for all categories; ``official`` has (scam_type, cases)."""
    got = verdicts.where("decided and scam_type is not null").groupBy("scam_type").agg(F.count("*").alias("predicted"))
    totals = F.broadcast(got.agg(F.coalesce(F.sum("predicted"), F.lit(0)).alias("n")).join(official.agg(F.sum("cases").alias("all_cases"))))
    rows = official.join(got, "scam_type", "left").fillna(0, ["predicted"]).join(totals)
    share = F.when(F.col("n") > 0, F.col("predicted") / F.col("n")).otherwise(0.0)
    return rows.select("scam_type", "predicted", share.alias("predicted_share"), F.col("cases").alias("official_cases"), (F.col("cases") / F.col("all_cases")).alias("official_share"))


def recommendations(signals: DataFrame, shadow_ratio: float = 1.0) -> DataFrame:
    """(name, advice) from (name, registered, hits, shadowed, separable, delta_recall): the first rule that applies.

    insufficient if unregistered; remove without hits; regroup if mostly
    shadowed; insufficient if not separable from chance or without loss of
    recall when switched off; else keep.
    """
    advice = (
        F.when(~F.col("registered"), "insufficient").when(F.coalesce("hits", F.lit(0)) == 0, "remove").when(F.col("shadowed") >= shadow_ratio * F.col("hits"), "regroup")
        .when(~F.coalesce("separable", F.lit(True)), "insufficient").when(F.col("delta_recall") >= 0, "insufficient").otherwise("keep")
    )
    return signals.select("name", advice.alias("advice"))


def decision_interval(exits: DataFrame, current: float) -> DataFrame:
    """(value, recomputed, lower, upper) of (weight, hard) with exit measured: the midpoint between the strongest soft and the weakest hard weight, or the current value."""
    bounds = exits.where("exit = 'measured'").agg(F.max(F.when(~F.col("hard"), F.col("weight"))).alias("lower"), F.min(F.when(F.col("hard"), F.col("weight"))).alias("upper"))
    fits = F.coalesce(F.col("lower") < F.col("upper"), F.lit(False))
    return bounds.select(F.when(fits, F.round((F.col("lower") + F.col("upper")) / 2, 6)).otherwise(F.lit(current)).alias("value"), fits.alias("recomputed"), "lower", "upper")


def quoted_blocklist_hits(signals: DataFrame) -> DataFrame:
    """(req_id, n_links, hard): requests in which a reported link is quoted rather than sent."""
    rows = signals.where("hit and name in ('url_blocklist', 'quotation')").groupBy("req_id").agg(F.count_if(F.col("name") == "url_blocklist").alias("n_links"), F.bool_or(F.col("hard")).alias("hard"), F.bool_or(F.col("name") == "quotation").alias("q"))
    return rows.where("q and n_links > 0").drop("q")


def gate_hits(signals: DataFrame) -> DataFrame:
    """(req_id): requests that a harmless corpus must not contain: a hard hit or any reported link."""
    return signals.where("hit and (hard or name = 'url_blocklist')").select("req_id").distinct()


def random_control(messages: DataFrame, name: str, probability: float, seed: str) -> DataFrame:
    """(req_id): requests that a control signal hits with this probability, fixed by seed, name and the request's texts."""
    text = messages.groupBy("req_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("t"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{name}:"), "t"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return text.where(draw < probability).select("req_id")


def ranked_domains(rows: DataFrame, domains: DataFrame, top: int) -> DataFrame:
    """(domain, rank) of the first ``top`` rows (rank, host) that are registrable domains themselves, each once at its best rank; ``domains`` has (host, registrable_domain)."""
    own = rows.where(F.col("rank") <= top).join(domains, "host").where(F.col("registrable_domain") == F.col("host"))
    return own.groupBy(F.col("host").alias("domain")).agg(F.min("rank").alias("rank"))


def lookup_endpoints(services: DataFrame) -> DataFrame:
    """(tld, url) of services (position, tlds, urls): the first secure address; of several services for a TLD the first."""
    secure = F.get(F.filter("urls", lambda u: F.startswith(u, F.lit("https://"))), F.lit(0))
    rows = services.withColumn("url", secure).where("url is not null").select("position", "url", F.explode("tlds").alias("tld"))
    return rows.groupBy(F.lower("tld").alias("tld")).agg(F.min_by("url", "position").alias("url"))


def registration(payload: Column) -> Column:
    """outcome and registered_on of a registry answer: the first registration event with a readable date."""
    events = F.from_json(payload, "struct<events:array<struct<eventAction:string,eventDate:string>>>")["events"]
    raw = F.get(F.filter(events, lambda e: e["eventAction"] == "registration"), F.lit(0))["eventDate"]
    day = F.to_date(F.try_to_timestamp(raw))
    return F.struct(F.when(day.isNotNull(), "KNOWN").otherwise("NO_DATA").alias("outcome"), day.alias("registered_on"))


def freshness(sources: DataFrame, as_of: str) -> DataFrame:
    """(source, age_days, stale) of (source, data_through, retired, max_age_days); a live source without a limit raises an error."""
    limit = F.coalesce("max_age_days", F.when(F.col("retired"), 0), F.raise_error(F.concat(F.lit("no age limit for "), F.col("source"))).cast("int"))
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("data_through"))
    return sources.select("source", age.alias("age_days"), (~F.col("retired") & (age > limit)).alias("stale"))


# Terms that ask to be believed, claims that belong to the probability, the least width of a bar, names of personal data.
SPECULATIVE = ("可疑", "危險", "不明", "很可能", "應該是", "一定是", "肯定", "小心", "注意")
CLAIMS = ("是詐騙", "為詐騙", "詐騙訊息", "確定是")
LEAST_WIDTH = 12.0
PERSONAL = {"TW_ID": "身分證字號", "TW_MOBILE": "手機號碼", "TW_LANDLINE": "市話", "CREDIT_CARD": "信用卡號"}


def _holds(line: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(line, w))


def line_qualities(line: Column) -> Column:
    """speculative, claims and verifiable of an evidence line; a digit, a domain or a quotation can be looked up."""
    verifiable = F.regexp_like(line, F.lit(r"\p{Nd}|[A-Za-z0-9-]+\.[A-Za-z]{2,}")) | F.contains(line, F.lit("：「"))
    return F.struct(_holds(line, SPECULATIVE).alias("speculative"), _holds(line, CLAIMS).alias("claims"), verifiable.alias("verifiable"))


def escaped(text: Column) -> Column:
    """Text for markup: ampersand first, then brackets and quotes."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def checked_spans(text: Column, spans: Column) -> Column:
    """``spans`` (array of start, end, kind) if they lie inside the text in order without overlap; otherwise an error."""
    bad = F.exists(F.transform(spans, lambda x, i: (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > F.length(text)) | ((i > 0) & (x["start"] < F.get(spans, i - 1)["end"]))), lambda b: F.coalesce(b, F.lit(True)))
    return F.when(~bad, spans).otherwise(F.raise_error(F.lit("spans outside the text, empty, out of order or overlapping")).cast("array<struct<start:int,end:int,kind:string>>"))


def highlighted(text: Column, spans: Column) -> Column:
    """Markup of a text with its personal data marked and named; the text is cut first and escaped then."""
    names = F.create_map(*(F.lit(v) for row in PERSONAL.items() for v in row))

    def cut(own: Column) -> Column:
        before = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        label = lambda x: F.element_at(names, x["kind"])
        mark = lambda x: F.concat(F.lit('<mark class="personal" title="'), label(x), F.lit('">'), escaped(F.substring(text, x["start"] + 1, x["end"] - x["start"])), F.lit('<span class="kind">'), label(x), F.lit("</span></mark>"))
        pieces = F.transform(own, lambda x, i: F.concat(escaped(F.substring(text, F.when(i > 0, before(i)).otherwise(0) + 1, x["start"] - F.when(i > 0, before(i)).otherwise(0))), mark(x)))
        rest = F.when(F.size(own) > 0, F.element_at(own, -1)["end"]).otherwise(0)
        return F.concat(F.array_join(pieces, ""), escaped(F.substring(text, rest + 1, F.length(text))))

    return F.transform(F.array(checked_spans(text, spans)), cut)[0]


def bar_widths(ranking: DataFrame) -> DataFrame:
    """Adds width (per cent) to a ranking (req_id, ..., n_places): the largest of a request is full, the least is visible, the unplaced is empty."""
    largest = F.max("n_places").over(W.partitionBy("req_id"))
    return ranking.withColumn("width", F.when(F.col("n_places").isNull(), 0.0).otherwise(F.greatest(F.lit(LEAST_WIDTH), 100.0 * F.col("n_places") / largest)))


def responses(verdicts: DataFrame) -> DataFrame:
    """(req_id, response): what a caller gets of a verdict, as JSON; checks, signals and redacted text stay inside."""
    label = F.create_map(*(F.lit(v) for row in CATEGORIES for v in row))
    kind = F.when(F.col("scam_type").isNotNull(), F.struct(F.col("scam_type").alias("code"), F.try_element_at(label, "scam_type").alias("label")))
    body = F.struct(F.col("scam_probability"), F.col("scam_probability").isNull().alias("abstained"), "confidence", kind.alias("scam_type"), "evidence", "actions")
    return verdicts.select("req_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def card(verdicts: DataFrame) -> DataFrame:
    """(req_id, markup): a verdict as a card: head, category, evidence and actions as lists."""
    text = verdict_text(verdicts.withColumn("evidence", F.array().cast("array<string>")))
    items = lambda c: F.concat(F.lit("<ul>"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), ""), F.lit("</ul>"))
    joined = verdicts.select("req_id", "evidence", "actions").join(text, "req_id")
    return joined.select("req_id", F.concat(F.lit('<section class="card"><p>'), F.replace(escaped(F.col("text")), F.lit("\n"), F.lit("<br>")), F.lit("</p>"), items("evidence"), items("actions"), F.lit("</section>")).alias("markup"))


def health(registered: DataFrame, missing: DataFrame, sources: DataFrame, n_signals: int) -> DataFrame:
    """(status, checks, unregistered, stale, signals): degraded if the list of reported links is not loaded or any source is stale.

    ``registered`` has (name), ``missing`` (name, reason), ``sources`` the rows of ``freshness``.
    """
    a = registered.agg(F.count("*").alias("checks"))
    b = missing.agg(F.array_sort(F.collect_list(F.struct("name", "reason"))).alias("unregistered"), F.coalesce(F.bool_or(F.col("name") == "url_blocklist"), F.lit(False)).alias("no_list"))
    c = sources.agg(F.array_sort(F.collect_list(F.when(F.col("stale"), F.col("source")))).alias("stale"))
    status = F.when(F.col("no_list") | (F.size("stale") > 0), "degraded").otherwise("ok")
    return a.join(b).join(c).select(status.alias("status"), "checks", "unregistered", "stale", F.lit(n_signals).alias("signals"))

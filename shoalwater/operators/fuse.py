"""From the tall signals table to one verdict per request.

Signals join the weight table (a few dozen rows, broadcast) and aggregate in two
levels: the strongest signal of each group, then the sum over groups.  What is
not known stays null: an abstaining verdict has no probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwater.functions.weights import ACTIONS, HARMLESS, Weights

CONTRADICTION_NOTE = "系統無法分辨這則訊息是在實施這個手法，還是在轉述它"
#: Categories that refine one another don't conflict.
REFINEMENTS = (("FAKE_INVESTMENT", "ROMANCE_INVESTMENT"),)


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow for large negative values."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def weighted(signals: DataFrame, weights: Weights) -> DataFrame:
    """Hits with grp, weight and strong; a hit whose (name, hard) has no weight raises an error."""
    table = F.broadcast(weights.frame(signals.sparkSession))
    joined = signals.where("hit").join(table, ["name", "hard"], "left")
    missing = F.raise_error(F.concat(F.lit("no weight for signal "), F.col("name")))
    return joined.withColumn("weight", F.coalesce("weight", missing.cast("double")))


def group_contributions(hits: DataFrame, weights: Weights) -> DataFrame:
    """(req_id, grp, weight, taken, shadowed, contradicted, quotation_applied): the strongest hit of each group, earliest on ties.

    A quotation hit counts only in requests without a hard hit.  It contradicts
    hard hits unless all of them are exact blocklist hits.
    """
    quoted = F.col("name") == weights.quotation
    flags = hits.groupBy("req_id").agg(
        F.bool_or(quoted).alias("quoted"), F.bool_or("hard").alias("any_hard"), F.bool_or(F.col("hard") & (F.col("name") != weights.blocklist)).alias("other_hard"),
    )
    scored = hits.join(flags, "req_id").where(~quoted | ~F.col("any_hard"))
    taken = F.struct("name", "hard", "ord", "detail", "evidence", "scam_types")
    grouped = scored.groupBy("req_id", "grp").agg(
        F.max_by(F.struct("weight", taken.alias("taken")), F.struct("weight", (-F.col("ord")).alias("early"))).alias("best"),
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "ord", "name"))).alias("all"),
    )
    return grouped.select("req_id", "grp", "best.weight", "best.taken", F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["name"]).alias("shadowed"))


def request_facts(hits: DataFrame, weights: Weights) -> DataFrame:
    """Per request with hits: the flags that score, confidence and rendering need."""
    quoted = F.col("name") == weights.quotation
    return hits.groupBy("req_id").agg(
        F.bool_or("hard").alias("any_hard"), F.bool_or("strong").alias("any_strong"), F.count_distinct("grp").alias("hit_groups"),
        F.bool_and(F.size("scam_types") == 0).alias("typeless"), F.bool_or(quoted).alias("quoted"), F.bool_or(F.col("hard") & (F.col("name") != weights.blocklist)).alias("other_hard"),
        F.min_by(F.struct("detail", "evidence", "grp"), F.when(quoted, F.col("ord"))).alias("quotation"),
    ).withColumn("contradicted", F.col("quoted") & F.col("other_hard"))


def scores(requests: DataFrame, contributions: DataFrame, weights: Weights) -> DataFrame:
    """(req_id, score, probability) for every request."""
    t = weights.threshold
    total = contributions.groupBy("req_id").agg(F.sum("weight").alias("total"))
    joined = requests.select("req_id").join(total, "req_id", "left").withColumn("score", F.lit(t("prior_log_odds")) + F.greatest(F.lit(0.0), F.coalesce("total", F.lit(0.0))))
    return joined.select("req_id", "score", sigmoid((F.col("score") - t("sigmoid_offset")) / t("sigmoid_temperature")).alias("probability"))


def confidence(weights: Weights) -> Column:
    """Of joined request facts (null where a request has no hits) and ``truncated``."""
    t = weights.threshold
    base = (
        F.when(F.col("any_hard"), t("base_hard")).when(F.col("any_strong"), t("base_single_strong")).when(F.col("hit_groups") > 1, t("base_multi_group"))
        .when(F.col("hit_groups") == 1, t("base_single_group")).otherwise(t("base_no_hit"))
    )
    return F.least(
        base, F.when(F.col("contradicted"), t("cap_contradiction")), F.when(F.col("typeless"), t("cap_unseen_pattern")),
        F.when(F.col("truncated") & ~F.coalesce("any_hard", F.lit(False)), t("cap_truncated")),
    )


def category_candidates(hits: DataFrame, weights: Weights, from_model: tuple[str, ...] = ()) -> DataFrame:
    """(req_id, from_model, category, priority, hard, weight, evidence): the strongest hit for each category and source."""
    order = F.broadcast(hits.sparkSession.createDataFrame([(c, i) for i, (c, _) in enumerate(weights.categories)], "category string, priority int"))
    each = hits.select("req_id", F.col("name").isin(*from_model).alias("from_model") if from_model else F.lit(False).alias("from_model"), F.explode("scam_types").alias("category"), "hard", "weight", "ord", "evidence")
    rank = F.struct(F.when(F.col("hard"), 0).otherwise(1).alias("soft"), (-F.col("weight")).alias("w"), "ord")
    return each.groupBy("req_id", "from_model", "category").agg(F.min_by(F.struct("hard", "weight", "evidence"), rank).alias("best")).join(order, "category").select("req_id", "from_model", "category", "priority", "best.*")


def categories(hits: DataFrame, weights: Weights, from_model: tuple[str, ...] = ()) -> DataFrame:
    """(req_id, scam_type, type_evidence, conflict) where a category can be named.

    Rules come first, a model's judgement only fills in.  PHISHING_LINK yields
    to any other category of the same source.  An investment category next to
    a relationship signal becomes ROMANCE_INVESTMENT.
    """
    rank = F.struct(F.when(F.col("hard"), 0).otherwise(1).alias("soft"), (-F.col("weight")).alias("w"), "priority")
    weak = F.struct((F.col("category") == "PHISHING_LINK").alias("yields"), rank.alias("rank"))
    top = category_candidates(hits, weights, from_model).groupBy("req_id").agg(
        F.min_by(F.struct("category", "evidence"), F.when(~F.col("from_model"), weak)).alias("rule"), F.min_by(F.struct("category", "evidence"), F.when(F.col("from_model"), weak)).alias("model"),
    )
    pair = hits.groupBy("req_id").agg(
        F.min_by("evidence", F.when(F.array_contains("scam_types", "FAKE_INVESTMENT"), F.col("ord"))).alias("investment"),
        F.min_by("evidence", F.when(F.col("name") == weights.relationship, F.col("ord"))).alias("relationship"),
    )
    joined = pair.join(top, "req_id", "left")
    both = F.col("investment").isNotNull() & F.col("relationship").isNotNull()
    first = F.coalesce("rule", "model")
    refined = F.lit(False)
    for a, b in REFINEMENTS:
        refined = refined | F.struct("rule.category", "model.category").isin(F.struct(F.lit(a), F.lit(b)), F.struct(F.lit(b), F.lit(a)))
    return joined.select(
        "req_id", F.when(both, F.lit("ROMANCE_INVESTMENT")).otherwise(first["category"]).alias("scam_type"),
        F.when(both, F.array_sort(F.array_union("investment", "relationship"))).otherwise(first["evidence"]).alias("type_evidence"),
        F.coalesce((F.col("rule.category") != F.col("model.category")) & ~refined, F.lit(False)).alias("conflict"),
    )


def _line(detail: Column, raw: Column) -> Column:
    return F.when(raw.isNull(), detail).otherwise(F.concat(detail, F.lit("：「"), raw, F.lit("」")))


def evidence_lines(contributions: DataFrame, sentences: DataFrame, facts: DataFrame, requests: DataFrame, weights: Weights) -> DataFrame:
    """(req_id, evidence): contributions in order of weight, then notes on contradiction and truncation, within the line budget."""
    raw = sentences.select("req_id", F.struct("m", "s").alias("at"), "raw")
    lines = contributions.withColumn("at", F.get("taken.evidence", F.lit(0))).join(raw, ["req_id", "at"], "left")
    # Groups of equal weight follow in descending order of name.
    lines = lines.groupBy("req_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("weight", "grp", _line(F.col("taken.detail"), F.col("raw")).alias("line"))))).alias("lines"))
    told = facts.withColumn("at", F.get("quotation.evidence", F.lit(0))).join(raw, ["req_id", "at"], "left").withColumn("quote", _line(F.col("quotation.detail"), F.col("raw")))
    rows = told.join(requests, "req_id").join(lines, "req_id", "left")
    cut = F.col("truncated") & ~F.col("any_hard")
    note = F.concat(F.lit("前 "), F.col("dropped"), F.lit(" 則訊息因超過上限未納入判斷"))
    tail = F.filter(F.array(F.when(F.col("contradicted"), F.col("quote")), F.when(F.col("contradicted"), F.lit(CONTRADICTION_NOTE)), F.when(cut, note)), lambda x: x.isNotNull())
    room = F.greatest(F.lit(0), F.lit(int(weights.threshold("max_evidence_lines"))) - F.size(tail))
    head = F.slice(F.transform(F.coalesce("lines", F.array().cast("array<struct<weight:double,grp:string,line:string>>")), lambda x: x["line"]), F.lit(1), room)
    return rows.select("req_id", F.concat(head, tail).alias("evidence"))


def actions_for(groups: Column, abstains: Column, weights: Weights) -> Column:
    """Recommended actions for groups in order: general ones first, then each group's, none twice; abstaining keeps only harmless ones."""
    rows = [(i, text, set(where.split()), harm) for i, (text, where, harm) in enumerate(ACTIONS)]

    def listed(keep: list[tuple]) -> Column:
        general = F.array(*(F.lit(x[1]) for x in keep if "*" in x[2]))
        own = F.map_from_entries(F.array(*(F.struct(F.lit(g), F.array(*(F.lit(x[1]) for x in keep if g in x[2]))) for g in sorted({g for x in keep for g in x[2]} - {"*"}))))
        each = F.flatten(F.transform(groups, lambda g: F.coalesce(F.try_element_at(own, g), F.array().cast("array<string>"))))
        return F.slice(F.array_distinct(F.concat(general, each)), 1, int(weights.threshold("max_actions")))

    return F.when(abstains, listed([x for x in rows if x[3] == HARMLESS])).otherwise(listed(rows))


def fuse(requests: DataFrame, sentences: DataFrame, signals: DataFrame, weights: Weights, from_model: tuple[str, ...] = ()) -> DataFrame:
    """One verdict per request.

    (req_id, scam_probability, score, confidence, scam_type, type_conflict,
    contradicted, decided, evidence, actions, hit_signals, hard_signals, shadowed).
    A request abstains, with a null probability, below the confidence floor.
    """
    hits = weighted(signals, weights)
    parts = group_contributions(hits, weights)
    facts = request_facts(hits, weights)
    grouped = parts.groupBy("req_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("weight", "grp")))).alias("groups"), F.array_sort(F.flatten(F.collect_list("shadowed"))).alias("shadowed"))
    names = hits.groupBy("req_id").agg(F.array_sort(F.collect_set("name")).alias("hit_signals"), F.array_sort(F.collect_set(F.when(F.col("hard"), F.col("name")))).alias("hard_signals"))
    rows = (
        requests.join(scores(requests, parts, weights), "req_id").join(facts, "req_id", "left").join(categories(hits, weights, from_model), "req_id", "left")
        .join(evidence_lines(parts, sentences, facts, requests, weights), "req_id", "left").join(grouped, "req_id", "left").join(names, "req_id", "left")
    )
    none = F.array().cast("array<string>")
    rows = rows.withColumn("confidence", confidence(weights))
    abstains = F.col("confidence") < weights.threshold("confidence_floor")
    groups = F.concat(F.coalesce(F.transform("groups", lambda g: g["grp"]), none), F.when(F.col("contradicted"), F.array("quotation.grp")).otherwise(none))
    return rows.select(
        "req_id", F.when(~abstains, F.col("probability")).alias("scam_probability"), "score", "confidence", "scam_type", F.coalesce("conflict", F.lit(False)).alias("type_conflict"),
        F.coalesce("contradicted", F.lit(False)).alias("contradicted"), (~abstains & (F.col("score") >= weights.threshold("decision_score"))).alias("decided"),
        F.coalesce("evidence", none).alias("evidence"), F.when(F.col("any_hard").isNull(), none).otherwise(actions_for(groups, abstains, weights)).alias("actions"),
        F.coalesce("hit_signals", none).alias("hit_signals"), F.coalesce("hard_signals", none).alias("hard_signals"), F.coalesce("shadowed", none).alias("shadowed"),
    )


def short_circuited(signals: DataFrame, weights: Weights) -> DataFrame:
    """(req_id): requests whose local evidence is hard and not quoted, which skip expensive checks."""
    quoted = F.bool_or(F.col("name") == weights.quotation)
    return signals.where("hit").groupBy("req_id").agg(F.bool_or("hard").alias("h"), quoted.alias("q")).where("h and not q").select("req_id")


def check_rows(requests: DataFrame, signals: DataFrame, names: list[str], skipped: DataFrame | None = None, expensive: tuple[str, ...] = ()) -> DataFrame:
    """Every registered check of every request: its signals, or one row that says it missed or was skipped."""
    spark = requests.sparkSession
    table = F.broadcast(spark.createDataFrame([(n, i, n in expensive) for i, n in enumerate(names)], "name string, check_no int, expensive boolean"))
    grid = requests.select("req_id").join(table)
    if skipped is not None:
        grid = grid.join(skipped.withColumn("skip", F.lit(True)), "req_id", "left")
    else:
        grid = grid.withColumn("skip", F.lit(False))
    joined = grid.join(signals, ["req_id", "name"], "left")
    out = F.coalesce("skip", F.lit(False)) & F.col("expensive")
    return joined.select("req_id", "name", "check_no", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("hard", F.lit(False)).alias("hard"), F.coalesce("detail", F.when(out, "因短路未執行").otherwise("未命中")).alias("detail"))

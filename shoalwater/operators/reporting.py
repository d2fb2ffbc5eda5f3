"""Reports over run records: rates of a run, sweeps, contributions, comparisons, the written report.

``records`` has one row per sample: (id, subset, split, label, score,
confidence, probability, abstained, decided, scam_type, contradicted,
quotation_hit, blocklist_hit, truncated, hit_signals, hard_signals,
shadowed_signals, speech_act_hits, no_clause_hits).  Everything here is an
aggregate over it; nothing is detected again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions.stats import rate
from shoalwater.functions.weights import Weights
from shoalwater.operators import evaluate

#: Characters of simplified script; two of them tell a text's origin (fixed values).
SIMPLIFIED = "发会银账验码个这为将应该网门题产"
#: Age limits in days at which the check of domain ages is swept (fixed values).
AGE_LIMITS = (7, 14, 30, 60, 90)


def is_simplified(text: Column, least: int = 2) -> Column:
    """Whether a text holds at least ``least`` different characters of the simplified script."""
    return F.size(F.filter(F.array(*map(F.lit, SIMPLIFIED)), lambda c: F.contains(text, c))) >= least


def label_of(subset: Column) -> Column:
    """scam or ham, from the subset's name; any other name raises an error."""
    other = F.raise_error(F.concat(F.lit("a subset without a label: "), subset)).cast("string")
    return F.when(F.regexp_like(subset, F.lit("(?:^|_)scam(?:_|$)")), "scam").when(F.regexp_like(subset, F.lit("(?:^|_)ham(?:_|$)")), "ham").otherwise(other)


def run_records(samples: DataFrame, detection, weights: Weights, rule_names: list[str]) -> DataFrame:
    """One record per sample (id, subset, req_id) of a detection over them."""
    s = detection.signals.where("hit")
    of = lambda name: F.coalesce(F.bool_or(F.col("name") == name), F.lit(False))
    acts = F.col("name").isin(rule_names)
    own = s.groupBy("req_id").agg(
        of(weights.quotation).alias("quotation_hit"), of(weights.blocklist).alias("blocklist_hit"), F.count_if(acts).alias("speech_act_hits"),
        F.count_if(acts & F.contains("detail", F.lit("本句未切出子句"))).alias("no_clause_hits"),
    )
    v = detection.verdicts.select("req_id", "score", "confidence", F.col("scam_probability").alias("probability"), "scam_type", "contradicted", "decided", "hit_signals", "hard_signals", F.col("shadowed").alias("shadowed_signals"))
    rows = samples.join(detection.requests.select("req_id", "truncated"), "req_id").join(v, "req_id").join(own, "req_id", "left")
    no = F.lit(False)
    return rows.select(
        "id", "subset", evaluate.split_of(F.col("id"), F.col("subset")).alias("split"), label_of(F.col("subset")).alias("label"), "score", "confidence", "probability", F.col("probability").isNull().alias("abstained"), "decided",
        "scam_type", "contradicted", F.coalesce("quotation_hit", no).alias("quotation_hit"), F.coalesce("blocklist_hit", no).alias("blocklist_hit"), "truncated", "hit_signals", "hard_signals", "shadowed_signals",
        F.coalesce("speech_act_hits", F.lit(0)).alias("speech_act_hits"), F.coalesce("no_clause_hits", F.lit(0)).alias("no_clause_hits"),
    )


def run_rates(records: DataFrame) -> DataFrame:
    """(metric, num, den): how often a run names a category, is vetoed by or holds a quotation, finds no clause, contradicts itself, is truncated.

    Rates count all records, but no_clause counts hits of speech-act rules and
    contradicted counts scam records only.
    """
    scam = F.col("label") == "scam"
    metrics = {
        "type_output": (F.count_if(F.col("scam_type").isNotNull()), F.count("*")), "quotation_veto": (F.count_if(F.col("quotation_hit") & (F.size("hard_signals") > 0)), F.count("*")),
        "quotation": (F.count_if("quotation_hit"), F.count("*")), "no_clause": (F.sum("no_clause_hits"), F.sum("speech_act_hits")),
        "contradicted": (F.count_if(scam & F.col("contradicted")), F.count_if(scam)), "truncated": (F.count_if("truncated"), F.count("*")),
    }
    one = records.agg(*(F.struct(a.cast("long").alias("num"), b.cast("long").alias("den")).alias(k) for k, (a, b) in metrics.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"{k}.num").alias("num"), F.col(f"{k}.den").alias("den")) for k in metrics))).alias("x")).select("x.*")


def outcome(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """False positive rate, recall and abstention rate (null without observations), overall or by columns."""
    ham, scam = F.count_if(F.col("label") == "ham"), F.count_if(F.col("label") == "scam")
    fp, tp = F.count_if(F.col("decided") & (F.col("label") == "ham")), F.count_if(F.col("decided") & (F.col("label") == "scam"))
    return records.groupBy(*(by or [])).agg(F.try_divide(fp, ham).alias("false_positive"), F.try_divide(tp, scam).alias("recall"), F.try_divide(F.count_if("abstained"), F.count("*")).alias("abstention"))


def prior_sweep(records: DataFrame, weights: Weights, values: list[float]) -> DataFrame:
    """(value, false_positive, recall, abstention): every score moved by each value; a prior changes no confidence."""
    each = records.withColumn("value", F.explode(F.array(*map(F.lit, values))))
    decided = evaluate.decided(F.col("score") + F.col("value"), F.col("confidence"), F.lit(weights.threshold("confidence_floor")), F.lit(weights.threshold("decision_score")))
    return outcome(each.withColumn("decided", decided), ["value"])


def threshold_sweep(records: DataFrame, weights: Weights, key: str, values: list[float]) -> DataFrame:
    """(value, false_positive, recall, abstention): decisions under each value of the confidence floor or the decision score."""
    if key not in ("confidence_floor", "decision_score"):
        raise KeyError(f"a sweep of {key} needs another fusion, not another decision")
    each = records.withColumn("value", F.explode(F.array(*map(F.lit, values))))
    limit = {k: F.col("value") if k == key else F.lit(weights.threshold(k)) for k in ("confidence_floor", "decision_score")}
    decided = evaluate.decided(F.col("score"), F.col("confidence"), limit["confidence_floor"], limit["decision_score"])
    return outcome(each.withColumns({"decided": decided, "abstained": F.col("confidence") < limit["confidence_floor"]}), ["value"])


def age_sweep(domains: DataFrame, ages: DataFrame, as_of: str, limits: tuple[int, ...] = AGE_LIMITS) -> DataFrame:
    """(days, n_hit, n): requests with a domain younger than each limit, on one frozen table of ages.

    ``domains`` has (req_id, registrable_domain), ``ages`` (domain, outcome, registered_on).
    """
    age = F.when(F.col("outcome") == "KNOWN", F.datediff(F.lit(as_of).cast("date"), F.col("registered_on")))
    rows = domains.join(ages, domains["registrable_domain"] == ages["domain"], "left").groupBy("req_id").agg(F.min(age).alias("youngest"))
    return rows.withColumn("days", F.explode(F.array(*map(F.lit, limits)))).groupBy("days").agg(F.count_if(F.col("youngest") < F.col("days")).alias("n_hit"), F.count("*").alias("n"))


def distinct_domains(links: DataFrame) -> DataFrame:
    """(registrable_domain, first): the domains of (req_id, registrable_domain, ...), each with the first request that has it."""
    return links.where("registrable_domain is not null").groupBy("registrable_domain").agg(F.min("req_id").alias("first"))


def shadowed_counts(records: DataFrame, names: DataFrame) -> DataFrame:
    """(name, shadowed, hits): how often each signal was outdone inside its group, and how often it hit."""
    count = lambda column, alias: records.select(F.explode(F.array_distinct(column)).alias("name")).groupBy("name").agg(F.count("*").alias(alias))
    return names.select("name").join(count("shadowed_signals", "shadowed"), "name", "left").join(count("hit_signals", "hits"), "name", "left").fillna(0, ["shadowed", "hits"])


def fire_rate(scores: DataFrame, threshold: float) -> DataFrame:
    """(subset, fire_rate): the share of scores at or above a threshold."""
    return scores.groupBy("subset").agg(F.avg((F.col("score") >= threshold).cast("int")).alias("fire_rate"))


def conditional_rates(records: DataFrame, classifier: Column, rule: Column) -> DataFrame:
    """(rule_hit, n, fires, rate): how often the classifier fires on scam records with and without a rule hit."""
    grouped = records.where("label = 'scam'").groupBy(rule.alias("rule_hit")).agg(F.count("*").alias("n"), F.count_if(classifier).alias("fires"))
    return grouped.withColumn("rate", F.col("fires") / F.col("n"))


def quantisation(scores: DataFrame, threshold: float) -> DataFrame:
    """(largest, flips) of (exact, rounded): the largest difference, and how many decisions differ."""
    flip = (F.col("exact") >= threshold) != (F.col("rounded") >= threshold)
    return scores.agg(F.max(F.abs(F.col("exact") - F.col("rounded"))).alias("largest"), F.count_if(flip).alias("flips"))


def projected(records: DataFrame, name: str, hard: bool) -> DataFrame:
    """Records whose hit signals are just this one, where it hit as hard (or only as soft) evidence."""
    is_hard, hit = F.array_contains("hard_signals", name), F.array_contains("hit_signals", name)
    own = is_hard if hard else hit & ~is_hard
    return records.withColumn("hit_signals", F.when(own, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))


def require_split(records: DataFrame, split: str) -> DataFrame:
    """The records, all of one split; any other raises an error that names it."""
    wrong = F.raise_error(F.format_string("record %s is of split %s", F.col("id"), F.col("split"))).cast("boolean")
    return records.where(F.when(F.col("split") == split, F.lit(True)).otherwise(wrong))


def tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, n, both, only_a, only_b, neither): decisions of two runs (id, label, decided) over the same samples."""
    joined = a.select("id", "label", F.col("decided").alias("x")).join(b.select("id", F.col("decided").alias("y")), "id")
    x, y = F.col("x"), F.col("y")
    return joined.groupBy("label").agg(F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def data_through(sources: DataFrame) -> DataFrame:
    """(data_through): the oldest date that all sources (source, data_through) reach."""
    return sources.agg(F.min(F.to_date("data_through")).alias("data_through"))


def endpoint_coverage(tlds: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(delegated, covered, missing, missing_two_letter) of (tld) against (tld, url)."""
    joined = tlds.join(endpoints, "tld", "left")
    none = F.col("url").isNull()
    return joined.agg(F.count("*").alias("delegated"), F.count_if(~none).alias("covered"), F.count_if(none).alias("missing"), F.count_if(none & (F.length("tld") == 2)).alias("missing_two_letter"))


def case_studies(records: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Chosen records (id, why) with their texts; an id without a record or a text raises an error."""
    rows = ids.join(records, "id", "left").join(texts.select("id", "text"), "id", "left")
    lost = F.raise_error(F.concat(F.lit("a case without record or text: "), F.col("id"))).cast("boolean")
    return rows.where(F.when(F.col("subset").isNotNull() & F.col("text").isNotNull(), F.lit(True)).otherwise(lost)).select("id", "why", "subset", "score", "confidence", "decided", "text")


def select_pools(pools: DataFrame, known: DataFrame, targets: dict[str, int | None], salts: int = 64) -> DataFrame:
    """Test samples (id, text, subset) of pools (id, text, subset, ord): the first ``targets`` of each subset.

    Development samples (``known`` ids) don't take part; what is an exported
    chat goes to multi_message_scam or multi_message_ham instead and is never
    limited.  The first are found in two steps, so no task sees a whole subset.
    """
    from pyspark.sql import Window as W

    spark = pools.sparkSession
    rows = pools.join(known.select("id"), "id", "left_anti").withColumn("multi", F.regexp_like("text", F.lit(r"^\[LINE\]")))
    limits = spark.createDataFrame([(k, v) for k, v in targets.items()], "subset string, target long")
    single = rows.where("not multi").join(F.broadcast(limits), "subset").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("ord", "id"))
    free = single.where("target is null").select("id", "text", "subset")
    bound = single.where("target is not null").withColumn("rank", rank("subset", "salt")).where("rank <= target").withColumn("rank", rank("subset")).where("rank <= target")
    multi = rows.where("multi").withColumn("subset", F.concat(F.lit("multi_message_"), label_of(F.col("subset"))))
    return free.unionByName(bound.select("id", "text", "subset")).unionByName(multi.select("id", "text", "subset"))


def unique_records(rows: DataFrame) -> DataFrame:
    """(id, text, n): one row per id; an id with two texts raises an error."""
    grouped = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("text").alias("other"), F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("two texts of id "), F.col("id"))).cast("string")
    return grouped.select("id", F.when(F.col("text").eqNullSafe(F.col("other")), F.col("text")).otherwise(twice).alias("text"), "n")


def rates_table(records: DataFrame) -> DataFrame:
    """(kind, name, metric, numerator, denominator, value, lower, upper): all rates of a run, as its report lists them."""
    def of(frame: DataFrame, kind: str, name: Column) -> DataFrame:
        measured = frame.groupBy(name.alias("name")).agg(
            rate(F.count_if(F.col("decided") & (F.col("label") == "ham")), F.count_if(F.col("label") == "ham")).alias("false_positive_rate"),
            rate(F.count_if(F.col("decided") & (F.col("label") == "scam")), F.count_if(F.col("label") == "scam")).alias("recall"), rate(F.count_if("abstained"), F.count("*")).alias("abstention_rate"),
        )
        each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("r")) for m in ("false_positive_rate", "recall", "abstention_rate")))
        rows = measured.select(F.lit(kind).alias("kind"), "name", F.explode(each).alias("x")).where("x.r is not null")
        return rows.select("kind", "name", "x.metric", F.col("x.r.num").alias("numerator"), F.col("x.r.den").alias("denominator"), F.col("x.r.value").alias("value"), F.col("x.r.lower").alias("lower"), F.col("x.r.upper").alias("upper"))

    run = run_rates(records).select(F.lit("run").alias("kind"), F.col("metric").alias("name"), F.lit("share").alias("metric"), rate(F.col("num"), F.col("den")).alias("r")).where("r is not null")
    run = run.select("kind", "name", "metric", F.col("r.num").alias("numerator"), F.col("r.den").alias("denominator"), F.col("r.value").alias("value"), F.col("r.lower").alias("lower"), F.col("r.upper").alias("upper"))
    return of(records, "subset", F.col("subset")).unionByName(of(records, "blocklist_hit", F.col("blocklist_hit").cast("string"))).unionByName(run)


def markdown(rates: DataFrame) -> str:
    """The rates (a few dozen rows) as a Markdown table."""
    lines = ["| kind | name | metric | n | value | 95 % |", "|---|---|---|---|---|---|"]
    for r in rates.orderBy("kind", "name", "metric").collect():
        lines.append(f"| {r.kind} | {r.name} | {r.metric} | {r.numerator}/{r.denominator} | {r.value:.4f} | {r.lower:.4f}-{r.upper:.4f} |")
    return "\n".join(lines) + "\n"


def write_report(records: DataFrame, folder: str) -> None:
    """rates.csv and report.md of a run, and its records as JSON lines; the tables are small, the records stay distributed."""
    rates = rates_table(records)
    rates.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/rates.csv")
    spark: SparkSession = records.sparkSession
    spark.createDataFrame([(markdown(rates),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.md")
    records.write.mode("overwrite").json(f"{folder}/records.jsonl")

"""Evaluation over run records: splits, rates, sweeps, calibration, ablation, samples.

``records`` has one row per sample: (id, subset, label, score, confidence,
probability, abstained, decided, hit_signals, hard_signals, ...).  Reports are
aggregates over it; sweeps count records by grid cell, so detection never runs
again.  What needs an order over all records sorts by range and carries the
totals of earlier ranges over, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoalwater.functions.stats import rate, wilson
from shoalwater.functions.weights import Weights
from shoalwater.scratch import Scratch


def running(rows: DataFrame, order: list[str], values: list[str], descending: bool = False, by: str | None = None) -> DataFrame:
    """``rows`` with before_x for every x of ``values``: its sum over the rows that come earlier (of the same ``by``, if given).

    Rows are dealt by range of ``order``, which must tell all rows apart that
    have values; each range adds the totals of those before it, of which the
    driver holds one row for each range (and value of ``by``, a few labels).
    """
    spark = rows.sparkSession
    work = Scratch(spark, "running")
    sort = [F.desc(c) if descending else F.asc(c) for c in order]
    dealt = work.put(rows.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id()), "ranges")
    group = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("\0"))
    sums = dealt.groupBy(group.alias("_by"), "_range").agg(*(F.sum(v).alias(v) for v in values)).orderBy("_by", "_range").collect()
    total: dict[str, list] = {}
    earlier = []
    for r in sums:
        so_far = total.setdefault(r["_by"], [0] * len(values))
        earlier.append((r["_by"], r["_range"], *so_far))
        total[r["_by"]] = [a + (r[v] or 0) for a, v in zip(so_far, values)]
    kinds = [rows.agg(F.sum(v).alias(v)).schema[v].dataType.simpleString() for v in values]
    table = spark.createDataFrame(earlier, "_by string, _range int, " + ", ".join(f"_earlier_{v} {k}" for v, k in zip(values, kinds)))
    inside = W.partitionBy("_by", "_range").orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumn("_by", group).join(F.broadcast(table), ["_by", "_range"])
    for v in values:
        out = out.withColumn(f"before_{v}", F.col(f"_earlier_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_by", "_range", *(f"_earlier_{v}" for v in values))


def first_byte(text: Column) -> Column:
    """The first byte of the SHA-256 of a text, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int")


def split_of(sample_id: Column, subset: Column) -> Column:
    """tune or holdout, from the identifier alone; self-collected notices are all holdout, conversation ids are digests already."""
    own = F.conv(F.substring(sample_id, 1, 2), 16, 10).cast("int")
    byte = F.when(subset == "conversation_ham", own).otherwise(first_byte(sample_id))
    return F.when(subset == "self_sms_ham", "holdout").otherwise(F.when(byte < 128, "tune").otherwise("holdout"))


def decided(score: Column, confidence: Column, floor: Column, least: Column) -> Column:
    return (confidence >= floor) & (score >= least)


def subset_rates(records: DataFrame) -> DataFrame:
    """Per subset: n, false positive rate (ham), recall (scam), abstention rate; null where a denominator is empty."""
    n, ham, scam = F.count("*"), F.count_if(F.col("label") == "ham"), F.count_if(F.col("label") == "scam")
    hit = lambda label: F.count_if(F.col("decided") & (F.col("label") == label))
    grouped = records.groupBy("subset").agg(n.alias("n"), ham.alias("ham"), scam.alias("scam"), hit("ham").alias("fp"), hit("scam").alias("tp"), F.count_if("abstained").alias("abstained"))
    return grouped.select("subset", "n", rate(F.col("fp"), F.col("ham")).alias("false_positive"), rate(F.col("tp"), F.col("scam")).alias("recall"), rate(F.col("abstained"), F.col("n")).alias("abstention"))


def headline(rates: DataFrame) -> DataFrame:
    """The ham subset whose false positive rate has the highest upper bound; subsets are never pooled."""
    return rates.where("false_positive is not null").select(F.max_by(F.struct("subset", "false_positive"), F.col("false_positive.upper")).alias("x")).select("x.subset", "x.false_positive")


def rates_by_grouping(records: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, name, decided, n): one grouping for each column, in one pass."""
    sets = records.select("decided", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in columns))).alias("g"))
    return sets.groupBy("g.kind", "g.name").agg(F.count_if("decided").alias("decided"), F.count("*").alias("n"))


def signal_estimates(records: DataFrame, signals: DataFrame) -> DataFrame:
    """(name, scam_hits, n_scam, ham_hits, n_ham, state, lower_bound) for every signal of ``signals`` (name).

    estimable: both labels have hits; lower_bound_only: scam only, then
    ln(p_scam / upper bound of 0 in n_ham); not_estimable otherwise.
    """
    totals = records.agg(F.count_if(F.col("label") == "scam").alias("n_scam"), F.count_if(F.col("label") == "ham").alias("n_ham"))
    hits = records.select("label", F.explode(F.array_distinct("hit_signals")).alias("name")).groupBy("name").agg(F.count_if(F.col("label") == "scam").alias("scam_hits"), F.count_if(F.col("label") == "ham").alias("ham_hits"))
    rows = signals.select("name").join(hits, "name", "left").fillna(0, ["scam_hits", "ham_hits"]).join(F.broadcast(totals))
    state = F.when((F.col("scam_hits") > 0) & (F.col("ham_hits") > 0), "estimable").when(F.col("scam_hits") > 0, "lower_bound_only").otherwise("not_estimable")
    upper = wilson(F.lit(0), F.greatest(F.col("n_ham"), F.lit(1)))[1]
    bound = F.when((F.col("scam_hits") > 0) & (F.col("ham_hits") == 0) & (F.col("n_ham") > 0), F.ln(F.col("scam_hits") / F.greatest(F.col("n_scam"), F.lit(1)) / upper))
    return rows.select("name", "scam_hits", "n_scam", "ham_hits", "n_ham", state.alias("state"), bound.alias("lower_bound"))


def calibration_exits(estimates: DataFrame, widest: float = 1.9) -> DataFrame:
    """Adds exit (measured, wide, lower_bound, not_estimable) and the measured weight ln(p_scam / p_ham)."""
    lo_s, hi_s = wilson(F.col("scam_hits"), F.greatest(F.col("n_scam"), F.lit(1)))
    lo_h, hi_h = wilson(F.col("ham_hits"), F.greatest(F.col("n_ham"), F.lit(1)))
    both = F.col("state") == "estimable"
    width = F.when(both, F.ln(hi_s / lo_h) - F.ln(lo_s / hi_h))
    name = F.when(both & (width <= widest), "measured").when(both, "wide").when(F.col("state") == "lower_bound_only", "lower_bound").otherwise("not_estimable")
    value = F.when(both & (width <= widest), F.ln((F.col("scam_hits") / F.col("n_scam")) / (F.col("ham_hits") / F.col("n_ham"))))
    return estimates.withColumn("width", width).withColumn("exit", name).withColumn("weight", F.round(value, 6))


def confidence_cuts(records: DataFrame) -> DataFrame:
    """(floor): midpoints between neighbouring distinct confidence values (a ladder of a few steps)."""
    steps = records.agg(F.array_sort(F.collect_set("confidence")).alias("c"))
    middle = F.transform(F.slice("c", F.lit(2), F.size("c")), lambda x, i: (F.get("c", i) + x) / 2)
    return steps.where(F.size("c") > 1).select(F.explode(middle).alias("floor"))


def threshold_grid(records: DataFrame, grid: DataFrame) -> DataFrame:
    """(floor, least, recall, false_positive, abstention) for every cell of ``grid`` (floor, least).

    The grid (a few hundred cells) is held by the driver.  Each record counts
    once, under how many floors and scores it reaches; cells add up these
    counts, whose number depends on the grid alone.
    """
    cells = [(float(r.floor), float(r.least)) for r in grid.distinct().collect()]
    floors, leasts = sorted({f for f, _ in cells}), sorted({x for _, x in cells})
    reached = lambda limits, c: F.size(F.filter(F.array(*map(F.lit, limits)).cast("array<double>"), lambda x: x <= F.col(c)))
    spark = records.sparkSession
    counts = records.groupBy(reached(floors, "confidence").alias("f"), reached(leasts, "score").alias("x"), "label").agg(F.count("*").alias("n"))
    table = spark.createDataFrame([(f, x, floors.index(f), leasts.index(x)) for f, x in cells], "floor double, least double, i int, j int")
    joined = F.broadcast(table).join(counts)
    hit = (F.col("f") > F.col("i")) & (F.col("x") > F.col("j"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return joined.groupBy("floor", "least").agg(
        F.try_divide(total(hit & (F.col("label") == "scam")), total(F.col("label") == "scam")).alias("recall"), F.try_divide(total(hit & (F.col("label") == "ham")), total(F.col("label") == "ham")).alias("false_positive"),
        F.try_divide(total(F.col("f") <= F.col("i")), F.sum("n")).alias("abstention"),
    )


def _by_score(scores: DataFrame) -> DataFrame:
    return scores.groupBy("score").agg(F.count_if(F.col("label") == "scam").alias("s"), F.count_if(F.col("label") == "ham").alias("h"), F.count("*").alias("n"))


def score_sweep(scores: DataFrame) -> DataFrame:
    """(threshold, scam_hits, ham_hits, n_scam, n_ham) at every distinct score: cumulative counts from above."""
    total = F.broadcast(scores.agg(F.count_if(F.col("label") == "scam").alias("n_scam"), F.count_if(F.col("label") == "ham").alias("n_ham")))
    above = running(_by_score(scores), ["score"], ["s", "h"], descending=True)
    return above.select(F.col("score").alias("threshold"), (F.col("before_s") + F.col("s")).alias("scam_hits"), (F.col("before_h") + F.col("h")).alias("ham_hits")).join(total)


def choose_threshold(sweep: DataFrame, ceiling: float = 0.02) -> DataFrame:
    """The least threshold with ham and scam hits whose false positive upper bound stays under the ceiling."""
    upper = wilson(F.col("ham_hits"), F.col("n_ham"))[1]
    return sweep.where((upper <= ceiling) & (F.col("ham_hits") > 0) & (F.col("scam_hits") > 0)).agg(F.min("threshold").alias("threshold"))


def auc(scores: DataFrame) -> DataFrame:
    """Area under the curve by rank sums, ties at their mean rank, from counts per distinct score."""
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    ranks = running(_by_score(scores), ["score"], ["n"]).agg(F.sum(F.col("s") * rank).alias("r"), F.sum("s").alias("p"), F.sum(F.col("n") - F.col("s")).alias("q"))
    return ranks.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * F.col("q")).cast("double")).alias("auc"))


def calibration_bins(records: DataFrame, least: int = 30, enough: int = 100) -> DataFrame:
    """(bin, n, mean_probability, observed): bins of equal size by probability, the last takes the remainder; none under ``enough`` rows."""
    rows = records.where("probability is not null").select("probability", "id", "label", F.lit(1).alias("one"))
    n = F.broadcast(rows.agg(F.count("*").alias("total")))
    bins = F.greatest(F.lit(1), F.floor(F.col("total") / least))
    size = F.floor(F.col("total") / bins)
    numbered = running(rows, ["probability", "id"], ["one"]).join(n).where(F.col("total") >= enough).withColumn("bin", F.least(F.floor(F.col("before_one") / size), bins - 1))
    return numbered.groupBy("bin").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg((F.col("label") == "scam").cast("double")).alias("observed"))


def classifier_metrics(records: DataFrame) -> DataFrame:
    """(precision, recall, f1) of decisions."""
    tp, fp, fn = F.count_if(F.col("decided") & (F.col("label") == "scam")), F.count_if(F.col("decided") & (F.col("label") == "ham")), F.count_if(~F.col("decided") & (F.col("label") == "scam"))
    c = records.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def ablated(detection, weights: Weights, dropped: list[str]) -> DataFrame:
    """Verdicts without some signals: rows leave the signals table and fusion runs again, detection does not."""
    from shoalwater.operators.fuse import fuse

    return fuse(detection.requests, detection.sentences, detection.signals.where(~F.col("name").isin(dropped)), weights)


def content_sample(rows: DataFrame, text: Column, salt: str, n: int) -> DataFrame:
    """The n rows with the smallest salted digest of their text: a sample that does not depend on row order."""
    return rows.withColumn("sample_key", F.sha2(F.concat(F.lit(salt), text), 256)).orderBy("sample_key").limit(n)


def stratified_sample(rows: DataFrame, stratum: str, sample_id: str, n: int, salts: int = 64) -> DataFrame:
    """A proportional share of each stratum (rounded half to even), by digest of the identifier.

    A stratum is dealt over ``salts`` tasks, of which each hands on no more
    than the stratum's share; shares add up to about ``n``.
    """
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    share = rows.groupBy(stratum).agg(F.count("*").alias("own")).join(total).select(F.col(stratum).alias("_stratum"), F.bround(F.lit(n) * F.col("own") / F.col("total")).alias("_share"))
    keyed = rows.withColumns({"_key": F.sha2(F.col(sample_id).cast("string"), 256), "_salt": F.pmod(F.xxhash64(sample_id), F.lit(salts))}).join(F.broadcast(share), F.col(stratum).eqNullSafe(F.col("_stratum")))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("_key", sample_id))
    first = keyed.withColumn("_rank", rank("_stratum", "_salt")).where("_rank <= _share")
    return first.withColumn("_rank", rank("_stratum")).where("_rank <= _share").drop("_key", "_salt", "_stratum", "_share", "_rank")


def first_by_content(rows: DataFrame, text: Column, order: str) -> DataFrame:
    """The first row of each content digest, found with map-side combination: a digest that most rows share is never gathered."""
    keyed = rows.withColumn("content_id", F.sha2(text, 256))
    first = F.struct(order, *(c for c in rows.columns if c != order))
    return keyed.groupBy("content_id").agg(F.min(first).alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in rows.columns), "content_id")


def drift(known: DataFrame, current: DataFrame) -> DataFrame:
    """(id, change): identifiers of ``known`` (id, text_sha256) that are deleted from or edited in ``current``."""
    gone = known.join(current, "id", "left_anti").select("id", F.lit("deleted").alias("change"))
    edited = known.alias("k").join(current.alias("c"), "id").where("k.text_sha256 <> c.text_sha256").select("id", F.lit("edited").alias("change"))
    return gone.unionByName(edited)


def unaccepted(changes: DataFrame, accepted: DataFrame) -> DataFrame:
    """Changes that no row of ``accepted`` (id, change) allows."""
    return changes.join(accepted, ["id", "change"], "left_anti")


def message_flags(text: Column) -> Column:
    """Ordered flags: url_only, line_export, too_short, too_long."""
    residue = F.length(F.regexp_replace(F.regexp_replace(text, r"https?://\S+|www\.\S+", ""), r"\s+", ""))
    has_url = F.regexp_like(text, F.lit(r"https?://\S|www\.\S"))
    n = F.length(text)
    flags = F.array(F.when(has_url & (residue < 10), "url_only"), F.when(F.regexp_like(text, F.lit(r"^\[LINE\]")), "line_export"), F.when(n < 8, "too_short"), F.when(n > 2000, "too_long"))
    return F.filter(flags, lambda f: f.isNotNull())

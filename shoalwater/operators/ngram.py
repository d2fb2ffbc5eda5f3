"""Character n-gram classifier: scoring, evidence, training and threshold choice.

Scoring is a narrow map: every task holds the model's terms (a table of a few
thousand rows, broadcast), looks each different word up once, and counts, weighs
and adds a text's known grams in arrays, so no gram ever crosses the network.
Only training counts grams over the corpus.  A text without a known gram scores
the intercept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.operators.evaluate import running
from shoalwater.operators.rules import STRIDE


@dataclass(frozen=True)
class Model:
    """Terms (gram, idf, coef), the intercept and the sizes of grams."""

    terms: tuple[tuple[str, float, float], ...]
    intercept: float
    sizes: tuple[int, int] = (1, 2)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.terms), "gram string, idf double, coef double")


def word_grams(word: str, sizes: tuple[int, int]) -> list[str]:
    """Grams of a word padded by spaces; one shorter than a size gives itself once and no longer sizes."""
    padded, out = f" {word} ", []
    for n in range(sizes[0], sizes[1] + 1):
        out += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
        if n >= len(padded):
            break
    return out


class _Words(dict):
    """What each word contributes, worked out once; cleared when it grows beyond ``most`` words."""

    def __init__(self, of, most: int = 200_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.of(word)
        return found


def gram_counts(texts: DataFrame, sizes: tuple[int, int], vocabulary: list[str] | None = None) -> DataFrame:
    """(req_id, gram, tf) of texts (req_id, text), one text for each request; only grams of ``vocabulary`` if given."""
    known = None if vocabulary is None else texts.sparkSession.sparkContext.broadcast(frozenset(vocabulary))
    kind = texts.schema["req_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(lambda w: [g for g in word_grams(w, sizes) if known is None or g in known.value])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [Counter(chain.from_iterable(map(words.__getitem__, (t.as_py() or "").lower().split()))) for t in part.column(1)]
                of = np.repeat(np.arange(part.num_rows), [len(c) for c in counts])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(chain.from_iterable(c.keys() for c in counts), pa.string()), pa.array(chain.from_iterable(c.values() for c in counts), pa.int64())], names=["req_id", "gram", "tf"]
                )

    return texts.select("req_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"req_id {kind}, gram string, tf long")


def scored(texts: DataFrame, model: Model, mass: float = 0.5) -> DataFrame:
    """(req_id, ngram_score, leading) of texts (req_id, text): L2-normalised weights times coefficients plus the intercept.

    ``leading`` lists (gram, part), the largest positive contributions until
    their sum reaches ``mass`` of all positive ones, inclusive.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kind = texts.schema["req_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = [g for g, _, _ in own.terms]
        idf, coef = (np.array([t[i] for t in own.terms], dtype=np.float64) for i in (1, 2))
        number = {g: i for i, g in enumerate(names)}
        words = _Words(lambda w: [number[g] for g in word_grams(w, own.sizes) if g in number])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores, leading = [], []
                for t in part.column(1):
                    ids = np.fromiter(chain.from_iterable(map(words.__getitem__, (t.as_py() or "").lower().split())), dtype=np.int64)
                    term, tf = np.unique(ids, return_counts=True)
                    value = (1 + np.log(tf)) * idf[term]
                    size = np.sqrt((value * value).sum())
                    each = value * coef[term] / size if size else value
                    scores.append(float(each.sum()) + own.intercept)
                    gain = sorted(((-p, names[k]) for p, k in zip(each.tolist(), term.tolist()) if p > 0))
                    before = np.concatenate([[0.0], np.cumsum([-p for p, _ in gain])])
                    leading.append([{"gram": g, "part": -p} for (p, g), b in zip(gain, before) if b < mass * before[-1]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(leading, pa.list_(pa.struct([("gram", pa.string()), ("part", pa.float64())])))], names=["req_id", "ngram_score", "leading"])

    return texts.select("req_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"req_id {kind}, ngram_score double, leading array<struct<gram:string,part:double>>")


def gram_scores(texts: DataFrame, model: Model) -> DataFrame:
    """(req_id, ngram_score, ngram_probability)."""
    return scored(texts, model).select("req_id", "ngram_score", (1 / (1 + F.exp(-F.col("ngram_score")))).alias("ngram_probability"))


def evidence_grams(texts: DataFrame, model: Model, mass: float = 0.5) -> DataFrame:
    """(req_id, gram, part): the leading contributions."""
    return scored(texts, model, mass).select("req_id", F.inline("leading"))


def ngram_signals(sentences: DataFrame, texts: DataFrame, model: Model, threshold: float, ordinal: int) -> DataFrame:
    """One signal per request at or above the threshold; evidence are the sentences that hold its leading grams."""
    hit = scored(texts, model).where(F.col("ngram_score") >= threshold)
    shown = F.exists("leading", lambda x: (F.trim(x["gram"]) != "") & F.contains(F.lower("text"), F.trim(x["gram"])))
    at = sentences.join(hit.select("req_id", "leading"), "req_id").where(shown).groupBy("req_id").agg(F.array_sort(F.collect_set(F.struct("m", "s"))).alias("evidence"))
    return hit.join(at, "req_id", "left").select(
        "req_id", F.lit("ngram_classifier").alias("name"), (F.lit(ordinal) * F.lit(STRIDE)).alias("ord"), F.lit(True).alias("hit"), F.lit(False).alias("hard"), F.lit(False).alias("indeterminate"),
        F.format_string("字元 n-gram 分數 %.6f，門檻 %.6f", "ngram_score", F.lit(threshold)).alias("detail"), F.coalesce("evidence", F.array().cast("array<struct<m:int,s:int>>")).alias("evidence"), F.array().cast("array<string>").alias("scam_types"),
    )


def fit_idf(texts: DataFrame, sizes: tuple[int, int], max_features: int | None = None) -> DataFrame:
    """(gram, df, tf, idf) with smoothed idf ln((1 + n) / (1 + df)) + 1; the most frequent grams first, ties by gram."""
    n = texts.select(F.count("*").alias("n"))
    terms = gram_counts(texts, sizes).groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).join(F.broadcast(n))
    terms = terms.select("gram", "df", "tf", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return terms if max_features is None else terms.orderBy(F.desc("tf"), "gram").limit(max_features)


def train(texts: DataFrame, labels: DataFrame, sizes: tuple[int, int] = (1, 2), max_features: int = 10_000, regularisation: float = 1.0, max_iter: int = 100) -> Model:
    """Logistic regression on L2-normalised, log-scaled tf-idf; ``labels`` has (req_id, label 0 or 1).

    The vocabulary (``max_features`` rows at most) becomes the model's table;
    training itself is distributed.  Coefficients are rounded to 8 decimals.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    spark = texts.sparkSession
    listed = fit_idf(texts, sizes, max_features).select("gram", "idf").orderBy("gram").collect()
    index = spark.createDataFrame([(r.gram, i, r.idf) for i, r in enumerate(listed)], "gram string, i int, idf double")
    parts = gram_counts(texts, sizes).join(index, "gram").select("req_id", "i", ((1 + F.ln("tf")) * F.col("idf")).alias("v"))
    size = len(listed)

    @F.udf(VectorUDT())
    def vector(rows):
        norm = sum(r.v * r.v for r in rows) ** 0.5
        return Vectors.sparse(size, [(r.i, r.v / norm) for r in rows])

    rows = parts.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("r")).join(labels, "req_id").select(vector("r").alias("features"), F.col("label").cast("double").alias("label"))
    n = rows.count()
    fitted = LogisticRegression(regParam=1.0 / (regularisation * max(n, 1)), maxIter=max_iter, standardization=False).fit(rows)
    coefs = fitted.coefficients.toArray()
    return Model(tuple((r.gram, round(r.idf, 8), round(float(c), 8)) for r, c in zip(listed, coefs)), round(float(fitted.intercept), 8), sizes)


def folds(labels: DataFrame, n: int = 5) -> DataFrame:
    """(req_id, label, fold): each label dealt evenly over the folds in order of a digest of the identifier."""
    keyed = labels.withColumns({"_key": F.sha2(F.col("req_id").cast("string"), 256), "_one": F.lit(1)})
    return running(keyed, ["_key", "req_id"], ["_one"], by="label").select(*labels.columns, (F.col("before__one") % n).cast("int").alias("fold"))


def grid_search(texts: DataFrame, labels: DataFrame, cells: list[tuple[tuple[int, int], int]], n_folds: int = 5, **options) -> DataFrame:
    """(low, high, max_features, precision, recall, f1) of cross-validated cells, best first: by F1, then fewer features.

    Each cell's folds are trained in turn; every training is distributed.
    """
    dealt = folds(labels, n_folds)
    spark, out = texts.sparkSession, []
    for (low, high), features in cells:
        tp = fp = fn = 0
        for k in range(n_folds):
            own = texts.join(dealt.where(F.col("fold") != k).select("req_id"), "req_id", "left_semi")
            model = train(own, dealt.where(F.col("fold") != k).select("req_id", "label"), (low, high), features, **options)
            rest = texts.join(dealt.where(F.col("fold") == k).select("req_id"), "req_id", "left_semi")
            hit = gram_scores(rest, model).join(dealt, "req_id").select((F.col("ngram_score") >= 0).alias("hit"), (F.col("label") == 1).alias("scam"))
            r = hit.agg(F.count_if(F.col("hit") & F.col("scam")).alias("tp"), F.count_if(F.col("hit") & ~F.col("scam")).alias("fp"), F.count_if(~F.col("hit") & F.col("scam")).alias("fn")).first()
            tp, fp, fn = tp + r.tp, fp + r.fp, fn + r.fn
        precision, recall = tp / (tp + fp) if tp + fp else None, tp / (tp + fn) if tp + fn else None
        out.append((low, high, features, precision, recall, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else None))
    rows = spark.createDataFrame(out, "low int, high int, max_features int, precision double, recall double, f1 double")
    return rows.orderBy(F.desc_nulls_last("f1"), "max_features")

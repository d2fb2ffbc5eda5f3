"""Tables that a run is configured with: weights, lookup tables, n-gram models, suffixes, test sets.

These are files of kilobytes, read whole by Spark's readers (so any store that
Spark reaches will do), checked on the driver and handed on as small frames or
dataclasses.  Nothing falls back to a default: what is missing or doubtful
raises an error that names it.
"""

from __future__ import annotations

import json
import math
import tomllib
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwater.functions.weights import Weights
from shoalwater.operators.ngram import Model
from shoalwater.operators.urls import Suffixes
from shoalwater.sources import snapshots

# Weights without a measurement, the tolerance of a measured one, thresholds above zero, required roles.
PLACEHOLDERS = (2.5, 0.6, 0.0, -1.5)
TOLERANCE = 0.01
POSITIVE = ("sigmoid_temperature",)
ROLES = ("quotation", "relationship", "blocklist_exact")
# What a model's manifest must hold, and the one formula that is implemented.
MANIFEST = (
    "trained_on", "testset_manifest_sha256", "n_scam", "n_ham", "sklearn_version", "analyzer", "ngram_range", "max_features", "sublinear_tf", "norm", "smooth_idf", "lowercase", "value_decimals", "threshold",
)
FORMULA = {"analyzer": "char_wb", "sublinear_tf": True, "norm": "l2", "smooth_idf": True, "lowercase": True}


def whole(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} holds {len(rows)} files, not one")
    return rows[0][0]


def _take(row: dict, key: str, kind: type | tuple, where: str):
    if key not in row:
        raise ValueError(f"{where} lacks {key}")
    if not isinstance(row[key], kind) or (isinstance(row[key], bool) and kind is not bool):
        raise ValueError(f"{where}: {key} is {row[key]!r}")
    if kind is str and not row[key].strip():
        raise ValueError(f"{where}: {key} is empty")
    return row[key]


def _measured(row: dict, where: str) -> tuple[float, float]:
    """The probabilities of a measured value, both strictly between 0 and 1."""
    pair = tuple(float(_take(row, k, (int, float), where)) for k in ("p_hit_given_scam", "p_hit_given_ham"))
    if not all(0 < p < 1 for p in pair):
        raise ValueError(f"{where}: probabilities lie between 0 and 1, not {pair}")
    _take(row, "measured_on", str, where)
    return pair


def _basis(row: dict, where: str, needs: tuple[str, ...]) -> tuple[float, float] | None:
    """Probabilities of a measured row; None for a placeholder, which must say where it comes from and carry none."""
    basis = _take(row, "basis", str, where)
    if basis == "measured":
        return _measured(row, where)
    if basis != "placeholder":
        raise ValueError(f"{where}: basis is {basis!r}")
    if any(k in row for k in ("p_hit_given_scam", "p_hit_given_ham")):
        raise ValueError(f"{where}: a placeholder carries no probabilities")
    for key in needs:
        _take(row, key, str, where)
    return None


def _weight(row: dict, where: str) -> float:
    """A weight: measured ones equal the logarithm of their ratio, others are one of a closed set."""
    value = float(_take(row, "value", (int, float), where))
    pair = _basis(row, where, ("inherited_from", "blocked_on"))
    if pair and abs(value - math.log(pair[0] / pair[1])) > TOLERANCE:
        raise ValueError(f"{where}: {value} is not ln({pair[0]} / {pair[1]})")
    if not pair and value not in PLACEHOLDERS:
        raise ValueError(f"{where}: {value} has no measurement")
    return value


def _signal(row: dict) -> tuple:
    name = _take(row, "name", str, "a signal")
    where = f"signal {name}"
    hard_capable, strong = _take(row, "hard_capable", bool, where), _take({"strong": False, **row}, "strong", bool, where)
    if hard_capable and strong:
        raise ValueError(f"{where} can't be both hard and strong")
    if hard_capable != ("weight_hard" in row):
        raise ValueError(f"{where}: weight_hard belongs to signals that can be hard, and to all of them")
    soft = _weight(_take(row, "weight_soft", dict, where), f"{where}, soft")
    hard = _weight(_take(row, "weight_hard", dict, where), f"{where}, hard") if hard_capable else None
    return name, _take(row, "group", str, where), soft, hard, strong


def _check_groups(signals: list[tuple], rationale: dict) -> None:
    """A group of several signals says which one fact makes them hit together."""
    members: dict[str, int] = {}
    for _, group, *_ in signals:
        members[group] = members.get(group, 0) + 1
    if silent := sorted(g for g, n in members.items() if n > 1 and not rationale.get(g)):
        raise ValueError(f"groups without a rationale: {silent}")


def _roles(table: dict, names: set[str]) -> dict[str, str]:
    if missing := [r for r in ROLES if r not in table]:
        raise ValueError(f"roles without a signal: {missing}")
    if unknown := sorted(set(table.values()) - names):
        raise ValueError(f"roles of unknown signals: {unknown}")
    return table


def _thresholds(table: dict) -> dict[str, float]:
    out = {}
    for key, row in table.items():
        _basis(row, f"threshold {key}", ("rationale", "blocked_on"))
        out[key] = float(_take(row, "value", (int, float), f"threshold {key}"))
        if key in POSITIVE and out[key] <= 0:
            raise ValueError(f"threshold {key} must be positive, not {out[key]}")
    return out


def _priorities(rows: list[dict], labels: dict[str, str]) -> tuple[tuple[str, str], ...]:
    """Categories in order of cases: descending, complete, each once."""
    names = [_take(r, "name", str, "a priority") for r in rows]
    cases = [_take(r, "cases", (int, float), f"priority {n}") for r, n in zip(rows, names)]
    for r, n in zip(rows, names):
        _take(r, "source", str, f"priority {n}")
    if unknown := sorted(set(names) - set(labels)):
        raise ValueError(f"unknown categories: {unknown}")
    if any(b > a for a, b in zip(cases, cases[1:])):
        raise ValueError("priorities are not in descending order of cases")
    if len(set(names)) < len(names) or set(labels) - set(names):
        raise ValueError(f"each category occurs once; missing: {sorted(set(labels) - set(names))}")
    return tuple((n, labels[n]) for n in names)


def parse_weights(text: str, labels: dict[str, str] | None = None) -> Weights:
    """A weight table from TOML, after every check."""
    table = tomllib.loads(text)
    for key in ("signal", "roles", "thresholds", "type_priority"):
        if key not in table:
            raise ValueError(f"the weight table lacks {key}")
    signals = [_signal(r) for r in table["signal"]]
    _check_groups(signals, table.get("group_rationale", {}))
    roles = _roles(table["roles"], {s[0] for s in signals})
    return Weights(
        tuple(signals), MappingProxyType(_thresholds(table["thresholds"])), _priorities(table["type_priority"], labels or dict(Weights().categories)), roles["quotation"], roles["relationship"], roles["blocklist_exact"],
    )


def load_weights(spark: SparkSession, path: str) -> Weights:
    return parse_weights(whole(spark, path))


def _toml(value) -> str:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)


def render_weights(text: str, measured: dict[tuple[str, bool], tuple[float, float]], measured_on: str) -> str:
    """The TOML text with the weights of (signal, hard) replaced by measured ones: ln(p_scam / p_ham) with both probabilities."""
    table = tomllib.loads(text)
    left = dict(measured)
    for row in table["signal"]:
        for key, hard in (("weight_soft", False), ("weight_hard", True)):
            if pair := left.pop((row["name"], hard), None) if key in row else None:
                row[key] = {"value": round(math.log(pair[0] / pair[1]), 6), "basis": "measured", "p_hit_given_scam": pair[0], "p_hit_given_ham": pair[1], "measured_on": measured_on}
    if left:
        raise KeyError(f"no such weights: {sorted(left)}")
    lines = []
    for name, rows in table.items():
        for row in rows if isinstance(rows, list) else [rows]:
            lines.append(f"[[{name}]]" if isinstance(rows, list) else f"[{name}]")
            lines += [f"{_toml(k) if '.' in k else k} = {_toml(v)}" for k, v in row.items() if not isinstance(v, dict)]
            for key, sub in ((k, v) for k, v in row.items() if isinstance(v, dict)):
                lines += [f"[{name}.{key}]", *(f"{k} = {_toml(v)}" for k, v in sub.items())]
            lines.append("")
    return "\n".join(lines)


# ---------------------------------------------------------------- lookup tables

TABLES = {
    "brands": ("brands", ("chinese_name", "official_domains", "source", "verified_on")), "shorteners": ("shorteners", ("domain", "service", "source", "verified_on")),
    "tld_risk": ("tlds", ("tld", "metric", "value", "as_of", "source")),
}


@dataclass(frozen=True)
class LookupTables:
    """Brands, shorteners and the risk of top-level domains, with the baseline that the risk is compared with."""

    brands: list[tuple[str, str, str]]
    shorteners: DataFrame
    tld_risks: DataFrame
    baseline: tuple[str, float]

    def known_services(self) -> list[str]:
        """Official domains and shorteners."""
        return sorted({d for _, own, _ in self.brands for d in own.split()} | {r.domain for r in self.shorteners.collect()})


def _listed(loaded: dict, name: str) -> list[dict]:
    key, fields = TABLES[name]
    for i, row in enumerate(loaded[key]):
        if missing := [f for f in fields if f not in row]:
            raise ValueError(f"{name}, row {i} lacks {missing}; it has {sorted(row)}")
    return loaded[key]


def load_tables(spark: SparkSession, folder: str) -> LookupTables:
    """The three lookup tables of a folder (brands.json, shorteners.json, tld_risk.json)."""
    loaded = {name: json.loads(whole(spark, f"{folder}/{name}.json")) for name in TABLES}
    brands = _listed(loaded["brands"], "brands")
    if bare := [b["chinese_name"] for b in brands if not b["official_domains"]]:
        raise ValueError(f"brands without an official domain: {bare}")
    short = [(r["domain"], r["service"]) for r in _listed(loaded["shorteners"], "shorteners")]
    risks = [(r["tld"], float(r["value"]), r["as_of"], r["source"]) for r in _listed(loaded["tld_risk"], "tld_risk")]
    base = loaded["tld_risk"]["baseline"]
    return LookupTables(
        [(b["chinese_name"], " ".join(b["official_domains"]), " ".join(b.get("label_tokens", []))) for b in brands], spark.createDataFrame(short, "domain string, service string"),
        spark.createDataFrame(risks, "tld string, value double, as_of string, source string"), (base["tld"], float(base["value"])),
    )


# ---------------------------------------------------------------- models


def parse_model(text: str) -> Model:
    """An n-gram model from JSON, if its manifest is complete and names the formula that is implemented."""
    loaded = json.loads(text)
    for key in ("manifest", "intercept", "terms"):
        if key not in loaded:
            raise ValueError(f"the model lacks {key}")
    manifest = loaded["manifest"]
    if missing := [f for f in MANIFEST if f not in manifest]:
        raise ValueError(f"the model's manifest lacks {missing}")
    if other := {k: manifest[k] for k, v in FORMULA.items() if manifest[k] != v}:
        raise ValueError(f"another formula than the one implemented: {other}")
    if not loaded["terms"]:
        raise ValueError("a model without terms")
    return Model(tuple((g, float(idf), float(coef)) for g, (idf, coef) in loaded["terms"].items()), float(loaded["intercept"]), tuple(manifest["ngram_range"]))


def load_model(spark: SparkSession, path: str) -> Model:
    return parse_model(whole(spark, path))


def render_model(model: Model, manifest: dict) -> str:
    """The JSON text of a model, values rounded to the manifest's decimals."""
    digits = manifest["value_decimals"]
    own = {**manifest, **FORMULA, "ngram_range": list(model.sizes)}
    return json.dumps({"manifest": own, "intercept": round(model.intercept, digits), "terms": {g: [round(i, digits), round(c, digits)] for g, i, c in model.terms}}, ensure_ascii=False)


def measured_probabilities(text: str, name: str) -> tuple[float, float]:
    """The two probabilities of a signal's soft weight; one that is not measured raises an error."""
    for row in tomllib.loads(text)["signal"]:
        if row["name"] == name:
            return _measured(row["weight_soft"], f"signal {name}")
    raise KeyError(f"no signal {name}")


# ---------------------------------------------------------------- lists and samples


def load_suffixes(spark: SparkSession, folder: str, as_of: str, max_age_days: int) -> Suffixes:
    """The public suffix list of a snapshot (suffixes.dat, manifest.json) if its checksum holds and it is fresh."""
    manifest = snapshots.read_manifest(spark, f"{folder}/manifest.json", ("sha256", "fetched_at", "rule_count"))
    path = f"{folder}/suffixes.dat"
    if snapshots.checksum(spark, path) != manifest["sha256"]:
        raise ValueError("the suffix list's checksum differs from its manifest")
    snapshots.check_sources({"suffixes": {"data_through": manifest["fetched_at"]}}, as_of, {"suffixes": max_age_days}, redistributable=False)
    found = Suffixes.parse(whole(spark, path))
    if len(found.rules) != manifest["rule_count"]:
        raise ValueError(f"{len(found.rules)} rules, {manifest['rule_count']} in the manifest")
    return found


def load_allowlist(spark: SparkSession, folder: str, as_of: str, max_age_days: int) -> DataFrame:
    """(domain, rank) of an allowlist snapshot (entries.jsonl, manifest.json); ranks are integers up to the manifest's threshold."""
    manifest = snapshots.read_manifest(spark, f"{folder}/manifest.json", ("threshold", "data_through"))
    limit = manifest["threshold"]
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError(f"the threshold is {limit!r}, not an integer")
    snapshots.check_sources({"allowlist": {"data_through": manifest["data_through"]}}, as_of, {"allowlist": max_age_days}, redistributable=False)
    rows = spark.read.text(f"{folder}/entries.jsonl").where(F.trim("value") != "")
    rank = F.get_json_object("value", "$.rank")
    plain = F.regexp_like("value", F.lit(r'"rank"\s*:\s*-?[0-9]+\s*[,}]'))
    rows = rows.select(F.get_json_object("value", "$.domain").alias("domain"), F.when(plain, rank.cast("int")).alias("rank"))
    return snapshots.guarded(rows, F.col("domain").isNotNull() & F.col("rank").isNotNull() & (F.col("rank") <= limit), "an allowlist entry without domain or integer rank, or beyond the threshold")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, split at line feeds only; a line that is no object of the schema raises an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Write JSON lines (nulls as null); the number of rows is observed while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def write_manifest(rows: DataFrame, path: str, **fields) -> dict:
    """Write {n, digest, ...} of a table: its number of rows and an order-free digest of them; returns what is written."""
    state = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s")).first()
    found = {"record_count": state.n, "rows_digest": str(state.s or 0), **fields}
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(found, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return found


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def load_testset(spark: SparkSession, folder: str, subsets: list[str]) -> tuple[DataFrame, list[str]]:
    """Samples (id, text, subset) of the folder's <subset>.jsonl, and the subsets that have no file."""
    there = [s for s in subsets if exists(spark, f"{folder}/{s}.jsonl")]
    rows = spark.createDataFrame([], "id string, text string, subset string")
    for s in there:
        rows = rows.unionByName(read_jsonl(spark, f"{folder}/{s}.jsonl", "id string, text string").withColumn("subset", F.lit(s)))
    return rows, [s for s in subsets if s not in there]

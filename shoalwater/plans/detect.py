"""Detection over a table of messages: local signals, gated expensive ones, one verdict per request."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwater.functions.weights import Weights
from shoalwater.operators import document, evasion, fuse, ngram, quotation, rules, urls
from shoalwater.scratch import Scratch


@dataclass
class Dimensions:
    """Reference tables of a run; what is absent leaves its checks out, as an unregistered check would be."""

    suffixes: urls.Suffixes | None = None
    blocklist: DataFrame | None = None
    allowlist: DataFrame | None = None
    shorteners: DataFrame | None = None
    tld_risks: DataFrame | None = None
    brands: list[tuple[str, str, str]] | None = None
    known_services: list[str] = field(default_factory=list)
    ages: DataFrame | None = None
    as_of: str | None = None
    model: ngram.Model | None = None
    judgements: DataFrame | None = None


def local_signals(sentences: DataFrame, messages: DataFrame, catalogue: rules.Catalogue, dims: Dimensions, weights: Weights, markers: dict | None = None) -> DataFrame:
    """All signals that need no outside service; ordinals follow the order of registration."""
    n = len(catalogue.rules)
    parts = [rules.rule_signals(sentences, catalogue)]
    if catalogue.relationship:
        parts.append(rules.relationship_signals(sentences, catalogue, n))
    parts.append(evasion.evasion_signals(sentences, catalogue, n + 1))
    parts.append(quotation.quotation_signals(sentences, messages, n + 6, **(markers or {})))
    if dims.suffixes:
        links = urls.extract_urls(sentences, dims.suffixes)
        domains = urls.by_domain(links)
        if dims.blocklist is not None:
            parts.append(urls.blocklist_signals(urls.blocklist_matches(domains, dims.blocklist, dims.allowlist, dims.known_services), n + 7))
        if dims.shorteners is not None:
            parts.append(urls.shortener_signals(links, dims.shorteners, n + 8))
        if dims.tld_risks is not None:
            parts.append(urls.tld_signals(domains, dims.tld_risks, dims.known_services, n + 9))
        parts.append(urls.shape_signals(links, n + 10))
        parts.append(urls.brand_signals(links, sentences, urls.brand_table(sentences.sparkSession, dims.brands), n + 11))
    if dims.model:
        parts.append(ngram.ngram_signals(sentences, document.document_text(sentences), dims.model, weights.threshold("ngram_threshold"), n + 12))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expensive_signals(requests: DataFrame, sentences: DataFrame, local: DataFrame, catalogue: rules.Catalogue, dims: Dimensions, weights: Weights) -> DataFrame | None:
    """Domain ages and replayed model judgements, only for requests that local evidence does not settle."""
    open_ = requests.select("req_id").join(fuse.short_circuited(local, weights), "req_id", "left_anti")
    parts = []
    if dims.ages is not None and dims.suffixes and dims.as_of and dims.shorteners is not None:
        own = sentences.join(open_, "req_id", "left_semi")
        parts.append(urls.age_signals(urls.by_domain(urls.extract_urls(own, dims.suffixes)), dims.ages, dims.shorteners, dims.as_of, len(catalogue.rules) + 13))
    if dims.judgements is not None:
        from shoalwater.operators import replay

        parts.append(replay.model_signals(replay.validated(dims.judgements.join(open_, "req_id", "left_semi"), sentences), len(catalogue.rules) + 14))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


@dataclass
class Detection:
    """What a run leaves: requests, sentences, signals (tables) and verdicts (a plan over them)."""

    requests: DataFrame
    sentences: DataFrame
    signals: DataFrame
    verdicts: DataFrame


def detect(
    messages: DataFrame, catalogue: rules.Catalogue | None = None, dims: Dimensions | None = None, weights: Weights | None = None, limits: document.Limits = document.Limits(),
    short_circuit: bool = True, markers: dict | None = None,
) -> Detection:
    """Verdicts for messages (req_id, msg_idx, sender, text).

    Analysed messages and the signals table are written once in the shared
    scratch folder: every later query (fusion, sweeps, ablation) reads the
    small tall table instead of texts.
    """
    catalogue, dims, weights = catalogue or rules.default_catalogue(), dims or Dimensions(), weights or Weights()
    weights.validate_against(set(catalogue.names()))
    work = Scratch(messages.sparkSession, "detect")
    analysed = work.put(document.analysed_messages(messages, limits), "analysed")
    sentences, requests = document.sentences_of(analysed), document.requests_of(analysed)
    kept = analysed.where("kept").select("req_id", "msg_idx", "text")
    signals = work.put(local_signals(sentences, kept, catalogue, dims, weights, markers), "local")
    more = expensive_signals(requests, sentences, signals if short_circuit else signals.limit(0), catalogue, dims, weights)
    if more is not None:
        signals = work.put(signals.unionByName(more), "signals")
    return Detection(requests, sentences, signals, fuse.fuse(requests, sentences, signals, weights, ("llm_scam", "llm_suspicious") if dims.judgements is not None else ()))

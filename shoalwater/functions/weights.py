"""Signal weights, groups, thresholds, categories and actions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

# Signal name, group, soft weight, hard weight (or None), strong.
SIGNALS = [
    ("solicit_otp", "credential_solicit", 0.6, 2.5, False),
    ("solicit_card_secret", "credential_solicit", 0.6, 2.5, False),
    ("solicit_bank_credentials", "credential_solicit", 0.6, 2.5, False),
    ("deliver_bank_instrument", "deliver_bank_instrument", 0.6, 2.5, False),
    ("atm_operation", "authority_script", 0.6, 2.5, False),
    ("safe_account", "authority_script", 0.6, 2.5, False),
    ("secrecy_demand", "authority_script", 0.6, 2.5, False),
    ("remote_control_tool", "authority_script", 0.6, 2.5, False),
    ("prepay_to_receive", "advance_fee", 0.6, 2.5, False),
    ("seller_verification", "seller_verification", 0.6, 2.5, False),
    ("guaranteed_return", "too_good_offer", 0.6, None, False),
    ("romance_pretext", "advance_fee", 0.6, None, False),
    ("identity_docs", "credential_solicit", 0.6, None, False),
    ("escort_deposit", "advance_fee", 0.6, None, False),
    ("game_code", "credential_solicit", 0.6, None, False),
    ("identity_reset", "identity_reset", 0.6, None, False),
    ("charity_personal_account", "advance_fee", 0.6, None, False),
    ("parcel_notice", "parcel_notice", 0.6, None, False),
    ("loan_no_check", "too_good_offer", 0.6, None, False),
    ("high_pay_no_skill", "too_good_offer", 0.6, None, False),
    ("relationship_building", "relationship_building", 0.6, None, False),
    ("evasion_invisible", "evasion", 0.6, None, False),
    ("evasion_width_mix", "evasion", 0.6, None, False),
    ("evasion_split_word", "evasion", 0.6, None, False),
    ("evasion_homophone", "evasion", 0.6, None, False),
    ("evasion_zhuyin", "evasion", 0.6, None, False),
    ("quotation", "quotation", -1.569821, None, False),
    ("url_blocklist", "url_reputation", 0.6, 2.5, False),
    ("url_shortener", "url_shortener", -2.143387, None, False),
    ("url_tld_risk", "url_reputation", 0.6, None, False),
    ("url_host_shape", "url_reputation", 0.6, None, False),
    ("url_brand", "url_reputation", 0.6, None, False),
    ("ngram_classifier", "ngram_classifier", 4.351698, None, True),
    ("domain_age", "url_reputation", 0.6, None, False),
    ("llm_scam", "llm_semantic", 0.6, None, True),
    ("llm_suspicious", "llm_semantic", 0.6, None, True),
]
# Thresholds.
THRESHOLDS = {
    "ngram_threshold": 0.241478, "prior_log_odds": 0.0, "sigmoid_offset": 0.0, "sigmoid_temperature": 1.0, "decision_score": 1.5,
    "base_hard": 0.9, "base_multi_group": 0.55, "base_single_strong": 0.7, "base_single_group": 0.35, "base_no_hit": 0.05,
    "cap_contradiction": 0.3, "cap_unseen_pattern": 0.35, "cap_truncated": 0.5, "max_evidence_lines": 5, "max_actions": 3, "confidence_floor": 0.4,
}
# Categories in order of priority, with their labels.
CATEGORIES = [
    ("FAKE_INVESTMENT", "假投資"), ("ROMANCE_INVESTMENT", "假交友(投資詐財)"), ("SEXUAL_SERVICE", "色情應召"), ("FAKE_BUYER", "假買家騙賣家"),
    ("ROMANCE_MARRIAGE", "假交友(徵婚詐財)"), ("PHISHING_LINK", "釣魚簡訊/惡意連結"), ("FAKE_LOAN", "假借銀行貸款"), ("FAKE_AUTHORITY", "假檢警/假冒公務機關"),
    ("BANK_ACCOUNT_HARVEST", "騙取金融帳戶(卡片)"), ("GAME_ITEM", "虛擬遊戲"), ("FAKE_PRIZE", "假中獎通知"), ("FAKE_JOB", "假求職"),
    ("ACCOUNT_TAKEOVER", "盜用通訊軟體帳號"), ("INSTALLMENT_CANCEL", "解除分期付款"), ("GUESS_WHO", "猜猜我是誰"), ("ORDER_ANOMALY", "假消費異常"),
    ("FAKE_CHARITY", "假慈善機關(急難救助)"), ("FAKE_PARCEL", "假借包裹招領"),
]
# Recommended actions, the groups they apply to (* for any), harm if the message is genuine.
ACTIONS = [
    ("撥打 165 反詐騙專線查證", "*", "無"),
    ("不要提供簡訊驗證碼、金融卡密碼或網銀帳號密碼給任何人", "credential_solicit deliver_bank_instrument", "無"),
    ("不要點訊息裡的連結，改用你自己找到的官方 App 或網址", "url_reputation url_shortener", "無"),
    ("用你自己查到的官方客服電話回撥，不要回撥訊息裡的號碼", "authority_script parcel_notice seller_verification", "無"),
    ("查證前不要依訊息指示操作", "*", "可回復的延遲"),
    ("匯款前先與家人或行員談過", "advance_fee too_good_offer", "可回復的延遲"),
]
HARMLESS = "無"
QUOTATION, RELATIONSHIP, BLOCKLIST = "quotation", "relationship_building", "url_blocklist"


@dataclass(frozen=True)
class Weights:
    """An immutable weight table; the few dozen rows travel with the plan as a broadcast relation."""

    signals: tuple = tuple(SIGNALS)
    thresholds: MappingProxyType = field(default_factory=lambda: MappingProxyType(dict(THRESHOLDS)))
    categories: tuple = tuple(CATEGORIES)
    quotation: str = QUOTATION
    relationship: str = RELATIONSHIP
    blocklist: str = BLOCKLIST

    def __post_init__(self) -> None:
        names = [s[0] for s in self.signals]
        if len(set(names)) != len(names):
            raise ValueError("a signal is registered twice")
        for name, _, _, hard, strong in self.signals:
            if hard is not None and strong:
                raise ValueError(f"{name} can't be both hard and strong")
        if len({c for c, _ in self.categories}) != len(self.categories):
            raise ValueError("a category occurs twice")
        if missing := set(THRESHOLDS) - set(self.thresholds):
            raise ValueError(f"thresholds without a value: {sorted(missing)}")

    def threshold(self, name: str) -> float:
        """A threshold; an unknown name raises KeyError."""
        return self.thresholds[name]

    def rows(self) -> list[tuple[str, str, bool, float, bool]]:
        """(name, group, hard, weight, strong) for each admissible pair of name and hardness."""
        soft = [(n, g, False, w, s) for n, g, w, _, s in self.signals]
        return soft + [(n, g, True, h, s) for n, g, _, h, s in self.signals if h is not None]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "name string, grp string, hard boolean, weight double, strong boolean")

    def with_overrides(self, weights: dict[str, float] | None = None, thresholds: dict[str, float] | None = None, groups: dict[str, str] | None = None) -> Weights:
        """A derived table; overriding what does not exist raises KeyError."""
        weights, thresholds, groups = weights or {}, thresholds or {}, groups or {}
        names = {s[0] for s in self.signals}
        if unknown := (set(weights) | set(groups)) - names | set(thresholds) - set(self.thresholds):
            raise KeyError(f"not in the table: {sorted(unknown)}")
        signals = tuple((n, groups.get(n, g), weights.get(n, w), h, s) for n, g, w, h, s in self.signals)
        return replace(self, signals=signals, thresholds=MappingProxyType({**self.thresholds, **thresholds}))

    def validate_against(self, names: set[str]) -> None:
        """Every registered check needs a weight; all that lack one are named."""
        if missing := names - {s[0] for s in self.signals}:
            raise KeyError(f"checks without a weight: {sorted(missing)}")

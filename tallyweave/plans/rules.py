"""Rule documents: both published forms become one immutable ``Rule``."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from ..schema import ROLES

DEFAULT_SEARCH_LIMIT = 10_000
DUPLICATE_LAYERS = ("exact_key", "content_fingerprint", "retransmit")
ACTIONS = ("report", "exclude", "ignore")


@dataclass(frozen=True)
class Tolerance:
    """Inclusive bounds; None is not enabled, and with neither enabled anything is within."""

    absolute: int | None = None
    bps: int | None = None

    @property
    def enabled(self) -> bool:
        return self.absolute is not None or self.bps is not None


@dataclass(frozen=True)
class OneToMany:
    anchor_role: str
    many_role: str
    max_members: int = 2


@dataclass(frozen=True)
class Rule:
    rule_id: str = "rule"
    allowed_roles: tuple[str, ...] = ROLES
    amount: Tolerance = Tolerance()
    fee: Tolerance = Tolerance()
    window_ns: int = 0
    dup_policy: dict[str, str] = field(default_factory=dict)
    one_to_many: OneToMany | None = None
    search_limit: int = DEFAULT_SEARCH_LIMIT

    def action(self, layer: str) -> str:
        return self.dup_policy.get(layer, "report")


def _tolerance(doc: dict | None, config: bool) -> Tolerance:
    low = {str(k).lower(): v for k, v in (doc or {}).items() if v is not None}
    bps = low.get("pctbps", low.get("pct_bps"))
    if config and bps == 0:
        bps = None  # in the configuration form zero means: not used
    return Tolerance(low.get("abs"), bps)


def rule_from_document(doc: dict) -> Rule:
    """A rule out of the stored form (time_window_ns, Abs/PctBps) or the configuration form (time_window_seconds, abs/pct_bps)."""
    config = "time_window_seconds" in doc
    window = int(doc["time_window_seconds"] * 1_000_000_000) if config else int(doc.get("time_window_ns", 0))
    many = doc.get("one_to_many")
    limit = doc.get("search_limit") or 0
    rule = Rule(
        rule_id=doc.get("rule_id", "rule"),
        allowed_roles=tuple(doc.get("allowed_roles") or ROLES),
        amount=_tolerance(doc.get("amount_tolerance"), config),
        fee=_tolerance(doc.get("fee_tolerance"), config),
        window_ns=window,
        dup_policy=dict(doc.get("dup_policy") or {}),
        one_to_many=OneToMany(many["anchor_role"], many["many_role"], max(2, many.get("max_members") or 0)) if many else None,
        search_limit=limit if limit > 0 else DEFAULT_SEARCH_LIMIT,
    )
    if not rule.amount.enabled:
        warnings.warn(f"rule {rule.rule_id}: no amount tolerance, any amounts are within", stacklevel=2)
    return rule


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    revision: int = 1


def ruleset_from_document(doc: dict) -> RuleSet:
    return RuleSet(tuple(map(rule_from_document, doc.get("rules", []))), int(doc.get("revision", 1)))


#: The rule of the tests: five minor units, equal fees, two minutes.
DEFAULT_RULE = Rule("default", ROLES, Tolerance(5), Tolerance(0), 120_000_000_000, {"exact_key": "exclude", "retransmit": "report", "content_fingerprint": "report"})

"""First-match rules over a document's verdict, as one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.operators.scoring import at_least


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    reason: str
    when: Column


def label_in(*labels: str) -> Column:
    return F.col("label").isin(*labels)


def risk_at_least(risk: float) -> Column:
    return F.col("risk") >= risk


def detector_hit(*detectors: str, severity: str = "low") -> Column:
    return F.exists(at_least(F.col("evidence"), severity), lambda e: e["detector_id"].isin(*detectors))


def any_evidence() -> Column:
    return F.size("evidence") > 0


def scan_failed() -> Column:
    return F.col("error").isNotNull()


def default_rules() -> list[Rule]:
    tests = (scan_failed(), label_in("dangerous"), any_evidence(), label_in("caution"))
    return [Rule(*row, test) for row, test in zip(fixed.POLICY, tests, strict=True)]


@dataclass
class Policy:
    """Rules in order; a test that gives null doesn't match. Without a match the document is allowed."""

    rules: list[Rule] = field(default_factory=list)
    name: str = "default"

    def add(self, rule: Rule) -> None:
        self.rules.append(rule)

    def decision(self) -> Column:
        parts = {"action": F.lit("allow"), "rule_id": F.lit("fallback-allow"), "reason": F.lit("no rule matched")}
        for rule in reversed(self.rules):
            test = F.coalesce(rule.when, F.lit(False))
            parts = {k: F.when(test, F.lit(v)).otherwise(parts[k]) for k, v in (("action", rule.action), ("rule_id", rule.id), ("reason", rule.reason))}
        return F.struct(*[v.alias(k) for k, v in parts.items()], F.lit(self.name).alias("policy_name"))


def decide(verdicts: DataFrame, policy: Policy | None = None) -> DataFrame:
    return verdicts.withColumn("decision", (policy or Policy(default_rules())).decision())

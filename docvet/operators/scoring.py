"""Counts, risk and trust from a document's findings. Sums of decimals, so that no order of addition matters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions import fixed
from docvet.functions.ir import settled


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.SEVERITIES)), severity) - 1


def at_least(found: Column, severity: str) -> Column:
    """The findings of at least a severity."""
    return F.filter(found, lambda e: rank(e["severity"]) >= fixed.SEVERITIES.index(severity))


def without(found: Column, *detectors: str) -> Column:
    return F.filter(found, lambda e: ~e["detector_id"].isin(*detectors))


def count_of(found: Column, severity: str) -> Column:
    return F.size(F.filter(found, lambda e: e["severity"] == severity))


def risk(found: Column) -> Column:
    """The weights' sum, at most 1, in four places."""
    table = F.create_map(*[F.lit(x) for s, w in fixed.RISK_WEIGHTS.items() for x in (s, w)])
    total = F.aggregate(found, F.lit(0), lambda a, e: a + table[e["severity"]])
    return F.round(F.least(F.lit(1.0), total / F.lit(100.0)), 4)


def _penalty(found: Column) -> Column:
    table = F.create_map(*[x for s, w in fixed.TRUST_WEIGHTS.items() for x in (F.lit(s), F.lit(Decimal(w)).cast("decimal(6,4)"))])
    return F.aggregate(found, F.lit(0).cast("decimal(14,4)"), lambda a, e: (a + table[e["severity"]]).cast("decimal(14,4)"))


def _score(penalty: Column) -> Column:
    return (F.lit(1) - F.least(F.lit(1).cast("decimal(14,4)"), penalty)).cast("decimal(6,4)")


def structure(found: Column) -> Column:
    return _score(_penalty(F.filter(found, lambda e: e["detector_id"].isin(*fixed.CONCEALING))))


def first_hint(body: Column) -> Column:
    """The first phrase of the list that the lower-cased text holds."""
    return F.coalesce(*[F.when(F.contains(body, F.lit(h)), F.lit(h)) for h in fixed.HINTS])


def content(found: Column, first: Column) -> Column:
    words = F.size(F.filter(found, lambda e: (e["detector_id"] == "DET-007") & (e["title"] == "Suspicious metadata content")))
    hint = F.when(first.isNotNull(), F.lit(Decimal("0.15"))).otherwise(F.lit(Decimal("0.00")))
    return _score((words * F.lit(Decimal("0.4")) + _penalty(F.filter(found, lambda e: e["detector_id"] == "DET-008")) + hint).cast("decimal(14,4)"))


def meta(found: Column) -> Column:
    mine = F.filter(found, lambda e: e["detector_id"] == "DET-007")
    macros = F.size(F.filter(mine, lambda e: F.contains(e["title"], F.lit("VBA")) | F.contains(F.lower(e["title"]), F.lit("macro"))))
    scripts = F.size(F.filter(mine, lambda e: F.contains(e["title"], F.lit("JavaScript"))))
    return _score((macros * F.lit(Decimal("0.6")) + scripts * F.lit(Decimal("0.3"))).cast("decimal(14,4)"))


def reasons(found: Column, hint_: Column) -> Column:
    """Why the scores are what they are, in the order structure, content, meta."""
    hidden = F.filter(found, lambda e: e["detector_id"].isin(*fixed.CONCEALING))
    ids = F.array_join(F.array_sort(F.array_distinct(F.transform(hidden, lambda e: e["detector_id"]))), "/")
    first = F.when(F.size(hidden) > 0, F.concat(F.lit("hidden content: "), F.size(hidden).cast("string"), F.lit(" finding(s) ("), ids, F.lit(")")))
    words = F.transform(F.filter(found, lambda e: e["title"] == "Suspicious metadata content"), lambda e: F.lit("suspicious keywords in metadata"))
    orders = F.transform(F.filter(found, lambda e: e["detector_id"] == "DET-008"), lambda e: F.concat(F.lit("code-comment directive ("), e["raw"]["class"], F.lit(", "), e["severity"], F.lit(")")))
    hint = F.concat(F.lit("instruction-like phrasing in document ('"), hint_, F.lit("')"))
    other = F.transform(
        F.filter(found, lambda e: (e["detector_id"] == "DET-007") & (e["title"] != "Suspicious metadata content")),
        lambda e: F.when(F.contains(e["title"], F.lit("VBA")), "VBA/macro present").otherwise("JavaScript present"),
    )
    return F.filter(F.concat(F.array(first), words, orders, F.array(hint), other), lambda x: x.isNotNull())


def trust(df: DataFrame, body: Column) -> DataFrame:
    """df (evidence, error) and structure, content, meta, score, label, reasons, risk. A failed scan scores 0 and is dangerous."""
    found = F.col("evidence")
    failed = F.col("error").isNotNull()
    zero = F.lit(Decimal("0.0000")).cast("decimal(6,4)")
    df = settled(settled(df, "_text", F.lower(body)), "_hint", first_hint(F.col("_text")))
    for k, v in (("structure", structure(found)), ("content", content(found, F.col("_hint"))), ("meta", meta(found))):
        df = settled(df, k, F.when(failed, zero).otherwise(v))
    raw = (F.lit(Decimal("0.5")) * F.col("structure") + F.lit(Decimal("0.3")) * F.col("content") + F.lit(Decimal("0.2")) * F.col("meta")).cast("decimal(6,4)")
    ordered = F.exists(found, lambda e: (e["detector_id"] == "DET-008") & (rank(e["severity"]) >= fixed.SEVERITIES.index("high")))
    cap = F.when((F.col("structure") <= Decimal("0.2")) | ordered, Decimal("0.39")).when(F.col("structure") < 1, Decimal("0.6")).otherwise(Decimal("1"))
    df = settled(df, "score", F.least(raw, cap.cast("decimal(6,4)")))
    label = F.when(F.col("score") >= Decimal("0.7"), "safe").when(F.col("score") >= Decimal("0.4"), "caution").otherwise("dangerous")
    return settled(settled(df, "label", label), "risk", risk(found)).withColumn("reasons", reasons(found, F.col("_hint"))).drop("_text", "_hint")


def exit_code(severity: str = "info") -> Column:
    """3 for a failed scan, 1 with a finding of at least the severity, else 0."""
    return F.when(F.col("error").isNotNull(), 3).when(F.size(at_least(F.col("evidence"), severity)) > 0, 1).otherwise(0)

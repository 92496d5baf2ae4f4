"""Tables that only grow: the audit log, approval requests and their decisions, and the cache of decisions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import docvet
from docvet.functions import fixed
from docvet.operators import reports, scoring

AUDIT = "timestamp string, file string, kind string, status string, risk_score double, summary struct<info: int, low: int, medium: int, high: int, critical: int, total: int>, trust_label string, decision string, rule_id string, sanitized boolean, note string"
APPROVAL = "id string, created_at string, file string, kind string, reason string, rule_id string, risk_score double, trust_label string, sanitized_text_preview string, status string, decided_at string, decision_by string"


def now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def audit_entries(verdicts: DataFrame, note: str = "", at: Column | None = None) -> DataFrame:
    return verdicts.select(
        (at if at is not None else now()).alias("timestamp"), F.col("source").alias("file"), "kind", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
        scoring.risk(F.col("evidence")).alias("risk_score"), reports.summary(F.col("evidence")).alias("summary"), F.col("label").alias("trust_label"), F.col("decision.action").alias("decision"),
        F.col("decision.rule_id").alias("rule_id"), (F.col("decision.action") == "quarantine").alias("sanitized"), F.lit(note).alias("note"),
    )


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """The log's rows; blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tail(log: DataFrame, n: int = 100, order: str = "timestamp") -> DataFrame:
    """The last n rows, the newest last."""
    return log.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def request_id(*parts: Column) -> Column:
    """Twelve digits that name a request; the same request has the same name, so writing it twice does no harm."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def approval_requests(verdicts: DataFrame, at: Column | None = None) -> DataFrame:
    """A pending request for each document that a human must approve."""
    none = F.lit(None).cast("string")
    return verdicts.filter("decision.action = 'human_approval'").select(
        request_id(F.col("source"), F.col("decision.rule_id"), F.sha2("sanitized.text", 256)).alias("id"), (at if at is not None else now()).alias("created_at"), F.col("source").alias("file"), "kind",
        F.col("decision.reason").alias("reason"), F.col("decision.rule_id").alias("rule_id"), scoring.risk(F.col("evidence")).alias("risk_score"), F.col("label").alias("trust_label"),
        F.substring("sanitized.text", 1, fixed.PREVIEW_CHARS).alias("sanitized_text_preview"), F.lit("pending").alias("status"), none.alias("decided_at"), none.alias("decision_by"),
    )


def current(log: DataFrame) -> DataFrame:
    """Each request's state: its first decision if it has one, since only a pending request can be decided, else pending."""
    decided = F.when(F.col("status") != "pending", F.col("decided_at"))
    order = Window.partitionBy("id").orderBy(decided.asc_nulls_last(), F.col("created_at"))
    return log.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def pending(log: DataFrame) -> DataFrame:
    return current(log).filter("status = 'pending'")


def decide(log: DataFrame, request: str, status: str, by: str, at: Column | None = None) -> DataFrame:
    """The row to append that decides a pending request; none where there is no such request."""
    if status not in ("approved", "rejected"):
        raise ValueError("a request is approved or rejected")
    return pending(log).filter(F.col("id") == request).withColumns({"status": F.lit(status), "decided_at": at if at is not None else now(), "decision_by": F.lit(by)})


def namespace(mode: str = "strip", rules: tuple[str, ...] = tuple(r[0] for r in fixed.POLICY)) -> str:
    """Names all that a cached decision depends on beside the file: version, mode, detectors, rules."""
    digest = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()[:8]
    return f"{docvet.__version__}|{mode}|{len(fixed.DETECTORS)}:{digest(sorted(fixed.DETECTORS))}|{digest(rules)}"


def cache_key(path: Column, modified: Column, size: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", path, modified.cast("string"), size.cast("string")), 256), 1, 32)


def cache_split(found: DataFrame, cache: DataFrame, space: str) -> tuple[DataFrame, DataFrame]:
    """Files with a decision in the cache, with it, and files without. An entry counts if it has the file's path, size and
    content hash and the namespace, and an action; the time of change alone never makes a hit."""
    known = cache.filter((F.col("namespace") == space) & F.col("action").isNotNull()).select("path", "length", "sha256", "action", "label", "rule_id")
    found = found.withColumn("sha256", F.sha2("content", 256))
    keys = ["path", "length", "sha256"]
    return found.join(known, keys), found.join(known, keys, "left_anti")


def cache_entries(verdicts: DataFrame, space: str) -> DataFrame:
    """What the cache keeps of a verdict; the text only of what is quarantined."""
    return verdicts.select(
        F.lit(space).alias("namespace"), "path", "length", "sha256", F.col("decision.action").alias("action"), "label", F.col("decision.rule_id").alias("rule_id"),
        F.when(F.col("decision.action") == "quarantine", F.col("sanitized.text")).otherwise("").alias("sanitized_text"), reports.note(F.col("source")).alias("note"),
    )

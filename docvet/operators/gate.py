"""The gate before a read and the look at what tools return, as expressions over tables of payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions import fixed, text
from docvet.operators import reports


@dataclass(frozen=True)
class Settings:
    extensions: tuple[str, ...] = (*(e for exts in fixed.KIND_EXTENSIONS.values() for e in exts), *fixed.UNPARSEABLE_EXTENSIONS, *fixed.CODE_EXTENSIONS)
    quarantine: str = "quarantine"
    fail_closed: bool = True
    substitute: bool = True
    most_bytes: int = fixed.MOST_FILE_BYTES
    most_strings: int = fixed.MOST_STRINGS


def quarantine_name(path: Column) -> Column:
    return F.concat(F.substring(F.sha2(path, 256), 1, 16), F.lit(".txt"))


def pre_read(payloads: DataFrame, verdicts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A decision for each payload (event, tool, path): payload columns, outcome, rule, reason, new_path.

    verdicts: path, length, kind, source, evidence, error, label, decision of the files that exist; one row for each path.
    Tests in order: another event or tool, no path, a name that isn't enforced (unless its content is a document), a
    missing file, a file that is too large, a format that can't be read, then the file's decision.
    """
    s = settings or Settings()
    path = F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/"))
    own = verdicts.select(F.col("path").alias("_path"), "length", F.col("kind").alias("_kind"), "source", "evidence", "error", F.col("label").alias("_label"), F.col("decision").alias("_decision"))
    df = payloads.withColumn("_p", path).join(own, F.col("_p") == F.col("_path"), "left")
    ext, name = text.extension(F.col("_p")), F.lower(text.file_name(F.col("_p")))
    missing = F.col("_path").isNull()
    shown = F.when(ext == "", "(none)").otherwise(F.concat(F.lit("."), ext))
    enforced = ext.isin(*s.extensions) | name.isin(*fixed.RULE_FILES) | F.coalesce(F.col("_kind").isin(*fixed.DOCUMENT_KINDS), F.lit(False))
    deny = "deny" if s.fail_closed else "allow"
    action, note = F.col("_decision.action"), reports.note(F.col("source"))
    tail = F.concat(F.lit(" ("), F.col("_label"), F.lit(", "), note, F.lit(")"))
    rule = F.col("_decision.rule_id")
    cases = [
        (~(F.coalesce(F.col("event") == "PreToolUse", F.lit(False)) & F.coalesce(F.col("tool") == "Read", F.lit(False))), "allow", F.lit("not an enforced tool call")),
        (F.col("_p") == "", "allow", F.lit("no file_path")),
        (~enforced, "allow", F.concat(F.lit("extension "), shown, F.lit(" not enforced"))),
        (missing, deny, F.concat(F.lit("file missing or unreadable: "), F.col("_p"))),
        (F.col("length") > s.most_bytes, deny, F.concat(F.lit("file exceeds max_file_bytes ("), F.col("length").cast("string"), F.lit(f" > {s.most_bytes})"))),
        (ext.isin(*fixed.UNPARSEABLE_EXTENSIONS), deny, F.concat(shown, F.lit(" cannot be scanned"))),
        (action.isNull(), deny, F.concat(F.lit("unscannable document ("), shown, F.lit(")"))),
        (action == "allow", "allow", F.concat(F.lit("clean"), tail)),
        ((action == "quarantine") & F.lit(not s.substitute), "deny", F.concat(rule, F.lit(" quarantined"), tail)),
        (action == "quarantine", "allow", F.concat(rule, F.lit(" quarantine -> sanitized copy"))),
        (action == "human_approval", "ask", F.concat(rule, F.lit(" requires human approval"), tail)),
    ]
    outcome, reason = F.lit("deny"), F.concat(rule, F.lit(" blocked the read"), tail)
    for test, o, r in reversed(cases):
        outcome, reason = F.when(test, F.lit(o)).otherwise(outcome), F.when(test, r).otherwise(reason)
    df = df.withColumns({"outcome": outcome, "reason": reason})
    judged = F.col("reason").startswith("clean") | F.col("reason").startswith("POL-")
    swapped = (F.col("outcome") == "allow") & F.col("reason").endswith("sanitized copy")
    return df.select(
        *payloads.columns, "outcome", F.when(judged, rule).alias("rule"), "reason", F.when(swapped, F.concat(F.lit(f"{s.quarantine}/"), quarantine_name(F.col("_p")))).alias("new_path")
    )


def rendered(decided: DataFrame) -> Column:
    """The answer to a pre-read payload as JSON."""
    inner = F.struct(
        F.lit("PreToolUse").alias("hookEventName"), F.col("outcome").alias("permissionDecision"), F.col("reason").alias("permissionDecisionReason"), F.when(F.col("new_path").isNotNull(), F.struct(F.col("new_path").alias("file_path"))).alias("updatedInput")
    )
    return F.to_json(F.struct(inner.alias("hookSpecificOutput")))


def hook_exit_code(decided: DataFrame, settings: Settings | None = None) -> Column:
    """2 where a read is denied by the exit code alone (the answer can't be made or shown), else 0: a gate that fails closed
    answers a payload without outcome with 2, one that fails open with 0."""
    return F.when(F.col("outcome").isNull() & F.lit((settings or Settings()).fail_closed), 2).otherwise(0)


def rendered_post() -> Column:
    """The answer to a payload after a tool has run, as JSON with the context alone; empty where there is nothing to say."""
    inner = F.struct(F.lit("PostToolUse").alias("hookEventName"), F.col("context").alias("additionalContext"))
    return F.when(F.col("context").isNull(), "").otherwise(F.to_json(F.struct(inner.alias("hookSpecificOutput"))))


def post_tool_audit(seen: DataFrame, tool: str, at: Column) -> DataFrame:
    """The audit rows of what post_tool() saw: one for each response with such characters, always allowed."""
    none = lambda kind: F.lit(None).cast(kind)
    counts = F.concat(F.lit("invisible="), F.col("n_invisible").cast("string"), F.lit(", bidi="), F.col("n_bidi").cast("string"))
    return seen.filter("context is not null").select(
        at.alias("timestamp"), F.col(tool).alias("file"), F.lit("tool_response").alias("kind"), F.lit("ok").alias("status"), none("double").alias("risk_score"),
        none("struct<info: int, low: int, medium: int, high: int, critical: int, total: int>").alias("summary"), none("string").alias("trust_label"), F.lit("allow").alias("decision"),
        F.lit(fixed.POST_TOOL_RULE).alias("rule_id"), F.lit(False).alias("sanitized"), counts.alias("note"),
    )


#: A string of a JSON text, with the colon behind it if it names a field.
JSON_STRING = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?'


def string_leaves(json: Column) -> Column:
    """The strings at any depth of a JSON value, in its order; names of fields are none. A value that is no JSON has none."""
    leaves = F.filter(F.regexp_extract_all(json, F.lit(JSON_STRING), F.lit(0)), lambda s: ~s.endswith(":"))
    return F.when(F.try_parse_json(json).isNotNull(), F.transform(leaves, lambda s: F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0))))


def post_tool(payloads: DataFrame, response: str, settings: Settings | None = None) -> DataFrame:
    """payloads and n_invisible, n_bidi over the response's first strings, and context: what to say of them, or null."""
    s = settings or Settings()
    leaves = F.slice(F.coalesce(string_leaves(F.col(response)), F.array().cast("array<string>")), 1, s.most_strings)
    df = payloads.withColumn("_leaves", leaves)
    total = lambda count: F.aggregate("_leaves", F.lit(0), lambda a, x: a + count(x))
    df = df.withColumns({"n_invisible": total(text.count_invisible), "n_bidi": total(text.count_bidi)})
    words = F.concat(F.lit("this tool result contains "), F.col("n_invisible").cast("string"), F.lit(" invisible and "), F.col("n_bidi").cast("string"), F.lit(" bidi control character(s) that a human reader does not see"))
    return df.withColumn("context", F.when(F.col("n_invisible") + F.col("n_bidi") > 0, words)).drop("_leaves")

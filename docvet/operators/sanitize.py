"""Text that is safe to pass on: hidden content removed or marked, directive comments made inert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions import fixed, text
from docvet.functions.ir import settled


def defused(line: Column, family: Column, klass: Column, mode: str) -> Column:
    """A comment of the same indent and prefix that says what was removed."""
    indent = F.regexp_extract(line, r"(?U)^([\s\x1c-\x1f]*)", 1)
    marker = F.lit(fixed.REDACTED_LINE) if mode == "redact" else F.concat(F.lit(f"{fixed.REMOVED} (class="), klass, F.lit(")"))
    return F.concat(indent, text.comment_prefix(line, family), F.lit(" "), marker)


def sanitize(docs: DataFrame, mode: str = "strip") -> DataFrame:
    """docs (the model and evidence) and sanitized: text, removed (type, location, reason), mode.

    In this order a paragraph with a directive comment is replaced, one of a hidden sheet left out; in all others hidden
    runs go, or become a marker where mode is redact, and invisible characters and direction controls always go. Paragraphs
    left blank are left out; the rest are joined by line feeds.
    """
    if mode not in ("strip", "redact"):
        raise ValueError("mode must be 'strip' or 'redact'")
    found = F.col("evidence")
    orders = F.map_from_entries(
        F.array_distinct(F.transform(F.filter(found, lambda e: e["detector_id"] == "DET-008"), lambda e: F.struct(e["paragraph"].alias("k"), e["raw"]["class"].alias("v"))))
    )
    sheets = F.transform(F.filter(found, lambda e: (e["detector_id"] == "DET-004") & e["row"].isNull() & e["col"].isNull()), lambda e: e["sheet"])
    runs = F.transform(F.filter(found, lambda e: (e["detector_id"] != "DET-008") & e["run"].isNotNull()), lambda e: F.struct(e["paragraph"].alias("p"), e["run"].alias("r")))
    for name, value in (("_orders", orders), ("_sheets", sheets), ("_runs", runs)):
        docs = settled(docs, name, value)
    gone = F.lit(fixed.REDACTED if mode == "redact" else "")

    def kept(p: Column) -> Column:
        hidden = lambda r, i: r["is_hidden"] | F.exists("_runs", lambda x: (x["p"] == p["idx"]) & (x["r"] == i))
        runs_text = F.array_join(F.transform(p["runs"], lambda r, i: F.when(F.coalesce(hidden(r, i), F.lit(False)), gone).otherwise(r["text"])), "")
        return F.struct(p.alias("p"), F.col("_orders")[p["idx"]].alias("klass"), F.coalesce(F.array_contains("_sheets", p["sheet"]), F.lit(False)).alias("in_sheet"), text.clean(runs_text).alias("kept"))

    def each(x: Column) -> Column:
        p, klass = x["p"], x["klass"]
        out = F.when(klass.isNotNull(), defused(p["text"], F.col("family"), klass, mode)).when(x["in_sheet"], F.lit(None)).when(x["kept"].rlike(r"(?U)[^\s\x1c-\x1f]"), x["kept"])
        order = F.struct(F.lit("comment_directive").alias("type"), p["idx"].cast("string").alias("location"), F.concat(F.lit("unsafe instruction ("), klass, F.lit(")")).alias("reason"))
        sheet = F.struct(F.lit("hidden_sheet").alias("type"), p["sheet"].alias("location"), F.lit("hidden sheet").alias("reason"))
        return F.struct(out.alias("out"), F.when(klass.isNotNull(), order).when(x["in_sheet"], sheet).alias("why"))

    docs = settled(docs, "_each", F.transform(F.transform("paragraphs", kept), each))
    done = F.struct(
        F.array_join(F.filter(F.transform("_each", lambda x: x["out"]), lambda x: x.isNotNull()), "\n").alias("text"),
        F.filter(F.transform("_each", lambda x: x["why"]), lambda x: x.isNotNull()).alias("removed"),
        F.lit(mode).alias("mode"),
    )
    return settled(docs, "sanitized", done).drop("_orders", "_sheets", "_runs", "_each")

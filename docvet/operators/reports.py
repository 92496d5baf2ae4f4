"""Reports: a verdict as one JSON object, a finding as one line, a place as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import docvet
from docvet.functions import fixed
from docvet.operators import scoring

NULLS = {"ignoreNullFields": "false"}


def place(e: Column, source: Column) -> Column:
    """Where a finding is: the source and its known fields."""
    named = [("para ", "paragraph"), ("run ", "run"), ("sheet ", "sheet"), ("row ", "row"), ("col ", "col"), ("page ", "page"), ("", "element")]
    bits = [F.concat(F.lit(word), e[c].cast("string")) for word, c in named]
    bits.append(F.concat(F.lit("chars "), e["start"].cast("string"), F.lit("-"), e["end"].cast("string")))
    joined = F.concat_ws(", ", *bits)
    return F.when(joined != "", F.concat(source, F.lit(": "), joined)).otherwise(source)


def short_place(e: Column) -> Column:
    """The one field of a place that says most: paragraph, sheet and row, page, element."""
    return F.coalesce(
        F.concat(F.lit("paragraph "), e["paragraph"].cast("string")), F.concat(e["sheet"], F.coalesce(F.concat(F.lit(":"), e["row"].cast("string")), F.lit(""))),
        F.concat(F.lit("page "), e["page"].cast("string")), e["element"], F.lit(""),
    )


def note(source: Column) -> Column:
    """What is said of a document in a message: its error, or its first finding in order."""
    e = F.get("evidence", F.lit(0))
    name = F.create_map(*[F.lit(x) for k, v in fixed.DETECTORS.items() for x in (k, v[0])])
    first = F.concat(e["detector_id"], F.lit("/"), name[e["detector_id"]], F.lit(" "), e["severity"], F.lit(" @ "), place(e, source))
    return F.when(F.col("error").isNotNull(), F.concat(F.lit("scan error: "), F.coalesce("error.message", F.lit("scan failed")))).when(F.size("evidence") == 0, "no evidence").otherwise(first)


def summary(found: Column) -> Column:
    return F.struct(*[scoring.count_of(found, s).alias(s) for s in fixed.SEVERITIES], F.size(found).alias("total"))


def report(verdicts: DataFrame) -> Column:
    """The verdict's whole report as a nested value; absent values stay as nulls."""
    found = F.transform(
        "evidence",
        lambda e: F.struct(
            e["detector_id"].alias("detector_id"), e["severity"].alias("severity"), e["title"].alias("title"),
            F.struct(*[e[c].alias(c) for c in ("paragraph", "run", "sheet", "row", "col", "page")], F.when(e["start"].isNotNull(), F.array(e["start"], e["end"])).alias("char_range"), e["element"].alias("element")).alias("location"),
            e["raw"].alias("raw"),
        ),
    )
    has = verdicts.columns
    label = F.struct(
        F.col("label").alias("value"), F.round("score", 3).cast("double").alias("score"), F.struct(*[F.round(c, 3).cast("double").alias(c) for c in ("structure", "content", "meta")]).alias("dimensions"), F.col("reasons").alias("reasons")
    )
    return F.struct(
        F.struct(F.lit("docvet").alias("name"), F.lit(docvet.__version__).alias("version")).alias("tool"),
        F.struct(F.col("source").alias("file"), F.col("kind").alias("kind"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.col("error").alias("error")).alias("scan"),
        summary(F.col("evidence")).alias("summary"),
        scoring.risk(F.col("evidence")).alias("risk_score"),
        (label if "label" in has else F.lit(None).cast("string")).alias("trust_label"),
        (F.col("decision") if "decision" in has else F.lit(None).cast("string")).alias("decision"),
        found.alias("evidence"),
    )


def to_json(verdicts: DataFrame, pretty: bool = False) -> DataFrame:
    return verdicts.withColumn("report", F.to_json(report(verdicts), NULLS | {"pretty": str(pretty).lower()}))


#: Reporters by name: from rows with path, source, evidence, error to rows with one column of lines. register() adds to them.
REPORTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REPORTERS[name] = f
        return f

    return add


def reporter(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in REPORTERS:
        raise ValueError(f"no reporter {name}; there are {', '.join(sorted(REPORTERS))}")
    return REPORTERS[name]


@register("jsonl")
def json_lines(verdicts: DataFrame) -> DataFrame:
    """A JSON object for each file, in the order of paths."""
    return to_json(verdicts).orderBy("path").select("report")


@register("json")
def json_pretty(verdicts: DataFrame) -> DataFrame:
    return to_json(verdicts, pretty=True).orderBy("path").select("report")


@register("table")
def table(verdicts: DataFrame) -> DataFrame:
    """A line for each finding: detector, severity, title, place; files without one say so."""
    e = F.col("e")
    line = F.concat_ws("  ", F.rpad(e["detector_id"], 8, " "), F.rpad(e["severity"], 8, " "), e["title"], short_place(e))
    empty = F.when(F.col("error").isNotNull(), F.concat(F.lit("scan error: "), F.coalesce("error.message", F.lit("")))).otherwise("no evidence")
    rows = verdicts.select("path", "error", F.posexplode_outer("evidence").alias("k", "e"))
    return rows.orderBy("path", "k").select(F.concat(F.col("path"), F.lit("  "), F.when(e.isNull(), empty).otherwise(line)).alias("line"))


def filtered(verdicts: DataFrame, severity: str) -> DataFrame:
    """Only findings of at least a severity; labels and decisions made of all findings go."""
    return verdicts.withColumn("evidence", scoring.at_least(F.col("evidence"), severity)).drop("label", "score", "structure", "content", "meta", "reasons", "risk", "decision")


def findings(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each finding, with its number in the document's order."""
    return verdicts.select(*keys, F.posexplode("evidence").alias("ordinal", "e")).select(*keys, "ordinal", "e.*")

"""The document model: one row per document, whatever its format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "struct<text: string, font_size: double, color: string, is_hidden: boolean, alpha: double>"
PARAGRAPH = f"struct<idx: int, text: string, sheet: string, row: int, col: int, slide: int, element: string, runs: array<{RUN}>>"
COLUMNS = {
    "source": "string",
    "kind": "string",
    "family": "string",
    "paragraphs": f"array<{PARAGRAPH}>",
    "sheets": "array<struct<name: string, state: string, rows_hidden: array<int>, cols_hidden: array<int>>>",
    "annotations": "array<struct<page: int, subtype: string, contents: string>>",
    "metadata": "map<string, string>",
    "comments": "array<string>",
    "scripts": "int",
    "nodes": "array<struct<part: string, tag: string, n: int, text: string>>",
    "parts": "array<string>",
    "error": "struct<kind: string, message: string>",
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
EVIDENCE = (
    "struct<detector_id: string, severity: string, title: string, paragraph: int, run: int, sheet: string, row: int, col: int, page: int, start: int, end: int, element: string, raw: map<string, string>>"
)


def complete(df: DataFrame, keys: list[str]) -> DataFrame:
    """df's keys and the model's columns; those that df lacks are null, lists empty."""
    out = []
    for c, t in COLUMNS.items():
        none = F.lit(0) if c == "scripts" else F.expr("array()") if t.startswith("array") else F.expr("map()") if t.startswith("map") else F.lit(None)
        out.append((F.coalesce(F.col(c).cast(t), none.cast(t)) if c in df.columns else none.cast(t)).alias(c))
    return df.select(*keys, *out)


def text_paragraphs(lines: Column) -> Column:
    """A paragraph with one run for each line; idx is the line's number from 1."""
    return F.transform(lines, _one)


def _one(text: Column, i: Column) -> Column:
    n = F.lit(None)
    run = F.struct(text.alias("text"), n.cast("double").alias("font_size"), n.cast("string").alias("color"), F.lit(False).alias("is_hidden"), n.cast("double").alias("alpha"))
    return F.struct(
        (i + 1).cast("int").alias("idx"), text.alias("text"), n.cast("string").alias("sheet"), n.cast("int").alias("row"), n.cast("int").alias("col"), n.cast("int").alias("slide"),
        n.cast("string").alias("element"), F.array(run).alias("runs"),
    )


def all_text() -> Column:
    """The non-empty paragraphs' texts, one to a line."""
    return F.array_join(F.transform(F.filter("paragraphs", lambda p: p["text"] != ""), lambda p: p["text"]), "\n")


def least_alpha(p: Column) -> Column:
    """The least alpha of a page's runs, of a struct of a paragraph; null where none is known."""
    return F.array_min(F.transform(p["runs"], lambda r: r["alpha"]))


def evidence(detector: str, severity: Column | str, title: Column, raw: dict[str, Column], **at: Column) -> Column:
    """One finding; at: the fields of its place that are known."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    kinds = {"sheet": "string", "element": "string"}
    places = [at.get(c, F.lit(None)).cast(kinds.get(c, "int")).alias(c) for c in ("paragraph", "run", "sheet", "row", "col", "page", "start", "end", "element")]
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in raw]), F.array(*[v.cast("string") for v in raw.values()])) if raw else F.expr("cast(map() as map<string, string>)")
    return F.struct(F.lit(detector).alias("detector_id"), severity.alias("severity"), title.alias("title"), *places, pairs.alias("raw")).cast(EVIDENCE)


def none() -> Column:
    return F.expr(f"cast(array() as array<{EVIDENCE}>)")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column name computed once: as a generated row, which the optimizer doesn't write out again into each
    expression that uses it."""
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))

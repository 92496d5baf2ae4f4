"""Detectors: each turns the document model into a column of findings within the document's row, so none shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions import fixed, text
from docvet.functions.ir import EVIDENCE, evidence, none, settled


def _flat(items: Column) -> Column:
    return F.flatten(items)


def zero_width(names: dict[int, str] = fixed.INVISIBLE) -> Column:
    """One high finding for each invisible code point of a paragraph."""
    table = F.create_map(*[F.lit(x) for c, n in names.items() for x in (chr(c), n)])

    def each(p: Column) -> Column:
        chars = F.filter(F.transform(F.split(p["text"], ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: F.map_contains_key(table, x["c"]))
        found = F.transform(
            chars,
            lambda x: evidence(
                "DET-001", "high", F.lit("Zero-width character found in visible text"),
                {"char": x["c"], "codepoint": F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(x["c"])), 4, "0")), "name": table[x["c"]], "context": text.snippet(p["text"], x["i"], x["i"] + 1)},
                paragraph=p["idx"], start=x["i"], end=x["i"] + 1,
            ),
        )
        return F.when(p["text"].rlike(text.INVISIBLE_CLASS), found).otherwise(none())

    return _flat(F.transform("paragraphs", each))


def _runs(test: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    def each(p: Column) -> Column:
        placed = F.filter(F.transform(p["runs"], lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda x: F.coalesce(test(x["r"]), F.lit(False)))
        return F.transform(placed, lambda x: make(p, x["r"], x["i"]))

    return _flat(F.transform("paragraphs", each))


def hidden_reasons(r: Column) -> Column:
    """Why a run can't be seen, as a list."""
    colour = F.upper(r["color"])
    return F.filter(
        F.array(
            F.when(r["is_hidden"], F.lit("flagged hidden (w:vanish / display:none / hidden cell)")),
            F.when(colour.isin(*fixed.NEAR_WHITE), F.concat(F.lit("near-white text color #"), colour)),
            F.when(r["alpha"] < fixed.LEAST_ALPHA, F.concat(F.lit("transparent text (alpha="), r["alpha"].cast("string"), F.lit(")"))),
        ),
        lambda x: x.isNotNull(),
    )


def hidden_style() -> Column:
    """One high finding for each run that is flagged hidden, near-white or transparent."""
    return _runs(
        lambda r: F.size(hidden_reasons(r)) > 0,
        lambda p, r, i: evidence("DET-002", "high", F.lit("Hidden text via styling"), {"text": r["text"], "reasons": F.array_join(hidden_reasons(r), "; ")}, paragraph=p["idx"], run=i),
    )


def tiny_font(points: float = fixed.TINY_POINTS) -> Column:
    """One medium finding for each run of at most points."""
    return _runs(
        lambda r: (r["font_size"] > 0) & (r["font_size"] <= points),
        lambda p, r, i: evidence("DET-003", "medium", F.lit("Tiny font text"), {"text": r["text"], "font_size": r["font_size"]}, paragraph=p["idx"], run=i),
    )


def hidden_sheet() -> Column:
    """Medium findings: each hidden sheet, and each sheet's hidden rows and hidden columns that hold text."""

    def each(s: Column) -> Column:
        cells = F.filter(F.col("paragraphs"), lambda p: (p["sheet"] == s["name"]) & (p["text"] != ""))
        rows = F.array_sort(F.array_intersect(s["rows_hidden"], F.transform(cells, lambda p: p["row"])))
        cols = F.array_sort(F.array_intersect(s["cols_hidden"], F.transform(cells, lambda p: p["col"])))
        size = F.length(F.array_join(F.transform(cells, lambda p: p["text"]), " "))
        listed = lambda x: F.array_join(F.slice(x, 1, fixed.MOST_ROWS).cast("array<string>"), ",")
        sheet = evidence("DET-004", "medium", F.concat(F.lit("Hidden sheet: "), s["name"]), {"state": s["state"], "text_length": size}, sheet=s["name"], element=F.concat(F.lit("sheet:"), s["name"]))
        row = evidence("DET-004", "medium", F.concat(F.lit("Hidden rows with data in '"), s["name"], F.lit("'")), {"rows": listed(rows)}, sheet=s["name"], row=F.get(rows, F.lit(0)))
        col = evidence("DET-004", "medium", F.concat(F.lit("Hidden columns with data in '"), s["name"], F.lit("'")), {"cols": listed(cols)}, sheet=s["name"], col=F.get(cols, F.lit(0)))
        all_ = F.array(F.when(s["state"].isin("hidden", "veryHidden"), sheet), F.when(F.size(rows) > 0, row), F.when(F.size(cols) > 0, col))
        return F.filter(all_, lambda x: x.isNotNull())

    return _flat(F.transform("sheets", each))


def ooxml_nodes() -> Column:
    """One medium finding for each kind of hiding element in a document part."""
    return F.transform(
        "nodes",
        lambda n: evidence(
            "DET-005", "medium", F.concat(F.lit("OOXML hidden node: "), n["tag"]), {"part": n["part"], "node": n["tag"], "text": F.substring(n["text"], 1, fixed.MOST_CHARS), "count": n["n"]},
            element=F.concat(n["part"], F.lit("#"), n["tag"]),
        ),
    )


def real_comments() -> Column:
    """The comments with text, stripped."""
    return F.filter(F.transform("comments", text.strip), lambda c: c != "")


def annotations() -> Column:
    """Low findings: one for the comments of a word document or web page, one for each annotation with text of a pdf."""
    real = real_comments()
    word = F.col("kind") == "docx"
    title = F.concat(F.size(real).cast("string"), F.when(word, " Word comment(s) present").otherwise(" HTML comment(s) with content"))
    first = F.to_json(F.slice(real, 1, fixed.MOST_COMMENTS))
    one = evidence("DET-006", "low", title, {"comments": first, "count": F.size(real)}, element=F.when(word, "word/comments.xml").otherwise("html"))
    pdf = F.transform(
        F.filter("annotations", lambda a: text.strip(a["contents"]) != ""),
        lambda a: evidence("DET-006", "low", F.lit("PDF annotation/comment with text"), {"subtype": a["subtype"], "contents": F.substring(a["contents"], 1, fixed.MOST_CHARS)}, page=a["page"]),
    )
    return F.when(F.col("kind") == "pdf", pdf).when(F.size(real) > 0, F.array(one)).otherwise(none())


def meta_hits() -> Column:
    """The metadata whose value holds a word that draws attention, shortened."""
    return F.transform_values(
        F.map_filter("metadata", lambda k, v: F.exists(F.array(*map(F.lit, fixed.META_WORDS)), lambda w: F.contains(F.lower(v), w))), lambda k, v: F.substring(v, 1, fixed.MOST_META_CHARS)
    )


def document_meta() -> Column:
    """Findings: suspicious metadata low, each macro project medium, scripts of a web page low."""
    hits = meta_hits()
    office = F.col("kind").isin("docx", "xlsx")
    meta = evidence("DET-007", "low", F.lit("Suspicious metadata content"), {"hits": F.to_json(hits)}, element=F.lit("metadata"))
    macros = F.transform(F.filter("parts", lambda p: F.contains(p, F.lit("vbaProject"))), lambda p: evidence("DET-007", "medium", F.lit("Embedded VBA project"), {"part": p}, element=p))
    script = evidence("DET-007", "low", F.lit("JavaScript present in HTML"), {"script_count": F.col("scripts")}, element=F.lit("html/script"))
    return F.concat(
        F.when(F.size(hits) > 0, F.array(meta)).otherwise(none()), F.when(office, macros).otherwise(none()), F.when((F.col("kind") == "html") & (F.col("scripts") > 0), F.array(script)).otherwise(none())
    )


def speaker_notes() -> Column:
    """One finding for each notes paragraph with an ordering (high) or steering (medium) phrase."""

    def each(p: Column) -> Column:
        strong = text.matches(p["text"], fixed.NOTES_STRONG)
        phrase = F.when(strong, text.found(p["text"], fixed.NOTES_STRONG)).otherwise(text.found(p["text"], fixed.NOTES_DIRECTIVE))
        start = F.when(strong, text.place(p["text"], fixed.NOTES_STRONG)).otherwise(text.place(p["text"], fixed.NOTES_DIRECTIVE))
        tier = F.when(strong, "strong").otherwise("directive")
        return evidence(
            "DET-009", F.when(strong, "high").otherwise("medium"), F.lit("Directive in speaker notes"), {"text": p["text"], "slide": p["slide"], "tier": tier, "phrase": phrase},
            paragraph=p["idx"], run=F.lit(0), start=start, end=start + F.length(phrase), element=F.concat(F.lit("notes:slide"), p["slide"].cast("string")),
        )

    notes = F.filter("paragraphs", lambda p: (p["element"] == "notes") & (text.matches(p["text"], fixed.NOTES_STRONG) | text.matches(p["text"], fixed.NOTES_DIRECTIVE)))
    return F.transform(notes, each)


def directives(df: DataFrame, line: str, family: str, out: str, keep_others: bool = True) -> DataFrame:
    """df and a column out: what the comment in column line asks for, as (klass, severity, frames, start, end, body), or
    null; without keep_others only the rows that have it, and most lines go before any pattern is tried.

    The comment must be in a directive frame (a marker, an address, an order, a claim of authority, an unsafe wish) and name
    an objective that the words just before don't forbid. The objective that begins first counts, then the longest.
    """
    s = F.col(line)
    comment = text.comment_body(s, F.col(family))
    df = settled(df, "_body", F.when(F.length(comment) >= fixed.LEAST_BODY, comment)) if keep_others else settled(df.filter(F.length(comment) >= fixed.LEAST_BODY), "_body", comment)
    body = F.col("_body")
    marker = F.coalesce(text.found(body, fixed.MARKER), F.lit(""))
    df = settled(df, "_marker", marker)
    df = settled(df, "_rest", F.substring(body, F.length("_marker") + 1, F.lit(1 << 30)))
    rest = F.col("_rest")
    found = []
    for k, (klass, pattern) in enumerate(fixed.OBJECTIVES.items()):
        start = text.place(rest, pattern)
        size = F.length(text.found(rest, pattern))
        found.append(F.when(text.matches(rest, pattern), F.struct(start.alias("start"), (-size).alias("less"), F.lit(k).alias("k"), F.lit(klass).alias("klass"))))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    df = settled(df, "_hits", hits)
    allowed = F.filter("_hits", lambda x: ~text.matches(F.substring(F.col("_rest"), F.greatest(x["start"] - fixed.LOOK_BEHIND, F.lit(0)) + 1, F.least(x["start"], F.lit(fixed.LOOK_BEHIND))), fixed.PROHIBITION))
    df = settled(df, "_hit", F.array_min(allowed))
    df = df if keep_others else df.filter("_hit is not null")
    frames = {
        "marker": F.col("_marker") != "", "addressed": text.matches(rest, fixed.ADDRESSED), "imperative": text.matches(rest, fixed.IMPERATIVE), "authority": text.matches(rest, fixed.AUTHORITY),
        "unsafe-negation": text.matches(rest, fixed.UNSAFE_NEGATION) | text.matches(rest, fixed.UNSAFE_RAW),
    }
    df = settled(df, "_frames", F.when(F.col("_hit").isNotNull(), F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in frames.items()]), lambda x: x.isNotNull())))
    weak = F.col("_hit.klass").isin(*fixed.WEAK_OBJECTIVES)
    real = F.exists("_frames", lambda f: f != "marker")
    severity = F.when(~weak, "critical").when(real, "high").otherwise("medium")
    start = F.instr(s, body) - 1 + F.length("_marker") + F.col("_hit.start")
    result = F.struct(F.col("_hit.klass").alias("klass"), severity.alias("severity"), F.array_join("_frames", ", ").alias("frames"), start.alias("start"), (start - F.col("_hit.less")).alias("end"), body.alias("body"))
    df = settled(df, out, F.when(F.size("_frames") > 0, result)) if keep_others else settled(df.filter(F.size("_frames") > 0), out, result)
    return df.drop("_body", "_marker", "_rest", "_hits", "_hit", "_frames")


def directive_finding(d: Column, line: Column) -> Column:
    """The finding of a directive comment."""
    title = F.concat(F.lit("Insecure instruction in a code comment ("), d["klass"], F.lit(")"))
    raw = {"class": d["klass"], "frames": d["frames"], "line": line, "comment": d["body"]}
    return evidence("DET-008", d["severity"], title, raw, paragraph=line, start=d["start"], end=d["end"], element=F.concat(F.lit("line:"), line.cast("string")))


def comment_directives(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The findings of directive comments by document: keys, _directives. Only lines that can be comments leave the row."""
    lines = docs.filter("kind = 'text'").select(*keys, "family", F.explode("paragraphs").alias("_p")).select(*keys, "family", F.col("_p.idx").alias("_line"), F.col("_p.text").alias("_text"))
    hits = directives(lines, "_text", "family", "_d", keep_others=False)
    return hits.groupBy(*keys).agg(F.collect_list(directive_finding(F.col("_d"), F.col("_line"))).alias("_directives"))


#: Detector id to its column of findings; DET-008 is comment_directives().
COLUMNS: dict[str, Callable[[], Column]] = {
    "DET-001": zero_width, "DET-002": hidden_style, "DET-003": tiny_font, "DET-004": hidden_sheet, "DET-005": ooxml_nodes, "DET-006": annotations, "DET-007": document_meta, "DET-009": speaker_notes,
}


def register(detector: str, name: str, kinds: tuple[str, ...], make: Callable[[], Column]) -> None:
    """Adds a detector: make gives a column of findings, made with ir.evidence(), of a row of the model. A taken id raises."""
    if detector in fixed.DETECTORS:
        raise ValueError(f"there is a detector {detector} already")
    fixed.DETECTORS[detector] = (name, " ".join(kinds))
    COLUMNS[detector] = make


def remove(detector: str) -> None:
    """Takes a detector that register() added out again."""
    del fixed.DETECTORS[detector], COLUMNS[detector]


def place_text(e: Column) -> Column:
    """A finding's place as text, by which findings of a detector are ordered: 10 stands before 2."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    chars = F.coalesce(F.concat(F.lit("["), e["start"].cast("string"), F.lit(", "), e["end"].cast("string"), F.lit("]")), F.lit("None"))
    fields = [("paragraph", show(e["paragraph"])), ("run", show(e["run"])), ("sheet", quoted(e["sheet"])), ("row", show(e["row"])), ("col", show(e["col"])), ("page", show(e["page"])), ("char_range", chars), ("element", quoted(e["element"]))]
    return F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': "), v) for k, v in fields])


def ordered(found: Column) -> Column:
    """Findings by detector, then by the text of their place, else as they were."""
    keyed = F.transform(found, lambda e, i: F.struct(e["detector_id"].alias("d"), place_text(e).alias("p"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: F.get(found, x["i"]))


def detect(docs: DataFrame, keys: list[str], skip: tuple[str, ...] = (), kinds: tuple[str, ...] = (*fixed.DOCUMENT_KINDS, "text")) -> DataFrame:
    """docs (the model, completed) and a column evidence: all findings in order. Detectors that are skipped, and those of
    other kinds than docs can have, aren't in the plan."""
    columns = []
    for detector, make in COLUMNS.items():
        own = [k for k in fixed.DETECTORS[detector][1].split() if k in kinds]
        if detector not in skip and own:
            columns.append(F.when(F.col("kind").isin(*own), make()).otherwise(none()))
    found = F.concat(*columns) if columns else none()
    if "DET-008" not in skip and "text" in kinds:
        # An equi-join on the keys of the documents that have such a comment; all other documents stay where they are.
        docs = docs.join(comment_directives(docs, keys), keys, "left")
        found = F.concat(found, F.coalesce("_directives", none()))
    docs = settled(docs, "_found", found)
    out = F.when(F.size("_found") < 2, F.col("_found")).otherwise(ordered(F.col("_found")))
    return settled(docs, "evidence", out.cast(f"array<{EVIDENCE}>")).drop("_directives", "_found")

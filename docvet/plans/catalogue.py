"""Queries over whole tables that use the operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed, ir, text
from docvet.operators import detectors, gate, logs, policy, reports, sanitize, scoring
from docvet.plans import overlay
from docvet.plans.engine import vet
from docvet.sources import formats, readers
from docvet.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _re2(pattern: str) -> str:
    """The pattern as SQL text without look-behind, which that engine lacks; planted lines don't tell the difference."""
    return pattern.replace(r"(?<!\w)", "").replace("'", "''")


# ---- documents -----------------------------------------------------------------------------------------------------------


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.from_texts(overlay.documents(spark, sf_dir), "doc_id", "text")


def text_verdicts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return vet(text_documents(spark, sf_dir), ["doc_id"], **{"clean": False, "kinds": ("text",)} | how)


LINES_SQL = (
    f"with {overlay.DOCUMENTS_SQL}, split as (select doc_id, string_split_regex(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from docs), "
    "cut as (select doc_id, case when l[-1] = '' then l[:-2] else l end as l from split), "
    "numbered as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1))::int as line_no from cut), "
)
BODY_SQL = LINES_SQL + (
    r"stripped as (select doc_id, line_no, line, regexp_replace(line, '^[\s\x1c-\x1f\pZ]+|[\s\x1c-\x1f\pZ]+$', '', 'g') as s from numbered), "
    r"bodies as (select doc_id, line_no, line, regexp_replace(substr(s, 2), '^[\s\x1c-\x1f\pZ]+|[\s\x1c-\x1f\pZ]+$', '', 'g') as body from stripped where starts_with(s, '#')), "
)
_HITS = ", ".join(
    f"case when regexp_matches(rest, '{_re2(p)}', 'i') then {{'start': length(regexp_extract(rest, '(?is)^(.*?)(?:{_re2(p)})', 1)), 'less': -length(regexp_extract(rest, '(?i)(?:{_re2(p)})', 0)), 'k': {k}, 'klass': '{c}'}} end"
    for k, (c, p) in enumerate(fixed.OBJECTIVES.items())
)
_SEEN = {n: f"regexp_matches(rest, '{_re2(p)}', 'i')" for n, p in (("addressed", fixed.ADDRESSED), ("imperative", fixed.IMPERATIVE), ("authority", fixed.AUTHORITY))}
_SEEN["unsafe-negation"] = f"(regexp_matches(rest, '{_re2(fixed.UNSAFE_NEGATION)}', 'i') or regexp_matches(rest, '{_re2(fixed.UNSAFE_RAW)}', 'i'))"
_REAL = "(" + " or ".join(_SEEN.values()) + ")"
DIRECTIVE_SQL = BODY_SQL + (
    f"marked as (select *, regexp_extract(body, '(?i){_re2(fixed.MARKER)}', 0) as marker from bodies where length(body) >= {fixed.LEAST_BODY}), "
    "rests as (select *, substr(body, length(marker) + 1) as rest from marked), "
    f"hits as (select *, list_filter([{_HITS}], lambda h: h is not null and not regexp_matches(substr(rest, greatest(h.start - 40, 0) + 1, least(h.start, 40)), '{_re2(fixed.PROHIBITION)}', 'i')) as h from rests), "
    f"best as (select *, list_sort(h)[1] as b, {_REAL} as real from hits where len(h) > 0), "
    f"directives as (select doc_id, line_no, b.klass as klass, case when b.klass not in {fixed.WEAK_OBJECTIVES} then 'critical' when real then 'high' else 'medium' end as severity, "
    "cast(instr(line, body) - 1 + length(marker) + b.start as int) as start, cast(instr(line, body) - 1 + length(marker) + b.start - b.less as int) as \"end\" from best where marker <> '' or real) "
)


def _directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_documents(spark, sf_dir).select("doc_id", "family", F.explode("paragraphs").alias("p")).select("doc_id", "family", F.col("p.idx").alias("line_no"), F.col("p.text").alias("line"))
    return detectors.directives(lines, "line", "family", "d", keep_others=False).select("doc_id", "line_no", "line", "d.*")


@query(LINES_SQL + "lengths as (select doc_id, line_no, length(line)::int as size from numbered) select * from lengths")
def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlay.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("i", "l")).select("doc_id", (F.col("i") + 1).alias("line_no"), F.length("l").alias("size"))


@query(BODY_SQL + "final as (select doc_id, line_no, 'hash' as family, body from bodies) select * from final")
def q_comment_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_documents(spark, sf_dir).select("doc_id", "family", F.explode("paragraphs").alias("p"))
    out = lines.select("doc_id", F.col("p.idx").alias("line_no"), "family", text.comment_body(F.col("p.text"), F.col("family")).alias("body"))
    return out.filter("body is not null")


@query(DIRECTIVE_SQL + 'select doc_id, line_no, klass, severity, start, "end" from directives')
def q_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directives(spark, sf_dir).select("doc_id", "line_no", "klass", "severity", "start", "end")


@query(DIRECTIVE_SQL + "select coalesce(klass, '(all)') as klass, coalesce(severity, '(all)') as severity, count(*) as n from directives group by rollup (klass, severity)")
def q_directive_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _directives(spark, sf_dir).rollup("klass", "severity").agg(F.count("*").alias("n"))
    return n.select(F.coalesce("klass", F.lit("(all)")).alias("klass"), F.coalesce("severity", F.lit("(all)")).alias("severity"), "n")


_INVISIBLE_SQL = "[" + "".join(f"\\x{{{c:x}}}" for c in fixed.INVISIBLE) + "]"
_BIDI_SQL = "[" + "".join(f"\\x{{{c:x}}}" for c in fixed.BIDI) + "]"


@query(
    f"with {overlay.DOCUMENTS_SQL}, seen as (select doc_id, text, string_split(text, '') as c from docs where regexp_matches(text, '{_INVISIBLE_SQL}')), "
    "chars as (select doc_id, text, unnest(c) as c, unnest(range(len(c)))::int as pos from seen) "
    "select doc_id, pos, 'U+' || upper(printf('%04x', unicode(c))) as codepoint, "
    "case when pos > 40 then '…' else '' end || substr(text, greatest(pos - 40, 0) + 1, least(pos + 41, length(text)) - greatest(pos - 40, 0)) || case when pos + 41 < length(text) then '…' else '' end as context "
    f"from chars where regexp_matches(c, '{_INVISIBLE_SQL}')"
)
def q_zero_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.lit(0).alias("idx"), F.col("text").alias("text"), *[F.lit(None).alias(c) for c in ("sheet", "row", "col", "slide", "element")], F.array().alias("runs"))
    docs = ir.complete(overlay.documents(spark, sf_dir).select("doc_id", F.lit("docx").alias("kind"), F.array(one).alias("paragraphs")), ["doc_id"])
    return docs.select("doc_id", F.explode(detectors.zero_width()).alias("e")).select("doc_id", F.col("e.start").alias("pos"), F.col("e.raw")["codepoint"].alias("codepoint"), F.col("e.raw")["context"].alias("context"))


_COUNTS = ", ".join(f"count(*) filter (severity = '{s}')::int as {s}" for s in fixed.SEVERITIES)
COUNTED_SQL = DIRECTIVE_SQL + (
    f", counts as (select docs.doc_id, docs.text, {_COUNTS}, count(severity)::int as total from docs left join directives using (doc_id) group by docs.doc_id, docs.text), "
    f"hinted as (select *, list_filter({list(fixed.HINTS)}, lambda h: contains(lower(text), h)) as hints from counts), "
    "scored as (select *, least(critical * 40 + high * 20 + medium * 8 + low * 2, 100) / 100.0 as risk, "
    "greatest(1 - (critical * 1.0 + high * 0.8 + medium * 0.5 + low * 0.25 + case when len(hints) > 0 then 0.15 else 0 end), 0) as content from hinted), "
    "total_ as (select *, least(0.5 + 0.3 * content + 0.2, case when critical + high > 0 then 0.39 else 1 end) as score from scored), "
    "labelled as (select *, case when score >= 0.7 then 'safe' when score >= 0.4 then 'caution' else 'dangerous' end as label from total_) "
)


@query(COUNTED_SQL + "select doc_id, info, low, medium, high, critical, total from counts")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect(text_documents(spark, sf_dir), ["doc_id"], kinds=("text",)).select("doc_id", reports.summary(F.col("evidence")).alias("s")).select("doc_id", "s.*")


@query(COUNTED_SQL + "select doc_id, cast(risk as double) as risk from scored")
def q_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect(text_documents(spark, sf_dir), ["doc_id"], kinds=("text",)).select("doc_id", scoring.risk(F.col("evidence")).cast("double").alias("risk"))


@query(
    COUNTED_SQL + "select doc_id, cast(content as double) as content, cast(round(score, 4) as double) as score, label, "
    "coalesce((select string_agg('code-comment directive (' || klass || ', ' || severity || ')', ' / ') from directives d where d.doc_id = l.doc_id), '') "
    "|| case when total > 0 and len(hints) > 0 then ' / ' else '' end || case when len(hints) > 0 then 'instruction-like phrasing in document (''' || hints[1] || ''')' else '' end as reasons from labelled l"
)
def q_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_verdicts(spark, sf_dir).select("doc_id", F.col("content").cast("double").alias("content"), F.col("score").cast("double").alias("score"), "label", F.array_join("reasons", " / ").alias("reasons"))


@query(
    COUNTED_SQL + "select doc_id, case when label = 'dangerous' then 'block' when total > 0 then 'quarantine' when label = 'caution' then 'human_approval' else 'allow' end as action, "
    "case when label = 'dangerous' then 'POL-001' when total > 0 then 'POL-002' when label = 'caution' then 'POL-003' else 'fallback-allow' end as rule_id from labelled"
)
def q_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_verdicts(spark, sf_dir).select("doc_id", "decision.action", "decision.rule_id")


@query(COUNTED_SQL + "select doc_id, case when risk >= 0.4 then 'block' when high + medium > 0 then 'human_approval' else 'allow' end as action from labelled")
def q_policy_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = policy.Policy([policy.Rule("R-1", "block", "risky", policy.risk_at_least(0.4))], "own")
    rules.add(policy.Rule("R-2", "human_approval", "comment", policy.detector_hit("DET-008", severity="medium")))
    return text_verdicts(spark, sf_dir, rules=rules).select("doc_id", "decision.action")


@query(COUNTED_SQL + "select doc_id, high + critical as n, case when high + critical > 0 then 1 else 0 end as code from counts")
def q_min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.detect(text_documents(spark, sf_dir), ["doc_id"], kinds=("text",))
    return found.select("doc_id", F.size(scoring.at_least(F.col("evidence"), "high")).alias("n"), scoring.exit_code("high").alias("code"))


@query(f"with {overlay.DOCUMENTS_SQL} select doc_id, 0 as n, 0 as code from docs")
def q_skip_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.detect(text_documents(spark, sf_dir), ["doc_id"], skip=("DET-008",), kinds=("text",))
    return found.select("doc_id", F.size("evidence").alias("n"), scoring.exit_code().alias("code"))


def _sanitized_sql(mode: str) -> str:
    marker = f"'{fixed.REDACTED_LINE}'" if mode == "redact" else f"'{fixed.REMOVED} (class=' || klass || ')'"
    return DIRECTIVE_SQL + (
        f", shown as (select n.doc_id, n.line_no, case when klass is not null then regexp_extract(line, '^(\\s*)', 1) || '# ' || {marker} "
        f"else regexp_replace(regexp_replace(line, '{_INVISIBLE_SQL}', '', 'g'), '{_BIDI_SQL}', '', 'g') end as line, klass is not null as gone from numbered n left join directives d on d.doc_id = n.doc_id and d.line_no = n.line_no) "
        r"select docs.doc_id, sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (gone or regexp_replace(line, '[\s\x1c-\x1f\pZ]+', '', 'g') <> ''), '')) as sha, count(*) filter (gone)::int as removed_count "
        "from docs left join shown using (doc_id) group by docs.doc_id"
    )


def _sanitized(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    found = detectors.detect(text_documents(spark, sf_dir), ["doc_id"], kinds=("text",))
    return sanitize.sanitize(found, mode).select("doc_id", F.sha2("sanitized.text", 256).alias("sha"), F.size("sanitized.removed").alias("removed_count"))


@query(_sanitized_sql("strip"))
def q_sanitize_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sanitized(spark, sf_dir, "strip")


@query(_sanitized_sql("redact"))
def q_sanitize_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sanitized(spark, sf_dir, "redact")


@query(
    DIRECTIVE_SQL + "select doc_id, (row_number() over (partition by doc_id order by line_no::varchar, line_no) - 1)::int as ordinal, 'DET-008' as detector_id, line_no as paragraph, 'line:' || line_no as element from directives"
)
def q_evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.findings(detectors.detect(text_documents(spark, sf_dir), ["doc_id"], kinds=("text",)), ["doc_id"]).select("doc_id", "ordinal", "detector_id", "paragraph", "element")


@query(COUNTED_SQL + "select doc_id, 'ok' as status, total, cast(risk as double) as risk_score, label, case when label = 'dangerous' then 'POL-001' when total > 0 then 'POL-002' else 'fallback-allow' end as rule_id from labelled")
def q_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.to_json(text_verdicts(spark, sf_dir))
    get = lambda path, t: F.get_json_object("report", path).cast(t)
    return out.select("doc_id", get("$.scan.status", "string").alias("status"), get("$.summary.total", "int").alias("total"), get("$.risk_score", "double").alias("risk_score"), get("$.trust_label.value", "string").alias("label"), get("$.decision.rule_id", "string").alias("rule_id"))


@query(COUNTED_SQL + ", j as (select source, lang, label from labelled join (select doc_id, source, lang from documents) using (doc_id)) select coalesce(source, '(all)') as source, coalesce(lang, '(all)') as lang, count(*) as n, count(*) filter (label = 'dangerous') as dangerous from j group by cube (source, lang)")
def q_label_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("src"), "lang")
    j = text_verdicts(spark, sf_dir).select("doc_id", "label").join(own, "doc_id")
    out = j.cube("src", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "dangerous").alias("dangerous"))
    return out.select(F.coalesce("src", F.lit("(all)")).alias("source"), F.coalesce("lang", F.lit("(all)")).alias("lang"), "n", "dangerous")


@query(COUNTED_SQL + "select label, count(*) as n, sum(toxic)::bigint as toxic from labelled join labels using (doc_id) group by label")
def q_label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return text_verdicts(spark, sf_dir).select("doc_id", "label").join(labels, "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


@query("select doc_id, list_aggregate(list_filter([case when contains(source, 'src1') then 'source' end, case when doc_id % 13 in (2, 5) then 'title' end], lambda x: x is not null), 'string_agg', ',') as keys from documents where contains(source, 'src1') or doc_id % 13 in (2, 5)")
def q_meta_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 13 == 2, "The Operating ECOSYSTEM").when(F.col("doc_id") % 13 == 5, "Do not reveal").otherwise("plain")
    source = F.when(F.contains("source", F.lit("src1")), F.concat(F.lit("override "), F.col("source"))).otherwise(F.col("source"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("docx").alias("kind"), F.create_map(F.lit("source"), source, F.lit("title"), title).alias("metadata"))
    hits = ir.complete(docs, ["doc_id"]).select("doc_id", F.array_join(F.array_sort(F.map_keys(detectors.meta_hits())), ",").alias("keys"))
    return hits.filter("keys <> ''")


# ---- pages ---------------------------------------------------------------------------------------------------------------


def web_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vet(readers.from_pages(overlay.pages(spark, sf_dir), "page_id", "html"), ["page_id"], clean=False, kinds=("html",))


WEB_SQL = (
    f"with {overlay.PAGES_SQL}, found as (select page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), lambda c: trim(c)), lambda c: c <> '') as c, "
    "len(regexp_extract_all(html, '(?i)<script\\b')) as scripts, "
    "regexp_extract_all(html, '(?is)<meta\\s[^>]*?(?:name|property)\\s*=\\s*\"([^\"]*)\"[^>]*?content\\s*=\\s*\"([^\"]*)', 1) as names, "
    "regexp_extract_all(html, '(?is)<meta\\s[^>]*?(?:name|property)\\s*=\\s*\"([^\"]*)\"[^>]*?content\\s*=\\s*\"([^\"]*)', 2) as contents from web), "
    f"hits as (select *, list_filter(list_zip(names, contents), lambda x: len(list_filter({list(fixed.META_WORDS)}, lambda w: contains(lower(x[2]), w))) > 0) as words from found), "
    "scored as (select page_id, (len(c) > 0)::int as a, (len(words) > 0)::int as w, (scripts > 0)::int as s from hits), "
    "total_ as (select *, a + w + s as low, 1 - 0.25 * a as structure, 1 - 0.4 * w as content, 1 - 0.3 * s as meta from scored), "
    "capped as (select *, least(0.5 * structure + 0.3 * content + 0.2 * meta, case when a > 0 then 0.6 else 1 end) as score from total_) "
)


@query(WEB_SQL + "select page_id, len(c)::int as n_comments, c[1] as first_comment from hits where len(c) > 0")
def q_html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.from_pages(overlay.pages(spark, sf_dir), "page_id", "html").withColumn("real", detectors.real_comments())
    return docs.filter(F.size("real") > 0).select("page_id", F.size("real").alias("n_comments"), F.get("real", F.lit(0)).alias("first_comment"))


@query(WEB_SQL + "select page_id, scripts::int as n_scripts from hits")
def q_html_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.from_pages(overlay.pages(spark, sf_dir), "page_id", "html").select("page_id", F.col("scripts").alias("n_scripts"))


@query(WEB_SQL + ", each as (select page_id, unnest(words) as x from hits) select page_id, lower(x[1]) as name, x[2] as hit from each")
def q_html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.from_pages(overlay.pages(spark, sf_dir), "page_id", "html").select("page_id", F.explode(detectors.meta_hits()).alias("name", "hit"))


@query(
    WEB_SQL + "select page_id, low::int as findings, cast(low * 2 / 100.0 as double) as risk, cast(structure as double) as structure, cast(content as double) as content, cast(meta as double) as meta, cast(round(score, 4) as double) as score, "
    "case when score >= 0.7 then 'safe' when score >= 0.4 then 'caution' else 'dangerous' end as label, case when score < 0.4 then 'block' when low > 0 then 'quarantine' else 'allow' end as action, "
    "case when score < 0.4 then 'POL-001' when low > 0 then 'POL-002' else 'fallback-allow' end as rule_id from capped"
)
def q_page_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = [F.col(c).cast("double").alias(c) for c in ("risk", "structure", "content", "meta", "score")]
    return web_verdicts(spark, sf_dir).select("page_id", F.size("evidence").alias("findings"), *numbers, "label", "decision.action", "decision.rule_id")


@query(WEB_SQL + "select case when a > 0 then 'DET-006' || case when w + s > 0 then '/DET-007' else '' end else case when w + s > 0 then 'DET-007' else '' end end as ids, count(*) as n from scored group by 1")
def q_detector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["detector_id"]))), "/")
    return web_verdicts(spark, sf_dir).groupBy(ids.alias("ids")).agg(F.count("*").alias("n"))


STYLES = ("color:#fff;font-size:1px", "Display : NONE", "visibility:hidden;color:red", "font-size: 12pt; color:#ABCDEF", "font-size:2em", "color: white; color:#000000", "margin:0", "")
_STYLE_SQL = "[" + ", ".join(f"'{s}'" for s in STYLES) + f"][page_id % {len(STYLES)} + 1]"


@query(
    f"with s as (select page_id, lower({_STYLE_SQL}) as st from pages), v as (select page_id, regexp_extract_all(st, '(?:^|;)\\s*color\\s*:\\s*([^;]+)', 1) as colors, "
    "regexp_extract_all(st, '(?:^|;)\\s*display\\s*:\\s*([^;]+)', 1)[-1] as d, regexp_extract_all(st, '(?:^|;)\\s*visibility\\s*:\\s*([^;]+)', 1)[-1] as vis, "
    "regexp_extract(st, 'font-size\\s*:\\s*([\\d.]+)\\s*(px|pt)', 1) as n, regexp_extract(st, 'font-size\\s*:\\s*([\\d.]+)\\s*(px|pt)', 2) as u from s), "
    "c as (select *, trim(colors[-1]) as c from v), h as (select *, case when c = 'white' then 'FFFFFF' when regexp_matches(c, '^#[0-9a-f]{6}$') then upper(c[2:]) "
    "when regexp_matches(c, '^#[0-9a-f]{3}$') then upper(c[2] || c[2] || c[3] || c[3] || c[4] || c[4]) end as colour from c) "
    "select page_id, colour, coalesce(trim(d) = 'none', false) or coalesce(trim(vis) = 'hidden', false) or coalesce(colour = 'FFFFFF', false) as hidden, "
    "case u when 'px' then round(n::double / 1.3333, 2) when 'pt' then n::double end as points from h"
)
def q_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.get(F.array(*map(F.lit, STYLES)), (F.col("page_id") % len(STYLES)).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.style_map(style).alias("s"))
    s = F.col("s")
    return pages.select("page_id", text.hex_colour(s["color"]).alias("colour"), text.style_hidden(s).alias("hidden"), text.style_points(s).alias("points"))


_PATHS = ("a/Main.PY", "b\\notes.md", "docs/AGENTS.md", "x/report.DOCX", "y/table.xlsm", ".cursorrules", "z/page.htm", "q/readme", "w/style.css", ".env")
_PATHS_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + f"][page_id % {len(_PATHS)} + 1]"
_KINDS_SQL = " ".join(f"when ext in ({', '.join(repr(e) for e in exts)}) then '{k}'" for k, exts in (*fixed.KIND_EXTENSIONS.items(), ("text", tuple(fixed.CODE_EXTENSIONS))))
_FAMILIES_SQL = " ".join(f"when ext in ({', '.join(repr(e) for e in exts)}) then '{k}'" for k, exts in fixed.FAMILY_EXTENSIONS.items())
_RULES_SQL = f"lower(name) in ({', '.join(repr(r) for r in fixed.RULE_FILES)})"


@query(
    f"with p as (select page_id, {_PATHS_SQL} as path from pages), n as (select *, regexp_extract(replace(path, chr(92), '/'), '([^/]*)$', 1) as name from p), e as (select *, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) as ext from n) "
    f"select page_id, path, case {_KINDS_SQL} when {_RULES_SQL} then 'text' end as kind, case when {_RULES_SQL} then 'hash' {_FAMILIES_SQL} end as family from e"
)
def q_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % len(_PATHS)).cast("int"))
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path.alias("path"))
    return df.select("page_id", "path", formats.kind_of_path(F.col("path")).alias("kind"), text.family(F.col("path")).alias("family"))


# ---- conversations, events, orders ------------------------------------------------------------------------------------------


@query(
    f"with {overlay.CONVERSATIONS_SQL} select conv_id, turn, len(regexp_extract_all(text, '{_INVISIBLE_SQL}'))::int as n_invisible, len(regexp_extract_all(text, '{_BIDI_SQL}'))::int as n_bidi from turns"
)
def q_post_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = overlay.conversations(spark, sf_dir).withColumn("response", F.to_json(F.struct(F.lit(1).alias("n"), F.struct("text").alias("in"))))
    return gate.post_tool(turns, "response").select("conv_id", "turn", "n_invisible", "n_bidi")


def _notes_sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    f"with {overlay.CONVERSATIONS_SQL}, m as (select *, regexp_matches(text, '{_notes_sql(fixed.NOTES_STRONG)}', 'i') as strong, regexp_matches(text, '{_notes_sql(fixed.NOTES_DIRECTIVE)}', 'i') as weak from turns) "
    f"select conv_id, turn, case when strong then 'high' else 'medium' end as severity, case when strong then regexp_extract(text, '(?i){_notes_sql(fixed.NOTES_STRONG)}', 0) else regexp_extract(text, '(?i){_notes_sql(fixed.NOTES_DIRECTIVE)}', 0) end as phrase "
    "from m where strong or weak"
)
def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("turn").cast("int").alias("idx"), F.col("text").alias("text"), *[F.lit(None).alias(c) for c in ("sheet", "row", "col")], F.lit(1).alias("slide"), F.lit("notes").alias("element"), F.array().alias("runs"))
    docs = ir.complete(overlay.conversations(spark, sf_dir).select("conv_id", "turn", F.lit("pptx").alias("kind"), F.array(one).alias("paragraphs")), ["conv_id", "turn"])
    return docs.select("conv_id", "turn", F.explode(detectors.speaker_notes()).alias("e")).select("conv_id", "turn", "e.severity", F.col("e.raw")["phrase"].alias("phrase"))


@query("select event_id, unnest([event_type, 'x\"y']) as leaf from events")
def q_json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    json = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.array("event_type").alias("deep")).alias("event_type"), F.lit('x"y').alias("q")))
    return events.select("event_id", F.explode(gate.string_leaves(json)).alias("leaf"))


@query(
    "with s as (select l_orderkey as sheet, l_linenumber as r, l_returnflag as flag from lineitem), g as (select sheet, list_sort(list(distinct r) filter (flag = 'R')) as rows_ from s group by sheet) "
    "select sheet, rows_[1]::int as first_row, array_to_string(rows_[:50], ',') as rows from g where len(rows_) > 0"
)
def q_hidden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets, their lines as cells; the rows of returned lines are hidden."""
    n = F.lit(None)
    cell = F.struct(
        F.col("l_linenumber").cast("int").alias("idx"), F.col("l_returnflag").alias("text"), F.lit("s").alias("sheet"), F.col("l_linenumber").cast("int").alias("row"), F.lit(1).alias("col"),
        n.cast("int").alias("slide"), n.cast("string").alias("element"), F.array().cast(f"array<{ir.RUN}>").alias("runs"),
    )
    hidden = F.filter(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("int"))), lambda x: x.isNotNull())
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("sheet")).agg(F.collect_list(cell).alias("paragraphs"), hidden.alias("hidden"))
    sheet = F.struct(F.lit("s").alias("name"), F.lit("visible").alias("state"), F.col("hidden").alias("rows_hidden"), F.array().cast("array<int>").alias("cols_hidden"))
    docs = ir.complete(orders.select("sheet", F.lit("xlsx").alias("kind"), "paragraphs", F.array(sheet).alias("sheets")), ["sheet"])
    return docs.select("sheet", F.explode(detectors.hidden_sheet()).alias("e")).select("sheet", F.col("e.row").alias("first_row"), F.col("e.raw")["rows"].alias("rows"))


@query(
    COUNTED_SQL + ", v as (select 'd/' || doc_id || '.py' as path, doc_id, label, total from labelled), p as (select doc_id, case doc_id % 5 when 0 then 'PostToolUse' else 'PreToolUse' end as event, "
    "case when doc_id % 11 = 0 then 'gone/' || doc_id || '.py' when doc_id % 7 = 0 then 'd/' || doc_id || '.xyz' else 'd\\' || doc_id || '.py' end as path from documents) "
    "select p.doc_id, case when event <> 'PreToolUse' then 'allow' when p.path like '%.xyz' then 'allow' when v.path is null then 'deny' when label = 'dangerous' then 'deny' else 'allow' end as outcome, "
    "case when event = 'PreToolUse' and v.path is not null and p.path not like '%.xyz' then case when label = 'dangerous' then 'POL-001' when total > 0 then 'POL-002' else 'fallback-allow' end end as rule, "
    "case when event = 'PreToolUse' and v.path is not null and p.path not like '%.xyz' and label <> 'dangerous' and total > 0 then 'quarantine/' || sha256(v.path)[:16] || '.txt' end as new_path "
    "from p left join v on replace(p.path, chr(92), '/') = v.path"
)
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = text_verdicts(spark, sf_dir).withColumns({"path": F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".py")), "length": F.lit(1).cast("long")}).drop("doc_id")
    name, k = F.col("doc_id").cast("string"), F.col("doc_id")
    path = F.when(k % 11 == 0, F.concat(F.lit("gone/"), name, F.lit(".py"))).when(k % 7 == 0, F.concat(F.lit("d/"), name, F.lit(".xyz"))).otherwise(F.concat(F.lit("d\\"), name, F.lit(".py")))
    calls = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(k % 5 == 0, "PostToolUse").otherwise("PreToolUse").alias("event"), F.lit("Read").alias("tool"), path.alias("path"))
    out = gate.pre_read(calls, verdicts).withColumn("rule", F.when(F.col("reason").startswith("clean"), "fallback-allow").otherwise(F.col("rule")))
    return out.select("doc_id", "outcome", "rule", "new_path")


@query("select doc_id, 'd' || doc_id as path from documents where doc_id % 3 = 0 or doc_id % 10 = 9")
def q_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    space = logs.namespace()
    old = docs.filter("doc_id % 10 <> 9").select(path, F.length("text").cast("long").alias("length"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.lit(space).alias("namespace"), F.lit("allow").alias("action"), F.lit("safe").alias("label"), F.lit("x").alias("rule_id"))
    now = docs.select("doc_id", path, F.length("text").cast("long").alias("length"), F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text")), "UTF-8").alias("content"))
    return logs.cache_split(now, old, space)[1].select("doc_id", "path")


@query("select event_id, user_id, event_type from (select * from events order by ts desc, event_id desc limit 50)")
def q_audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.struct("ts", "event_id"))
    return logs.tail(log, 50, "at").select("event_id", "user_id", "event_type")


@query(
    "with l as (select user_id::varchar as id, ts, event_id, event_type, case event_type when 'purchase' then 'approved' when 'signup' then 'rejected' else 'pending' end as status from events), "
    "r as (select *, row_number() over (partition by id order by (status = 'pending')::int, ts, event_id) as n from l) select id, status from r where n = 1"
)
def q_approvals_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "signup", "rejected").otherwise("pending")
    at = F.struct("ts", "event_id")
    return logs.current(events.select(F.col("user_id").cast("string").alias("id"), status.alias("status"), at.alias("created_at"), at.alias("decided_at"))).select("id", "status")


@query("select date_trunc('hour', ts) as hour, event_type as severity, count(*) as n from events group by all")
def q_findings_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: events stand for findings."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "severity")
    return streams.per_hour(events).select(F.col("window.start").alias("hour"), "severity", F.col("count").alias("n"))


@query("select 'DET-' || lpad(k::varchar, 3, '0') as id, n as name from (select unnest(range(1, 10)) as k, unnest(['" + "', '".join(n for n, _ in fixed.DETECTORS.values()) + "']) as n)")
def q_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docvet.plans.engine import Engine

    return Engine(spark).detectors().select("id", "name")


# ---- model documents made of orders: what a reader would give, with SQL that names the expected findings outright ----------


def order_documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Orders as documents, their lines as pages of one run: a line of status F is flagged hidden, flag R is near-white, A black,
    line 7 nearly transparent; a point for ten pieces."""
    line = F.col("l_linenumber").cast("int")
    none = lambda t: F.lit(None).cast(t)
    run = F.struct(
        F.col("l_returnflag").alias("text"), (F.col("l_quantity") / 10).cast("double").alias("font_size"), F.when(F.col("l_returnflag") == "R", "ffffff").when(F.col("l_returnflag") == "A", "000000").alias("color"),
        (F.col("l_linestatus") == "F").alias("is_hidden"), F.when(line == 7, 0.05).otherwise(1.0).alias("alpha"),
    )
    page = F.struct(line.alias("idx"), F.col("l_returnflag").alias("text"), F.lit("s").alias("sheet"), F.lit(1).alias("row"), line.alias("col"), none("int").alias("slide"), none("string").alias("element"), F.array(run).alias("runs"))
    note = F.struct(line.alias("page"), F.lit("/Text").alias("subtype"), F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("contents"))
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc")).agg(
        F.collect_list(page).alias("paragraphs"), F.collect_list(note).alias("annotations"),
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "N", " \t").otherwise(F.concat("l_returnflag", "l_linestatus")))).alias("comments"),
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("word/vbaProject"), F.col("l_linestatus"), F.lit(".bin"))).otherwise("word/document.xml")).alias("parts"),
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", line))).alias("hidden"),
    )
    sheet = F.struct(F.lit("s").alias("name"), F.when(F.col("doc") % 3 == 0, "hidden").when(F.col("doc") % 3 == 1, "veryHidden").otherwise("visible").alias("state"), F.array().cast("array<int>").alias("rows_hidden"), F.col("hidden").alias("cols_hidden"))
    return ir.complete(orders.select("doc", F.lit(kind).alias("kind"), F.col("doc").cast("string").alias("source"), "paragraphs", "annotations", "comments", "parts", F.array(sheet).alias("sheets")), ["doc"])


def order_findings(spark: SparkSession, sf_dir: str, kind: str, detector: str) -> DataFrame:
    skip = tuple(d for d in fixed.DETECTORS if d != detector)
    return detectors.detect(order_documents(spark, sf_dir, kind), ["doc"], skip).select("doc", F.explode("evidence").alias("e"))


@query(
    "select l_orderkey as doc, l_linenumber::int as paragraph, 'high' as severity, 'Hidden text via styling' as title, concat_ws('; ', case when l_linestatus = 'F' then 'flagged hidden (w:vanish / display:none / hidden cell)' end, "
    "case when l_returnflag = 'R' then 'near-white text color #FFFFFF' end, case when l_linenumber = 7 then 'transparent text (alpha=0.05)' end) as reasons from lineitem where l_linestatus = 'F' or l_returnflag = 'R' or l_linenumber = 7"
)
def q_hidden_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_findings(spark, sf_dir, "docx", "DET-002")
    return e.select("doc", "e.paragraph", "e.severity", "e.title", F.col("e.raw")["reasons"].alias("reasons"))


@query("select l_orderkey as doc, l_linenumber::int as paragraph, 'medium' as severity, (l_quantity / 10)::double as font_size from lineitem where l_quantity > 0 and l_quantity <= 20")
def q_tiny_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_findings(spark, sf_dir, "pptx", "DET-003")
    return e.select("doc", "e.paragraph", "e.severity", F.col("e.raw")["font_size"].cast("double").alias("font_size"))


@query(
    "select l_orderkey as doc, case l_orderkey % 3 when 0 then 'hidden' else 'veryHidden' end as state, (2 * count(*) - 1)::int as text_length from lineitem where l_orderkey % 3 < 2 group by l_orderkey"
)
def q_hidden_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_findings(spark, sf_dir, "xlsx", "DET-004").filter("e.title like 'Hidden sheet:%'")
    return e.select("doc", F.col("e.raw")["state"].alias("state"), F.col("e.raw")["text_length"].cast("int").alias("text_length"))


@query(
    "select l_orderkey as doc, min(l_linenumber)::int as first_col, array_to_string(list_sort(list(distinct l_linenumber)), ',') as cols from lineitem where l_returnflag = 'R' group by l_orderkey"
)
def q_hidden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_findings(spark, sf_dir, "xlsx", "DET-004").filter("e.title like 'Hidden columns%'")
    return e.select("doc", F.col("e.col").alias("first_col"), F.col("e.raw")["cols"].alias("cols"))


@query(
    "select l_orderkey as doc, 'OOXML hidden node: ' || l_returnflag as title, 'word/document.xml#' || l_returnflag as element, count(*)::int as n from lineitem where l_linestatus = 'F' group by l_orderkey, l_returnflag"
)
def q_ooxml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("tag")).agg(F.count("*").cast("int").alias("n"))
    node = F.struct(F.lit("word/document.xml").alias("part"), "tag", "n", F.lit("x").alias("text"))
    docs = ir.complete(lines.groupBy("doc").agg(F.collect_list(node).alias("nodes")).withColumn("kind", F.lit("docx")), ["doc"])
    found = detectors.detect(docs, ["doc"]).select("doc", F.explode("evidence").alias("e"))
    return found.select("doc", "e.title", "e.element", F.col("e.raw")["count"].cast("int").alias("n"))


@query(
    "select l_orderkey as doc, count(*) || ' Word comment(s) present' as title, count(*)::int as n, '[' || array_to_string(list_sort(list('\"' || l_returnflag || l_linestatus || '\"'))[:20], ',') || ']' as comments from lineitem where l_returnflag <> 'N' group by l_orderkey"
)
def q_word_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_findings(spark, sf_dir, "docx", "DET-006")
    return e.select("doc", "e.title", F.col("e.raw")["count"].cast("int").alias("n"), F.col("e.raw")["comments"].alias("comments"))


@query("select l_orderkey as doc, l_linenumber::int as page, '/Text' as subtype, l_returnflag || l_linestatus as contents from lineitem where l_returnflag <> 'N'")
def q_pdf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_findings(spark, sf_dir, "pdf", "DET-006")
    return e.select("doc", "e.page", F.col("e.raw")["subtype"].alias("subtype"), F.col("e.raw")["contents"].alias("contents"))


@query("select distinct l_orderkey as doc, 'medium' as severity, 'word/vbaProject' || l_linestatus || '.bin' as part from lineitem where l_returnflag = 'R'")
def q_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_findings(spark, sf_dir, "docx", "DET-007")
    return e.select("doc", "e.severity", F.col("e.raw")["part"].alias("part"))


@query("select l_orderkey as doc, l_linenumber::int as page, case when l_linenumber = 7 then 0.05 else 1.0 end::double as alpha from lineitem")
def q_least_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = order_documents(spark, sf_dir, "pdf").select("doc", F.explode("paragraphs").alias("p"))
    return pages.select("doc", F.col("p.idx").alias("page"), ir.least_alpha(F.col("p")).alias("alpha"))


@query(COUNTED_SQL + "select doc_id % 10 as folder, max(case when total > 0 then 1 else 0 end)::int as exit_code, count(*) filter (total > 0) as files from counts group by folder")
def q_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detectors.detect(text_documents(spark, sf_dir), ["doc_id"], kinds=("text",)).select("doc_id", scoring.exit_code().alias("code"))
    return docs.groupBy((F.col("doc_id") % 10).alias("folder")).agg(F.max("code").alias("exit_code"), F.count_if(F.col("code") == 1).alias("files"))


_SEEN_SQL = f"with {overlay.CONVERSATIONS_SQL}, seen as (select conv_id, turn, len(regexp_extract_all(text, '{_INVISIBLE_SQL}')) as i, len(regexp_extract_all(text, '{_BIDI_SQL}')) as b from turns) "


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = overlay.conversations(spark, sf_dir).withColumns({"response": F.to_json(F.struct("text")), "name": F.concat_ws("/", "conv_id", "turn")})
    return gate.post_tool(turns, "response")


@query(_SEEN_SQL + "select conv_id || '/' || turn as file, 'tool_response' as kind, 'allow' as decision, 'POL-TOOL-001' as rule_id, 'invisible=' || i || ', bidi=' || b as note from seen where i + b > 0")
def q_post_tool_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.post_tool_audit(_seen(spark, sf_dir), "name", F.lit("t")).select("file", "kind", "decision", "rule_id", "note")


@query(
    _SEEN_SQL + "select conv_id, turn, case when i + b = 0 then '' else '{\"hookSpecificOutput\":{\"hookEventName\":\"PostToolUse\",\"additionalContext\":\"this tool result contains ' || i || ' invisible and ' || b || "
    "' bidi control character(s) that a human reader does not see\"}}' end as answer from seen"
)
def q_post_tool_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).select("conv_id", "turn", gate.rendered_post().alias("answer"))

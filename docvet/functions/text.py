"""Column functions on text. Places count code points, from 0; ends are exclusive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvet.functions import fixed

FLAGS = "(?iU)"
INVISIBLE_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in fixed.INVISIBLE) + "]"
BIDI_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in fixed.BIDI) + "]"
#: Line ends of Unicode text: CR LF, and each of LF VT FF CR FS GS RS NEL LS PS.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """text without white space, of Unicode and the separators 1C-1F, at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(text: Column) -> Column:
    """The lines of text; a line end at the very end begins no further line, and an empty text has no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, -1))


def clean(text: Column) -> Column:
    """text without invisible code points and direction controls."""
    return F.regexp_replace(F.regexp_replace(text, INVISIBLE_CLASS, ""), BIDI_CLASS, "")


def count_invisible(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INVISIBLE_CLASS))


def count_bidi(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BIDI_CLASS))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def found(text: Column, pattern: str) -> Column:
    """The first match of the pattern."""
    return F.regexp_extract(text, f"{FLAGS}(?:{pattern})", 0)


def place(text: Column, pattern: str) -> Column:
    """Where the first match begins."""
    return F.length(F.regexp_extract(text, f"(?isU)^(.*?)(?:{pattern})", 1))


def snippet(text: Column, start: Column, end: Column, around: int = 40) -> Column:
    """The match with up to around code points on either side and an ellipsis where text was cut."""
    low, high = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    return F.concat(F.when(low > 0, "…").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.length(text), "…").otherwise(""))


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's last part; a name's leading dot begins none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def hex_colour(value: Column) -> Column:
    """RRGGBB in upper case from a colour of 3, 6 or 8 (alpha first) hexadecimal digits, or white by name; else null."""
    v = F.upper(F.regexp_replace(strip(value), "^#+", ""))
    return (
        F.when(v == "WHITE", F.lit("FFFFFF")).when(v.rlike("^[0-9A-F]{6}$"), v).when(v.rlike("^[0-9A-F]{3}$"), F.regexp_replace(v, "(.)", "$1$1")).when(v.rlike("^[0-9A-F]{8}$"), F.substring(v, 3, 6))
    )


def style_map(style: Column) -> Column:
    """An inline style as a map of lower-cased names and values; the last of a name counts."""
    pairs = F.transform(
        F.regexp_extract_all(F.lower(style), F.lit(r"([a-z-]+\s*:\s*[^;]+)"), F.lit(1)),
        lambda d: F.struct(F.regexp_extract(d, r"^([a-z-]+)", 1).alias("k"), strip(F.regexp_extract(d, r"^[a-z-]+\s*:\s*([^;]+)", 1)).alias("v")),
    )
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def style_hidden(style: Column) -> Column:
    """Whether a style hides its text: not displayed, not visible, or white."""
    signs = (style["display"] == "none", style["visibility"] == "hidden", hex_colour(style["color"]) == "FFFFFF")
    out = F.lit(False)
    for sign in signs:
        out = out | F.coalesce(sign, F.lit(False))
    return out


def style_points(style: Column) -> Column:
    """A font size in points: px by 1.3333, rounded to hundredths, pt as it is, other units null."""
    size = style["font-size"]
    n = F.regexp_extract(size, r"^([\d.]+)\s*(px|pt)", 1).try_cast("double")
    unit = F.regexp_extract(size, r"^([\d.]+)\s*(px|pt)", 2)
    return F.when(unit == "px", F.round(n / 1.3333, 2)).when(unit == "pt", n)


def family(path: Column) -> Column:
    """The comment family of a path: by its extension, rule files as hash, else null."""
    table = F.create_map(*[F.lit(x) for fam, exts in fixed.FAMILY_EXTENSIONS.items() for e in exts for x in (e, fam)])
    return F.when(F.lower(file_name(path)).isin(*fixed.RULE_FILES), F.lit("hash")).otherwise(table[extension(path)])


def _prefixes(family: str) -> str:
    """The beginning of a comment line of the family."""
    return r"(?iU)^[\s\x1c-\x1f]*(?:" + "|".join(re.sub(r"([/*.])", r"\\\1", p) for p in fixed.COMMENT_PREFIXES[family]) + ")"


def comment_body(line: Column, family: Column) -> Column:
    """The stripped text of a comment line, or null: the family's prefix must begin the line; without family every line is one."""
    s = strip(line)
    out = F.when(family.isNull(), F.when(s != "", s))
    for fam in fixed.COMMENT_PREFIXES:
        out = out.when(family == fam, F.when(line.rlike(_prefixes(fam)), strip(F.regexp_replace(line, _prefixes(fam), ""))))
    return out


def comment_prefix(line: Column, family: Column) -> Column:
    """The family's prefix that begins the line, or an empty text."""
    out = F.when(family.isNull(), F.lit(""))
    for fam in fixed.COMMENT_PREFIXES:
        out = out.when(family == fam, F.lower(F.regexp_replace(F.regexp_extract(line, _prefixes(fam), 0), r"(?U)^[\s\x1c-\x1f]+", "")))
    return F.coalesce(out, F.lit(""))

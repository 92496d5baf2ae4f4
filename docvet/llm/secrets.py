"""Secrets in texts by fixed patterns and by windowed entropy. Only DataFrame and SQL functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in their order: pattern, the group whose length counts, its least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Patterns with the same matches but those that are too short, so that short runs of hexadecimal digits, of which any text is
#: full, aren't gathered first. A match is a whole run; too short a run has no longer match in it.
LONG = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
#: Cheap patterns that every text with a span of the kind has.
MAY_HAVE = {"assign": r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Candidates for entropy: runs of these characters of at least a window's length with both a digit and a letter, of digits
#: or of capitals alone, or of letters in mixed case with two capitals side by side, as names seldom have.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?:(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])|(?=[0-9]++(?![+/_-]))|(?=[A-Z]++(?![a-z+/_-]))"
    r"|(?=[A-Za-z+/_-]*[A-Z]{2})(?=[A-Za-z+/_-]*[a-z][A-Z]))[A-Za-z0-9+/_-]{20,}+"
)
WINDOW = 20
#: Bits in a window from which it counts as random, by class: of hexadecimal digits only, or of mixed characters. Each is what
#: about 99 of 100 random strings of its class's smallest alphabet (the digits 0-9; base32, or lower case and digits) reach.
HEX_BITS, MIXED_BITS = 2.6, 3.35
#: Candidates that are no secrets: identifiers in the form 8-4-4-4-12, placeholders, counting runs, runs of words and dates.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|redacted|dummy",
    r"(?i)0123456789abcdef|abcdefghijklmnopqrstuvwxyz|123456789012345",
    r"^(?=.{1,256}$)(?:[A-Z]?[a-z]{2,12}[0-9]{0,4}[/_-]|[0-9]{1,8}[/_-])+(?:[A-Z]?[a-z]{2,12}[0-9]{0,4}|[0-9]{1,8})$",
]


#: Windows that start in a piece of a candidate; elements of a block of running sums. They bound the short arrays that grow by
#: one element at a time, so that the cost is in proportion to a text's length.
PIECE, BLOCK = 64, 256
_SPANS = "array<struct<start: bigint, ordinal: int, end: bigint, kind: string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is evaluated once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _sums(values: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(values, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def _before(values: Column) -> Column:
    """The sum of the elements before each element, by blocks."""

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return _let(_sums(totals), lambda starts: F.flatten(F.transform(blocks, lambda v, k: F.transform(F.slice(_sums(v), 1, F.size(v)), lambda x: x + F.get(starts, k)))))

    blocks = _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(values) > 0, _let(blocks, placed)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _located(text: Column, pattern: str, group: int, least: int, ordinal: int) -> Column:
    """Spans (start, ordinal, end, hit) of the pattern's matches whose group has the least length.

    The texts between matches, from split(), and the matches themselves give every match's place in code points.
    """
    hits, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    found = F.transform(
        F.filter(zipped, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(x["hit"].alias("hit"), F.length(x["value"]).alias("size"), F.length(x["gap"]).cast("bigint").alias("gap"), F.length(x["hit"]).cast("bigint").alias("long")),
    )

    def placed(found: Column) -> Column:
        def span(x: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + x["gap"]
            return F.struct(start.alias("start"), F.lit(ordinal).alias("ordinal"), (start + x["long"]).alias("end"), x["hit"].alias("hit"), x["size"].alias("size"))

        return _let(_before(F.transform(found, lambda x: x["gap"] + x["long"])), lambda before: F.transform(found, lambda x, i: span(x, i, before)))

    out = _let(found, placed)
    return F.filter(out, lambda s: s["size"] >= least) if least else out


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    spans = F.transform(
        _located(text, LONG.get(kind, pattern), group, least, list(BASE).index(kind)),
        lambda s: F.struct(s["start"], s["ordinal"], s["end"], F.lit(kind).alias("kind")),
    )
    return F.when(text.rlike(MAY_HAVE[kind]), spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _hot(piece: Column, bits: Column) -> Column:
    """The first places, in a piece, of the windows whose entropy reaches bits.

    Character by character: the counts of the one that leaves the window and of the one that enters it change by one, and
    with them the sum of c log2 c, from which the entropy follows. A count is what removing the character takes from the
    window's length.
    """
    log = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])

    def change(window: Column, char: Column, more: int) -> Column:
        """Of the sum, when the character's count in the window becomes more by one or, with 0, less by one."""
        return _let((F.length(window) - F.length(F.replace(window, char, F.lit("")))).cast("int"), lambda n: F.get(log, n + more) - F.get(log, n + (more - 1)))

    def step(acc: Column, i: Column) -> Column:
        last = F.substring(piece, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)))  # the window before i enters
        stays = F.when(i >= WINDOW, F.substring(last, F.lit(2), F.lit(WINDOW - 1))).otherwise(last)
        left = F.when(i >= WINDOW, change(last, F.substring(last, F.lit(1), F.lit(1)), 0)).otherwise(F.lit(0.0))
        s = acc["s"] - left + change(stays, F.substring(piece, i + 1, F.lit(1)), 1)
        return _let(
            s,
            lambda s: F.struct(
                s.alias("s"),
                F.when((i >= WINDOW - 1) & (math.log2(WINDOW) - s / WINDOW >= bits - 1e-9), F.array_append(acc["at"], i - (WINDOW - 1))).otherwise(acc["at"]).alias("at"),
            ),
        )

    first = F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<int>)").alias("at"))
    return F.aggregate(F.sequence(F.lit(0), F.length(piece) - 1), first, step, lambda acc: acc["at"])


def windows(hit: Column, bits: Column, start: Column) -> Column:
    """The joined windows of a candidate whose entropy reaches bits, as (start, ordinal, end, kind). Long candidates are cut
    into pieces of PIECE window starts and the characters that their last windows need."""
    cut = f"(?s)(.{{1,{PIECE}}})(?=(.{{0,{WINDOW - 1}}}))"
    pieces = F.zip_with(F.regexp_extract_all(hit, F.lit(cut), F.lit(1)), F.regexp_extract_all(hit, F.lit(cut), F.lit(2)), lambda a, b: F.concat(a, b))
    at = F.flatten(F.transform(pieces, lambda piece, k: F.transform(_hot(piece, bits), lambda o: k * PIECE + o)))

    def joined(at: Column) -> Column:
        low = F.filter(at, lambda p, i: F.coalesce(p - F.get(at, i - 1) > WINDOW, F.lit(True)))
        high = F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) - p > WINDOW, F.lit(True)))
        return F.zip_with(
            low, high, lambda a, b: F.struct((start + a).alias("start"), F.lit(len(BASE)).alias("ordinal"), (start + b + WINDOW).alias("end"), F.lit("entropy").alias("kind"))
        )

    return _let(at, joined)


def entropy_spans(text: Column, allowed: list[str]) -> Column:
    found = F.filter(_located(text, CANDIDATE, 0, 0, len(BASE)), lambda s: ~_any(s["hit"], allowed))
    bits = lambda hit: F.when(hit.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
    each = F.transform(found, lambda s: _let(bits(s["hit"]), lambda b: windows(s["hit"], b, s["start"])))
    return F.when(text.rlike(CANDIDATE), F.flatten(each)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _any(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def scan(docs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """doc_id and, per kind, an array of spans (start, ordinal, end, kind); places count code points, ends are exclusive.

    assign, access and hex are the base patterns, leftmost non-overlapping, with matches that are too short dropped after
    matching. entropy joins the sliding windows of WINDOW characters, within candidate strings, whose Shannon entropy
    reaches the bits of the string's character class; candidates that match an allowed pattern are passed over, base
    spans never. Null text counts as empty; repeated rows are scanned one by one; other columns aren't touched. The work is
    in proportion to a text's length, whatever the length of its matches and candidates.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", *[base_spans(text, kind).alias(kind) for kind in BASE], entropy_spans(text, ALLOWED if allowed is None else allowed).alias("entropy")
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, their sha256, and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.concat(*[F.col(k) for k in BASE])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("entropy"))).alias("spans"),
    )

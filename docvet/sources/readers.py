"""From files, or a table of texts, to the document model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed, ir, text
from docvet.sources import binary, formats

#: Folders whose files are no sources of a project.
LEFT_OUT = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "site-packages")


def files(spark: SparkSession, path: str, recursive: bool = True, most_bytes: int = fixed.MOST_FILE_BYTES) -> DataFrame:
    """path, length, modified, content; the content of files over most_bytes is null and never read into a task's batch."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return bounded(found, most_bytes).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def bounded(found: DataFrame, most_bytes: int = fixed.MOST_FILE_BYTES) -> DataFrame:
    """found, a table or stream of binary files, with null content for files over most_bytes, which isn't read."""
    small = found.filter(F.col("length") <= most_bytes)
    large = found.filter(F.col("length") > most_bytes).withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(large)


def source_files(found: DataFrame, with_builds: bool = False) -> DataFrame:
    """The files of known code extensions or rule names that lie in no folder that is left out."""
    left_out = LEFT_OUT[:-3] if with_builds else LEFT_OUT
    parts = F.split("path", "/")
    known = text.extension(F.col("path")).isin(*fixed.CODE_EXTENSIONS) | F.lower(text.file_name(F.col("path"))).isin(*fixed.RULE_FILES)
    return found.filter(known & ~F.arrays_overlap(parts, F.array(*map(F.lit, left_out))))


def with_kind(found: DataFrame) -> DataFrame:
    """found and kind: by name, else by the first bytes; zip where only the zip's parts can tell."""
    path = F.col("path")
    return found.withColumn("kind", F.coalesce(formats.kind_of_path(path), formats.kind_of_head(F.col("content"))))


#: Readers of further kinds, from a file's bytes to columns of the model; formats.register() tells which files they get.
OWN: dict[str, Callable[[bytes], dict]] = {}


def register(kind: str, reader: Callable[[bytes], dict], extensions: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> None:
    OWN[kind] = reader
    formats.register(kind, extensions, names)


def _reader(own: dict[str, Callable[[bytes], dict]]):
    return lambda batches: _read(batches, own)


def _read(batches, own):
    for pdf in batches:
        rows = [binary.read(k, p.rpartition("/")[2], bytes(c) if c is not None else None, own) for k, p, c in zip(pdf["kind"], pdf["path"], pdf["content"], strict=True)]
        out = pd.DataFrame({c: [r.get(c) for r in rows] for c in ir.COLUMNS if c not in ("source", "family")})
        yield out.assign(path=pdf["path"].values, length=pdf["length"].values)


def documents(found: DataFrame) -> DataFrame:
    """One row of the model for each file: path, length, source, ... A file that can't be read has an error and no content."""
    fields = ", ".join(f"{c} {t}" for c, t in ir.COLUMNS.items() if c not in ("source", "family"))
    known = with_kind(found)
    native = known.filter("kind = 'text'")
    other = known.filter("kind is null or kind <> 'text'")
    parsed = other.select("path", "length", "kind", "content").mapInPandas(_reader(dict(OWN)), f"{fields}, path string, length long")
    keys = ["path", "length"]
    both = ir.complete(code(native), keys).unionByName(ir.complete(parsed.withColumn("source", text.file_name(F.col("path"))), keys))
    return both


def code(found: DataFrame) -> DataFrame:
    """Source files by JVM functions only: UTF-8 with replacement, a leading mark dropped, one paragraph for each line."""
    name = text.file_name(F.col("path"))
    broken = F.contains(F.substring("content", 1, fixed.SNIFF_BYTES).cast("string"), F.lit("\x00"))
    message = F.concat(F.lit("failed to parse "), name, F.lit(": looks binary, cannot scan as text"))
    large = F.concat(F.lit("file is too large: "), name)
    error = F.when(F.col("content").isNull(), F.struct(F.lit("parse_failed").alias("kind"), large.alias("message"))).when(broken, F.struct(F.lit("parse_failed").alias("kind"), message.alias("message")))
    body = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    lines = F.when(error.isNull(), text.lines(body))
    return found.select("path", "length", F.lit("text").alias("kind"), name.alias("source"), text.family(F.col("path")).alias("family"), error.alias("error"), ir.text_paragraphs(lines).alias("paragraphs"))


def from_texts(table: DataFrame, key: str, body: str, family: str = "hash") -> DataFrame:
    """A table of texts as documents of kind text."""
    return ir.complete(
        table.select(key, F.col(key).cast("string").alias("source"), F.lit("text").alias("kind"), F.lit(family).alias("family"), ir.text_paragraphs(text.lines(F.coalesce(body, F.lit("")))).alias("paragraphs")), [key]
    )


META = r"""(?is)<meta\s[^>]*?(?:name|property)\s*=\s*"([^"]*)"[^>]*?content\s*=\s*"([^"]*)"""


def from_pages(table: DataFrame, key: str, html: str) -> DataFrame:
    """A table of web pages as documents of kind html, by JVM functions: comments, scripts and metadata, no paragraphs."""
    page = F.coalesce(F.col(html), F.lit(""))
    names, values = F.regexp_extract_all(page, F.lit(META), F.lit(1)), F.regexp_extract_all(page, F.lit(META), F.lit(2))
    pairs = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: F.struct(F.lower(x["k"]).alias("k"), x["v"].alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return ir.complete(
        table.select(
            key, F.lit("html").alias("kind"), F.col(key).cast("string").alias("source"), F.regexp_extract_all(page, F.lit("(?s)<!--(.*?)-->"), F.lit(1)).alias("comments"),
            F.regexp_count(page, F.lit(r"(?i)<script\b")).alias("scripts"), F.map_from_entries(last).alias("metadata"),
        ), [key],
    )

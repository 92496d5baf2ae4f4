"""Which reader a file gets: by extension, then by exact name, then by its first bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvet.functions import fixed, text

#: Kind by extension and by lower-cased file name; register() adds to them, the later wins.
BY_EXTENSION: dict[str, str] = {e: k for k, exts in fixed.KIND_EXTENSIONS.items() for e in exts} | {e: "text" for e in fixed.CODE_EXTENSIONS}
BY_NAME: dict[str, str] = {n: "text" for n in fixed.RULE_FILES}


def register(kind: str, extensions: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> None:
    BY_EXTENSION.update({e.lower().lstrip("."): kind for e in extensions})
    BY_NAME.update({n.lower(): kind for n in names})


#: Kinds with a test of a file's content, tried in turn where no other sign tells the kind.
SNIFFERS: list[tuple[str, Callable[[Column], Column]]] = []


def register_sniffer(kind: str, test: Callable[[Column], Column]) -> None:
    """test: from the content's first fixed.SNIFF_BYTES bytes, a binary column, to a boolean one."""
    SNIFFERS.append((kind, test))


def _table(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def kind_of_path(path: Column) -> Column:
    """The kind by extension, else by name, else null."""
    return F.coalesce(_table(BY_EXTENSION)[text.extension(path)], _table(BY_NAME)[F.lower(text.file_name(path))])


def kind_of_head(content: Column) -> Column:
    """The kind by the first bytes, zip for any zip file, else null."""
    head = F.hex(F.substring(content, 1, 512))
    trimmed = F.lower(F.regexp_replace(F.decode(F.unhex(F.regexp_replace(head, "^(?:09|0A|0B|0C|0D|20)+", "")), "ISO-8859-1"), "\x00", " "))
    known = (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0"), "xls")
        .when(trimmed.startswith("<!doctype html") | trimmed.startswith("<html"), "html").when(head.startswith("504B"), "zip")
    )
    own = [F.when(test(F.substring(content, 1, fixed.SNIFF_BYTES)), F.lit(kind)) for kind, test in SNIFFERS]
    return F.coalesce(known, *own)

"""The main text of web pages by two passes over their blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from docvet.llm import kernels

#: Fixed values. Elements that hold no text of the page, whose content is dropped.
DROPPED = frozenset("script style noscript template svg math head title iframe object canvas audio video map select option datalist button textarea input label form fieldset dialog menu nav aside footer".split())
#: Elements whose content is raw: markup in it is none.
RAW = frozenset("script style textarea title iframe noscript template svg xmp noembed noframes".split())
#: Elements without end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Words in class, id or role that mark an element as no part of the main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation navi "
    "newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar widget widgets complementary contentinfo".split()
)
#: Frequent words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in is that it for was on are as with his they at be this have from or had by not but what all were we when your can there use an each which she do how their if will "
    "der die das und in zu den ist nicht von sie mit dem sich des ein eine auf für es im auch als an er hat aus bei wird "
    "le la les de des et un une est que qui dans en du pour pas au par sur plus avec ce il elle sont ou "
    "el los las del y que es por con para una su se lo como más pero sus al este".split()
)

#: Pass one: link characters, code points, stop words as shares of all words.
MOST_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.33, 70, 200, 0.08, 0.16
#: Where article elements are a sign, only blocks in them that are nearly all links count as bad.
ARTICLE_LINKS = 0.75

#: Bounds of a quoted value, and of their number in a tag, within which quotes keep a tag open; a tag beyond them ends with the
#: next >. They bound what a broken tag costs.
QUOTED, QUOTES = 8192, 64
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]{{0,64}})((?>[^>"']*+(?:(?:"[^"]{{0,{QUOTED}}}"|'[^']{{0,{QUOTED}}}')[^>"']*+){{0,{QUOTES}}}+))>|<(/?)([a-zA-Z][^\s/>]{{0,64}})([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s{0,64}=\s{0,64}("[^"]*"|'[^']*'|[^\s>"']+))?""")
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    links: int
    article: bool
    heading: bool


def _marked(name: str, attributes: str) -> bool:
    for key, value in _ATTRIBUTE.findall(attributes):
        value, key = value.strip("\"'").lower(), key.lower()
        if key == "hidden":
            return True
        if key == "style":
            if _HIDDEN.search(value):
                return True
        elif key == "aria-hidden":
            if value == "true":
                return True
        elif key in ("class", "id", "role"):
            words = _SPLIT.split(value)
            if name not in ("html", "body", "article", "main") and not MARKS.isdisjoint(words):
                return True
            if name == "article" and not {"comment", "comments", "reply", "teaser", "related", "promo"}.isdisjoint(words):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order, without those in dropped or marked elements."""
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    #: Open elements: name, whether its text is dropped, in an article, in a link.
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: Counter[str] = Counter()  # names on the stack
    heading = dropped = article = link = False

    def end() -> None:
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, min(links, len(text)), article, heading))
            parts.clear()
        links = 0

    def state() -> None:
        nonlocal dropped, article, link
        _, dropped, article, link = stack[-1] if stack else ("", False, False, False)

    def close(k: int) -> None:
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    # Behind the last > no tag ends; what follows is text up to an unfinished comment.
    last = page.rfind(">") + 1
    tail = page.find("<!", last)
    at, n = 0, len(page) if tail < 0 else tail
    while at < n:
        m = _TOKEN.search(page, at, last)
        stop = m.start() if m else n
        if stop > at and not dropped:
            text = html.unescape(page[at:stop])
            parts.append(text)
            if link:
                links += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag closes the innermost such element and all in it; without one it is passed over
            if name not in INLINE:
                end()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            state()
            heading = heading and name not in ("h1", "h2", "h3", "h4", "h5", "h6")
            continue
        attributes = m[3] or m[6] or ""
        if name in INLINE:
            if name == "br" and not dropped:
                parts.append(" ")
        else:
            end()
            while stack and stack[-1][0] in INLINE:  # a block ends what inline elements were left open
                close(len(stack) - 1)
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close(len(stack) - 1)
            state()
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in RAW and not attributes.endswith("/"):
            end_tag = re.compile(rf"</{re.escape(name)}\s{{0,64}}>", re.I).search(page, at)
            at = end_tag.end() if end_tag else n
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        gone = dropped or name in DROPPED or (name == "header" and not article) or (bool(attributes) and _marked(name, attributes))
        opened[name] += 1
        stack.append((name, gone, article or (name in ("article", "main") and not gone), link or name == "a"))
        dropped, article, link = stack[-1][1:]
    end()
    return out


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are main text.

    Pass one decides by link density, length and stop-word density; blocks without a clear sign stay open. Pass two gives
    an open block the label of the nearest decided blocks: main text if both agree on it or, where they differ, the nearer
    one is; with decided blocks on one side only, theirs. Being in an article or main element is a sign for open blocks
    unless pass one finds more main text outside of such elements: then blocks in them that few stop words or some links
    speak against are open too, open blocks in them look at blocks in them only and with none decided are main text, and open
    blocks outside are main text only between two such blocks outside.
    """
    first = [_first(b, False) for b in found]
    inside, outside = (sum(len(b.text) for b, x in zip(found, first, strict=True) if x and b.article == side) for side in (True, False))
    sign = any(b.article for b in found) and inside >= outside
    if sign:
        first = [_first(b, b.article) for b in found]
    out: list[bool] = [False] * len(found)
    for side in (True, False):
        zone = [k for k, b in enumerate(found) if (b.article or not sign) == side]
        before: list[tuple[int, bool] | None] = []
        last = None
        for k in zone:
            if (x := first[k]) is not None:
                last = (k, x)
            before.append(last)
        last = None
        for k, a in zip(reversed(zone), reversed(before), strict=True):
            if (x := first[k]) is not None:
                out[k] = x
                last = (k, x)
            elif sign and not side:
                out[k] = a is not None and last is not None and a[1] and last[1]
            elif a is None or last is None:
                out[k] = (a or last or (k, sign and side))[1]
            else:
                out[k] = (a if a[1] == last[1] or k - a[0] <= last[0] - k else last)[1]
    return out


def _first(b: Block, sign: bool) -> bool | None:
    """The label of pass one, None where it stays open; sign: the block's place speaks for main text."""
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP for w in words) / max(1, len(words))
    share = b.links / max(1, len(b.text))
    if share > (ARTICLE_LINKS if sign else MOST_LINKS) or (not sign and b.text.startswith(("©", "(c) ", "Copyright "))):
        return False
    if len(b.text) < SHORT or share > MOST_LINKS:
        return None
    if stops >= MANY_STOPS:
        return True
    if stops >= FEW_STOPS:
        return True if len(b.text) >= LONG else None
    return False if len(b.text) < LONG and not sign else None


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def _run(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    text is the main text: the blocks that labels() keeps, in page order, joined by one space; white space in a block is
    one space, character references are decoded once. Null or empty html, and pages without main text, give an empty text.
    Markup may be broken: end tags without element are passed over, open elements end with the page. A page takes time in
    proportion to its length, however broken.
    """
    return pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(
        kernels.trimmed(_run), "page_id long, url string, text string, n_chars long"
    )

"""Operator 10: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 decides what it can:

* bad: in a menu, footer, side bar, form, advert, notice, comment section or
  hidden element (by tag, role, or a word of class or id), outside the page's
  ``article``/``main`` if it has one with text, or with more than
  ``max_link_density`` of its characters in links; the words of class and id
  do not count on ``html``, ``body`` and the outermost ``article``/``main``,
  nor, if nothing of the page would be left, on an element around that one, or,
  if still nothing would be, on any outside of it;
* good: at least ``long_chars`` characters and ``stop_density`` of its words
  are stop words;
* the rest is ambiguous.

Pass 2 labels every ambiguous block by its nearest decided neighbours within
its region (the article, or the page if there is none): the nearer of the
previous and the next one decides; between a good and a bad one at equal
distance it stays if it is a heading or has stop words. The two edges of an
article count as good neighbours; those of a page do not count, and with no
decided block in it nothing stays. If nothing of a page stays (a language
without known stop words, no article), every ambiguous block of at least
``long_chars`` characters counts as good, and pass 2 is done with these. White
space in a block becomes one blank, character references are decoded, blocks
are joined by an empty line; nothing else is dropped.

Edge cases: null or empty html gives an empty text; a cut-off tag or an
unclosed element ends with the page; an end tag without its start tag is
ignored, in constant time; repeated rows give one result row each;
null ids and urls are kept; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_CHARS = 70
STOP_DENSITY = 0.15
MAX_LINK_DENSITY = 0.5

# Frequent function words of four languages.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he her his in is it its no not of on or she
that the their they this to was were which with you
aber als am auch auf aus bei das dem den der des die ein eine einem einen einer es für im ist
mit nach nicht sich sie sind und von vor war wie wird zu zum zur
al como con de del el en entre es esta la las lo los más no o para pero por que se sin sobre su
sus un una y
au aux avec ce ces dans elle est et il ils je le les leur mais ne nous ou par pas plus pour qu
que qui sa sont sur une vous
""".split())

# HTML element names by their role here.
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre
section summary table tbody td tfoot th thead tr ul
""".split())
VOID_TAGS = frozenset("""
area base br col embed hr img input link meta param source track wbr
""".split())
SILENT_TAGS = frozenset("""
button head iframe noscript script select style svg template textarea title
""".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
BAD_TAGS = frozenset("aside dialog footer form menu nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_ROLES = frozenset("""
alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
toolbar
""".split())
BAD_WORDS = frozenset("""
ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments
consent cookie cookies disqus footer form gdpr login menu modal nav navbar navigation newsletter
notice notices outbrain pagination popup promo promoted recommended related replies respond share
sharing sidebar signup skyscraper social sponsor sponsored subscribe taboola toolbar widget
""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int      # characters in links
    bad: bool
    in_article: bool
    heading: bool
    wrapped: bool = False  # bad only by class or id words outside an article


def _has_bad_words(tag: str, attrs: str, in_article: bool) -> bool:
    """By a word of class or id."""
    if tag in ("html", "body") or (tag in ("article", "main") and not in_article):
        return False
    for name, *values in _ATTR.findall(attrs or ""):
        if name.lower() in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", "".join(values).lower()))
            if words & BAD_WORDS or ("header" in words and not in_article and tag != "h1"):
                return True
    return False


def _is_bad(tag: str, attrs: str, in_article: bool) -> bool:
    """By tag, role or hiding."""
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs or attrs.isspace():
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in BAD_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def page_blocks(page: str) -> list[Block]:
    """The blocks with visible text, in page order."""
    blocks: list[Block] = []
    # tag, bad, article, silent, class or id words outside an article
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    opened: Counter[str] = Counter()  # tags on the stack
    bad = article = silent = around = links = 0
    parts: list[str] = []
    linked_parts: list[str] = []
    heading = False

    def close_block() -> None:
        nonlocal heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                linked = len(" ".join("".join(linked_parts).split()))
                blocks.append(Block(text, linked, bad + around > 0, article > 0, heading,
                                    bad == 0 and around > 0))
            parts.clear()
            linked_parts.clear()
        heading = False

    def pop() -> str:
        nonlocal bad, article, silent, around
        tag, was_bad, was_article, was_silent, was_around = stack.pop()
        opened[tag] -= 1
        bad -= was_bad
        article -= was_article
        silent -= was_silent
        around -= was_around
        return tag

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        text = token["text"]
        if text is not None:
            if not silent:
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if links:
                    linked_parts.append(text)
            continue
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag, attrs = tag.lower(), (token["attrs"] or token["attrs2"] or "")
        is_block = tag in BLOCK_TAGS
        if token["end"] or token["end2"]:
            if is_block:
                close_block()
            if tag == "a":
                links = max(links - 1, 0)
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if is_block:
            close_block()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                pop()
        if tag == "a":
            links += 1
        if tag in VOID_TAGS or attrs.endswith("/") and not is_block:
            continue
        if tag in RAW_TAGS:  # no tags inside: skip to its end
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        words = _has_bad_words(tag, attrs, article > 0)
        marks = (_is_bad(tag, attrs, article > 0) or (words and article > 0),
                 tag in ("article", "main"), tag in SILENT_TAGS, words and article == 0)
        if is_block or any(marks):
            if not is_block and (marks[0] or marks[3]):
                close_block()
            stack.append((tag, *marks))
            opened[tag] += 1
            bad, article, silent = bad + marks[0], article + marks[1], silent + marks[2]
            around += marks[3]
            heading = heading or tag in HEADINGS
    close_block()
    return blocks


def _nearest(known: list[bool | None]) -> list[int | None]:
    """At every place, the last place up to it with a decision."""
    out, last = [], None
    for place, label in enumerate(known):
        last = last if label is None else place
        out.append(last)
    return out


def label_blocks(blocks: list[Block], long_chars: int = LONG_CHARS,
                 stop_density: float = STOP_DENSITY,
                 max_link_density: float = MAX_LINK_DENSITY,
                 any_language: bool = False) -> list[bool]:
    """Which blocks belong to the main text; with ``any_language`` a long block
    is good without stop words."""
    has_article = any(b.in_article and not b.bad for b in blocks)
    labels: list[bool | None] = []
    densities = []
    for b in blocks:
        words = _WORD.findall(b.text.lower())
        densities.append(sum(w in STOP_WORDS for w in words) / max(len(words), 1))
        if (b.bad or (has_article and not b.in_article)
                or b.linked > max_link_density * len(b.text)):
            labels.append(False)
        elif len(b.text) >= long_chars and (any_language or densities[-1] >= stop_density):
            labels.append(True)
        else:
            labels.append(None)
    # decided neighbours of the same region: the article, or the whole page; the
    # edges of an article are good neighbours, those of a page are none
    region = [k for k, b in enumerate(blocks) if not has_article or (b.in_article and not b.bad)]
    edge = True if has_article else None
    known = [edge, *(labels[k] for k in region), edge]
    before = _nearest(known)
    after = [len(known) - 1 - at if at is not None else None for at in _nearest(known[::-1])][::-1]
    out = [bool(x) for x in labels]
    for place, k in enumerate(region, 1):
        if labels[k] is None:
            sides = sorted((abs(at - place), known[at]) for at in (before[place], after[place])
                           if at is not None)
            if len(sides) == 2 and sides[0][0] == sides[1][0] and sides[0][1] != sides[1][1]:
                out[k] = blocks[k].heading or densities[k] > 0
            else:
                out[k] = bool(sides and sides[0][1])
    return out


def main_text(page: str | None, **options) -> str:
    blocks = page_blocks(page or "")
    labels = label_blocks(blocks, **options)
    for inside in (True, False):  # class words around the article, then all outside of it
        open_blocks = [replace(b, bad=b.bad and not (b.wrapped and b.in_article >= inside))
                       for b in blocks]
        if not any(labels) and open_blocks != blocks:
            blocks, labels = open_blocks, label_blocks(open_blocks, **options)
        if not any(labels):
            labels = label_blocks(blocks, **options, any_language=True)
    return "\n\n".join(b.text for b, ok in zip(blocks, labels) if ok)


def _extract(options: dict):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, **options) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return extract


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html", **options) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(_extract(options), f"page_id {kinds[0]}, url {kinds[1]}, text string, "
                           "n_chars bigint")

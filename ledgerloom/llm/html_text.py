"""Main text of web pages by two-pass block rules.

Pass one classifies each block by its stop-word density, length and link density. Pass two lets blocks that stay ambiguous
(mostly short ones) inherit the label of the nearest decided neighbour, neighbours in the same part of the page first.
Blocks inside parts that are no article by their element or name (menus, notices, adverts, forms, reader comments, ...) are
decided before both.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.llm.common import slices

#: Frequent function words (fixed values), of the languages that pages come in.
STOP_WORDS = {
    "en": "the of and to in is that it for on as with was be by are this from or an at not have has but which you we they he she his her their its will can been were had more one all there when who what if would about so out up no".split(),
    "de": "der die das und in zu den mit von ist des sich ein eine einer einem einen nicht auf für im dem auch als an es werden aus er hat dass sie nach wird bei um am sind noch wie über vor zum zur war haben nur oder aber durch man sein".split(),
    "fr": "de la le et les des en un une du dans que est pour qui par sur pas au ce il plus ne se avec son sont aux ou mais leur nous elle être cette fait ont été même deux si très tout comme ses sans entre".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split(),
}
_ALL_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words)
#: Elements that begin and end a block (fixed values of the HTML standard).
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
) - {"br"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text.
_SILENT = frozenset("script style noscript template iframe object svg math canvas audio video textarea select option button head title noframes".split())
#: Elements whose text is no article.
_ASIDE = frozenset("nav footer aside form menu dialog fieldset legend label search address".split())
#: Words in class, id and role that name such parts.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promoted promotion teaser outbrain taboola "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs toc pagination pager paging skip skiplink "
    "header masthead topbar footer foot colophon copyright legal disclaimer imprint sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup login register paywall "
    "comment comments commentlist respond reply replies disqus discussion reviews "
    "share sharing social socials follow related recommended recommendations more-stories trending popular tags tagcloud search searchform form".split()
)
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Comments, doctype and processing instructions, tags; an unclosed comment or tag runs to the end.
_MARKUP = re.compile(r"<!--.*?(?:--!?>|$)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"\w+")


@dataclass
class Block:
    """Text between two block borders. path: numbers of the elements around it; kind: the innermost block element."""

    path: tuple[int, ...]
    kind: str
    aside: bool
    article: int = 0  # number of the innermost article or main element around it
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def _is_aside(name: str, attributes: str, inside_article: bool) -> bool:
    if name in _ASIDE or name == "header" and not inside_article:
        return True
    if name in ("html", "body", "main", "article"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id", "role") and name != "header":
            if any(_NAMES.intersection(_NAME_WORDS.findall(_CAMEL.sub(" ", part).lower())) for part in value.split()):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks in page order, their text with references decoded and white space turned into single blanks."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, its number, whether an aside part begins there
    at = number = 0
    links = 0
    current: Block | None = None

    def text(upto: int) -> None:
        nonlocal current
        if upto > at:
            raw = page[at:upto]
            if current is None:
                kind = next((n for n, _, _ in reversed(stack) if n in _BLOCKS), "body")
                current = Block(tuple(i for _, i, _ in stack), kind, any(a for _, _, a in stack), next((i for n, i, _ in reversed(stack) if n in ("article", "main")), 0))
                found.append(current)
            current.pieces.append(raw)
            if links:
                current.linked += len(raw.strip())

    position = 0
    while match := _MARKUP.search(page, position):
        position = match.end()
        name = (match[2] or "").lower()
        if not name:
            text(match.start())
            at = match.end()
            continue
        closing = bool(match[1])
        text(match.start())
        at = match.end()
        if name == "br":
            if current is not None:
                current.pieces.append(" ")
            continue
        if name in _BLOCKS:
            current = None
        if name == "a":
            links = 0 if closing else 1
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in _VOID or match[3].rstrip().endswith("/") and name not in _BLOCKS:
            continue
        if name in _SILENT:
            if name in ("head", "noscript", "noframes", "select", "object", "svg", "math", "audio", "video", "canvas", "button", "template"):
                end = re.compile(rf"</{name}\s*>" + (r"|<body[\s>]" if name == "head" else ""), re.I).search(page, at)
            else:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None:
                at = position = len(page) if name != "head" else at
            elif end[0].lower().startswith("<body"):
                at = position = end.start()
            else:
                at = position = end.end()
            continue
        if name in _BLOCKS:  # a p ends before the next block, a list item before the next one
            while stack and (stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "font", "u") and any(n == "p" for n, _, _ in stack)):
                stack.pop()
            if name in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                stack.pop()
        number += 1
        inside = any(n in ("article", "main") for n, _, _ in stack)
        stack.append((name, number, _is_aside(name, match[3], inside)))
    text(len(page))
    kept = []
    for block in found:
        block.text = " ".join(html.unescape("".join(block.pieces)).split())
        if block.text:
            kept.append(block)
    return kept


def _first_pass(block: Block) -> str:
    """good, bad, or "" where length and stop words don't decide."""
    if block.aside:
        return "bad"
    size = len(block.text)
    if block.linked > 0.5 * size and size < 500:
        return "bad"
    if block.kind in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return ""
    words = _WORDS.findall(block.text.lower())
    density = sum(w in _ALL_STOPS for w in words) / max(1, len(words))
    if size >= 70 and block.linked <= 0.3 * size and density >= 0.12:
        return "good"
    if size >= 400 and block.linked <= 0.2 * size:
        return "good"  # long running text of a language without a list, or of odd words
    return ""


def _second_pass(found: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided one; the one deeper in the same part wins over distance.

    Inside an article element only its own blocks count, and without any decided one the element decides: good. If nothing on
    the page is good then, what was ambiguous is.
    """
    nearest: list[list[int]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in order:
            key = found[i].article
            if found[i].label:
                last[key] = i
                last[0] = i
            elif key in last:
                nearest[i].append(last[key])
    labels = []
    for i, block in enumerate(found):
        near = []
        for j in nearest[i]:
            deep = min(len(block.path), len(found[j].path))
            common = next((k for k in range(deep) if block.path[k] != found[j].path[k]), deep)
            near.append((-common, abs(i - j), found[j].label != "good"))
        labels.append(block.label or ("bad" if near and min(near)[2] else "good"))
    if "good" not in labels:
        labels = [b.label or "good" for b in found]
    for block, label in zip(found, labels):
        block.label = label


def main_text(page: str | None) -> str:
    """The article's text: good blocks in page order, joined by one blank. Empty for null, empty and text-free pages."""
    if not page:
        return ""
    found = blocks_of(page)
    for block in found:
        block.label = _first_pass(block)
    _second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def with_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of `pages`, with the article's text in `out` (in place of a column of that name).

    Null and empty pages have the empty text. Each row is worked alone, so ties and repeated rows don't matter.
    """
    pages = pages.drop(*([out] if out != html_col else []))
    place = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = pa.array([main_text(p) for p in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(out, StringType())]))

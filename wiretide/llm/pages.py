"""Main text of web pages by two passes of block rules.

First pass: markup says what is a menu, a notice or the article; elsewhere the density of stop words, the share of link
text and the length of a block decide, or leave it open. The density counts only on pages whose blocks show that the lists
fit their language, and not in tables, lists and code. Second pass: open blocks take the label of the nearest decided block.
Blocks keep the order of the page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wiretide.llm.common import text_batches

BATCH_BYTES = 4 << 20

# Frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset("""
the of and to in is that it was for on are as with they be at this have from or by not but what all were we when your can said there use an each
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind
le la les de des du et en un une est que qui dans pour pas sur au avec il elle ne se ce plus par sont mais ou comme nous vous leur
el la los las de del y en un una es que por con para no se su al lo como más pero sus le ya o este
""".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(script|style|title|noscript|template|textarea)\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"
    r"|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
#: Elements without main text, up to their end; one that is never closed hides nothing.
_EMBEDDED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("svg", "select", "iframe", "object")}

_BREAKING = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
_CONTAINERS = _BREAKING - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body", "li", "tr", "td", "th", "dt", "dd", "option"}
_DATA_TAGS = frozenset("table pre ul ol dl".split())
_BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
_BOILERPLATE_NAMES = frozenset("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
copyright disqus footer gdpr header menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related share sharing
sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget complementary contentinfo search dialog alert""".split())
#: What a name that only tells of boilerplate elsewhere begins with, and whose header or footer belongs to the text.
_STATES = frozenset("has no not with without is hide show".split())
_CONTENT_NAMES = frozenset("article content entry main page post story text".split())
_PARTS_OF_CONTENT = frozenset("header footer banner menu tags notice search toolbar".split())

#: Rules of the first pass.
LONG, SHORT, LINKS, MANY_STOP_WORDS, SOME_STOP_WORDS = 200, 70, 0.5, 0.25, 0.1
#: Most link text of a long block that is kept in a language without a list, and what a character of a script without spaces counts.
FEW_LINKS, DENSE = 0.2, 3


def _names_boilerplate(name: str, whole: bool) -> bool:
    """Whether a class, id or role tells of boilerplate, by the whole name or, but for ``whole``, by its first or last part."""
    if name.lower() in _BOILERPLATE_NAMES:
        return True
    parts = [part.lower() for part in _PART.findall(name)]
    if whole or not parts or parts[0] in _STATES:
        return False
    ends = {parts[0], parts[-1]} & _BOILERPLATE_NAMES
    return bool(ends - _PARTS_OF_CONTENT if parts[0] in _CONTENT_NAMES else ends)


def _boilerplate(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in _BOILERPLATE_TAGS or (tag == "header" and not inside_article):
        return True
    if not attributes:
        return False
    for found in _NAMES.finditer(attributes):
        value = found[1] or found[2] or found[3] or ""
        if any(_names_boilerplate(name, tag in ("article", "main")) for name in value.split()):
            return True
    return bool(_HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(text, characters inside links, place) of each block; the place is article, paragraph (of an article), outside, data (a table,
    list or code outside) or boilerplate."""
    found, parts, linked, links = [], [], 0, 0
    stack: list[tuple[str, str]] = []
    place, at, last_break, hidden, paragraph = "outside", 0, -2, 0, False
    ends: dict[str, int] = {}
    page = page.replace("\0", "")

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            found.append((text, min(linked, len(text)), "paragraph" if paragraph and place == "article" else place))
        parts, linked = [], 0

    def end_of(tag: str, begin: int) -> int:
        """Where an embedded element ends, its opening tag if nowhere; searched again only beyond the end found last."""
        if ends.get(tag, begin) <= begin:
            found_end = _EMBEDDED[tag].search(page, begin)
            ends[tag] = found_end.end() if found_end else len(page) + 1
        return begin if ends[tag] > len(page) else ends[tag]

    for token in _TOKEN.finditer(page):
        if token.start() < hidden:
            continue
        if token.start() > at:
            text = html.unescape(page[at:token.start()])
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(token[2] or token[5]), token[4] or token[7] or ""
        if tag in _EMBEDDED:
            if not closing and not attributes.endswith("/"):
                at = hidden = end_of(tag, at)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            if last_break == len(parts):  # an empty line ends a block
                close()
            parts.append(" ")
            last_break = len(parts)
        elif tag in _BREAKING or tag == "button":
            close()
            links, paragraph = 0, tag == "p" and not closing
            if tag == "body":
                stack, place = [], "outside"
            elif tag in _CONTAINERS or tag == "button":
                if closing:
                    if any(name == tag for name, _ in stack):
                        while stack.pop()[0] != tag:
                            pass
                else:
                    inner = place
                    if place != "boilerplate":
                        if _boilerplate(tag, attributes, place == "article"):
                            inner = "boilerplate"
                        elif tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main", attributes, re.I):
                            inner = "article"
                        elif tag in _DATA_TAGS and place == "outside":
                            inner = "data"
                    stack.append((tag, inner))
                place = stack[-1][1] if stack else "outside"
            elif not closing and attributes and place != "boilerplate" and _boilerplate(tag, attributes, True):
                # A paragraph, item or cell that is boilerplate by its own name, up to the next block
                parts, linked = [], 0
                stack.append((tag, "boilerplate"))
                place = "boilerplate"
                continue
            if closing and stack and stack[-1][0] == tag and tag not in _CONTAINERS:
                stack.pop()
                place = stack[-1][1] if stack else "outside"
            elif not closing and stack and stack[-1][0] not in _CONTAINERS and stack[-1][0] != "button" and tag in (stack[-1][0], "p", "div"):
                stack.pop()
                place = stack[-1][1] if stack else "outside"
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close()
    return found


def _length(text: str) -> int:
    return len(text) + (DENSE - 1) * sum(c >= "\u2e80" for c in text)


def _stop_words(text: str) -> float:
    words = text.lower().split()
    return sum(word.strip(".,;:!?()\"'") in STOP_WORDS for word in words) / len(words)


def lists_fit(found: list[tuple[str, int, str]]) -> bool:
    """Whether at least half of the text in longer blocks outside tables, lists and code (in them, if all are) has some stop words."""
    long = [(text, place) for text, linked, place in found if place in ("outside", "data") and linked <= LINKS * len(text) and _length(text) >= SHORT]
    texts = [text for text, place in long if place == "outside"] or [text for text, _ in long]
    return 2 * sum(_length(t) for t in texts if _stop_words(t) >= SOME_STOP_WORDS) >= sum(map(_length, texts))


def first_pass(text: str, linked: int, place: str, fit: bool = True) -> bool | None:
    """True for main text, False for boilerplate, None where only the neighbours can tell. ``fit`` is what lists_fit says of the page."""
    if place == "paragraph":
        return True
    if place == "boilerplate" or linked > LINKS * len(text):
        return False
    if place == "article":
        return True
    if (len(text) if fit else _length(text)) < SHORT:
        return False if linked else None
    stop_words = _stop_words(text)
    if stop_words >= MANY_STOP_WORDS:
        return True
    if stop_words >= SOME_STOP_WORDS:
        return True if len(text) >= LONG else None
    if fit:
        return None if place == "data" else False
    if not linked or (_length(text) >= LONG and linked <= FEW_LINKS * len(text)):
        return True
    return None


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    found = blocks(page or "")
    fit = lists_fit(found)
    labels = [first_pass(*block, fit) for block in found]
    inside = [place in ("article", "paragraph") for _, _, place in found]
    if any(label and own for label, own in zip(labels, inside)):
        labels = [label and own for label, own in zip(labels, inside)]
    decided = np.array([i for i, label in enumerate(labels) if label is not None], np.int64)
    kept = []
    for i, (text, _, _) in enumerate(found):
        label = labels[i]
        if label is None:
            if len(decided):
                k = int(np.searchsorted(decided, i))
                sides = decided[max(0, k - 1):k + 1]
                gaps = np.abs(sides - i)
                label = any(labels[s] for s in sides[gaps == gaps.min()])  # between equally near ones the text wins
            else:
                label = True
        if label:
            kept.append(text)
    return "\n".join(kept)


def _extracted(batches):
    for part in text_batches(batches, BATCH_BYTES, "html"):
        texts = [main_text(page) for page in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page, or one without main text, has an empty text. Repeated and missing page_ids keep their rows;
    a null url stays null; other columns are ignored.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")

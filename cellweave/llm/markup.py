"""Blocks of an HTML page: what the element structure says of each line of text.

A tolerant pass over the tags (unclosed, crossed and cut off elements are usual) splits a page into blocks of text and
gives each a zone: furniture that its element or its class names, text outside of any marked article, or text of the
article, in paragraphs or loose.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

FURNITURE, OUTSIDE, MAIN_LOOSE, MAIN_PARAGRAPH, ARTICLE_LOOSE, ARTICLE_PARAGRAPH = range(6)

# fixed values: element names of HTML and words that name page furniture in class, id and role attributes
SILENT = "script style title textarea noscript template svg iframe select object canvas head audio video math"
HARD = "nav aside footer dialog menu"
SOFT = "form button label fieldset"
VOID = "area base br col embed hr img input link meta param source track wbr"
PARAGRAPHS = "p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt tr figcaption"
BLOCKS = ("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt blockquote pre tr table thead tbody tfoot caption div section article main "
          "nav aside header footer form fieldset figure figcaption address details summary hr body html dialog menu hgroup center")
INLINE = "a b i em strong code u s small sub sup q cite abbr mark font tt kbd var time br wbr html body main"
HARD_WORDS = ("comment comments commentlist reply replies respond disqus discussion nav navbar navigation navigational breadcrumb "
              "breadcrumbs sidebar aside complementary contentinfo footer related recommended recommendations ad ads adv advert adverts "
              "advertisement advertising adsense adslot sponsor sponsored promo promoted promotion cookie cookies consent gdpr popup "
              "newsletter masthead topbar dialog alertdialog")
SOFT_WORDS = ("menu menubar submenu pagination pager banner notice notices notification alert modal overlay subscribe subscription "
              "signup login share sharing social widget widgets toolbar form search skip copyright disclaimer hidden")
ARTICLE_WORDS = ("comment comments reply replies ad ads advert adverts advertisement sponsor sponsored promo promoted promotion related "
                 "recommended")
NOT_WORDS = "no with has have without non not is layout"

_SET = {name: frozenset(value.split()) for name, value in dict(
    hard=HARD, soft=SOFT, void=VOID, paragraphs=PARAGRAPHS, blocks=BLOCKS, inline=INLINE, hard_words=HARD_WORDS,
    soft_words=SOFT_WORDS, article_words=ARTICLE_WORDS, not_words=NOT_WORDS).items()}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<silent>{SILENT.replace(' ', '|')})(?=[\s/>])[^>]*(?:>.*?(?:</(?P=silent)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element(NamedTuple):
    name: str
    block: bool
    hard: int
    soft: int
    header: int
    heading: int
    article: int
    paragraph: int
    zone: int


_TOP = Element("", True, 0, 0, 0, 0, 0, 0, OUTSIDE)


def _words(value: str) -> set[str]:
    """The words of a class, id or role value; words such as no-sidebar speak of what isn't there."""
    found: set[str] = set()
    for part in value.split():
        words = [w.lower() for w in _WORD.findall(part)]
        if words and words[0] not in _SET["not_words"]:
            found.update(words)
    return found


def _opened(name: str, rest: str, at: Element) -> Element:
    """What holds inside an element that opens at ``at``."""
    hard, soft, header, heading, article, paragraph = at.hard, at.soft, at.header, at.heading, at.article, at.paragraph
    named: set[str] = set()
    role = ""
    body = False
    if "=" in rest or "hidden" in rest:
        for key, *values in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id"):
                named |= _words(value)
            elif key == "role":
                role = value.strip().lower()
                named |= _words(value)
            elif key == "itemprop":
                body = "articlebody" in value.lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                hard += 1
    whole = 2 if name == "article" or role == "article" or body else 1 if name == "main" or role == "main" else 0
    if whole:
        soft, article = 0, max(article, whole)
        hard += bool(named & _SET["article_words"])
    elif name not in _SET["inline"]:
        hard += name in _SET["hard"] or bool(named & _SET["hard_words"])
        soft += name in _SET["soft"] or bool(named & _SET["soft_words"])
        header += name == "header" or "header" in named and name not in _SET["paragraphs"]
    heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
    paragraph += bool(article) and name in _SET["paragraphs"]
    if hard or soft or header and not (article and heading):
        zone = FURNITURE
    else:
        zone = OUTSIDE if not article else (MAIN_LOOSE if article == 1 else ARTICLE_LOOSE) + bool(paragraph)
    return Element(name, name in _SET["blocks"], hard, soft, header, heading, article, paragraph, zone)


_plain = lru_cache(4096)(lambda name, at: _opened(name, "", at))


def blocks(html: str | None) -> tuple[list[tuple[str, int]], int]:
    """(text, zone) of every block with text, in page order, and the kind of article marks: 2 article, 1 main, 0 none.

    Character references are decoded, white space inside a block is one space, blocks are trimmed.
    """
    out: list[tuple[str, int]] = []
    stack = [_TOP]
    held: dict[int, list[str]] = {}
    marked, at = 0, 0
    html = html or ""

    def text(raw: str) -> None:
        if raw and (held or not raw.isspace()):
            held.setdefault(stack[-1].zone, []).append(unescape(raw) if "&" in raw else raw)

    def flush() -> None:
        for zone, parts in held.items():
            line = " ".join("".join(parts).split())
            if line:
                out.append((line, zone))
        held.clear()

    def close(name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == name:
                if held and any(e.block for e in stack[depth:]):
                    flush()
                del stack[depth:]
                return

    def ends(name: str, within: tuple[str, ...]) -> None:
        """An element that the next of its kind ends, unless one of ``within`` stands between."""
        for element in reversed(stack):
            if element.name == name:
                return close(name)
            if element.name in within:
                return

    for token in _TOKEN.finditer(html):
        first, last = token.span()
        if first > at:
            text(html[at:first])
        at = last
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        if token["end"]:
            if held and name in _SET["blocks"]:
                flush()
            close(name)
            continue
        if name in ("br", "td", "th", "option"):
            held.setdefault(stack[-1].zone, []).append(" ")
        if name in _SET["blocks"]:
            if held:
                flush()
            ends("p", ("td", "th", "div", "section", "article", "li", "body", "blockquote", "main", "nav", "aside", "header", "footer", "form"))
            if name == "li":
                ends("li", ("ul", "ol", "menu"))
            elif name in ("dd", "dt"):
                ends("dd", ("dl",))
                ends("dt", ("dl",))
            elif name == "tr":
                ends("tr", ("table",))
        if name not in _SET["void"] and not token["rest"].endswith("/"):
            rest = token["rest"].strip()
            stack.append(_opened(name, rest, stack[-1]) if rest else _plain(name, stack[-1]))
            if not stack[-1].hard:
                marked = max(marked, stack[-1].article)
    text(html[at:])
    flush()
    return out, marked

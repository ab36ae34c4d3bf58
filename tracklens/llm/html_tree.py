"""A page's elements and text blocks in page order, from markup as it is found: unclosed, unquoted or cut off."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's element kinds, and words that sites use to name what is not the article.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "fieldset", "details", "dialog", "menu", "figure", "center"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "address", "figcaption", "caption", "summary", "hr", "legend", "hgroup", "search"}
#: An opening tag ends these if they are open above the nearest container.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "head"}
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login paywall sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar "
    "comment comments disqus replies respond share sharing social related recommended recommendations trending widget search skip".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}


@dataclass
class Element:
    """An element that may hold blocks. id names its path: the same on all pages."""

    tag: str
    id: int
    up: Element | None
    marked: bool  # not the article, by its tag or name or those around it
    article: bool  # it or one around it says that it is the article


@dataclass
class Block:
    element: Element
    text: str
    words: int
    linked: int

    @property
    def id(self) -> int:
        return xxhash.xxh64_intdigest(self.text.encode("utf-8", "surrogatepass"), self.element.id & 0xFFFFFFFF) ^ 1


@dataclass
class Page:
    items: list[Element | Block] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def _element(tag: str, found: dict[str, str], up: Element | None) -> Element:
    named = [found.get("class", ""), found.get("id", "")]
    kind = " ".join(sorted(x for n in named for x in n.split() if not re.search(r"\d", x)))
    in_article = bool(up and up.article)
    own = tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
    parts = {p.lower() for n in named for p in _PART.findall(n)}
    if tag in ("html", "body", "main"):
        parts = set()
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    marked = bool(up and up.marked) or tag in OUTSIDE or bool(parts & MARKS) or found.get("role") in ROLES or hidden
    marked |= not in_article and (tag == "header" or "header" in parts)
    seed = up.id if up else 0
    return Element(tag, xxhash.xxh64_intdigest(f"{tag}.{kind}", seed), up, marked, in_article or own)


def parse(html: str | None) -> list[Element | Block]:
    """Elements (opened) and blocks (ended) in page order; texts have their references decoded and white space joined."""
    out: list[Element | Block] = []
    root = Element("", 0, None, False, False)
    stack: list[Element] = [root]
    pieces: list[tuple[str, bool]] = []
    link, at, html = False, 0, html or ""

    def flush() -> None:
        if pieces:
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                out.append(Block(stack[-1], text, text.count(" ") + 1, sum(len(t.split()) for t, k in pieces if k)))
            pieces.clear()

    def end(k: int) -> None:
        flush()
        del stack[k:]

    while at < len(html):
        lt = html.find("<", at)
        lt = len(html) if lt < 0 else lt
        if lt > at:
            pieces.append((unescape(html[at:lt]), link))
        if lt == len(html):
            break
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = len(html) if close < 0 else close + 3
            continue
        follows = html[lt + 1 : lt + 3]
        if follows[:1] in ("!", "?"):
            close = html.find(">", lt)
            at = len(html) if close < 0 else close + 1
            continue
        m = (_TAG.match(html, lt) or _LOOSE.match(html, lt)) if follows.strip("/")[:1].isalpha() else None
        if m is None:  # a bare "<", or a tag that the end of the page cuts off
            if follows.strip("/")[:1].isalpha():
                break
            pieces.append(("<", link))
            at = lt + 1
            continue
        at, tag, opens = m.end(), m[1].lower(), html[lt + 1] != "/"
        if opens and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = len(html) if close is None else close.end()
        elif tag == "a":
            link = opens
        elif tag == "br":
            pieces.append(("\n", link))
        elif tag in BLOCKS or tag in OUTSIDE:
            flush()
            link = link and opens
            if opens:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ENDS.get(tag, {"p"}):
                        end(k)
                        if tag not in ENDS:
                            break
                    elif stack[k].tag in CONTAINERS and not (tag == "tr" and stack[k].tag == "tr"):
                        break
                if tag not in VOID:
                    found = _attributes(m[2])
                    made = _element(tag, found, stack[-1])
                    stack.append(made)
                    if tag in CONTAINERS or tag in OUTSIDE:
                        out.append(made)
                    else:  # a block's text belongs to its container, unless it is marked itself
                        stack[-1] = Element(tag, stack[-2].id, stack[-2].up, made.marked, made.article)
            else:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), None)
                if k:
                    end(k)
    flush()
    return out

"""A page's markup cut into blocks of text, each named by where it stands."""

from __future__ import annotations

import html as entities
import re

#: Own lists: what the tags, roles and class names of pages say about their text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
NOISE = frozenset("nav header footer aside menu dialog svg canvas math object video audio select datalist button label fieldset legend".split())
NOISE_ROLES = frozenset("navigation banner contentinfo search complementary dialog alert alertdialog menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header menu modal nav navbar"
    " navigation newsletter notice pager pagination popup promo recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"thead", "tr", "td", "th"}}

#: A tag ends at the first > outside a quoted value; quotes count after an equals sign only. Possessive: no text makes it go back.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])([^\s\"'<>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.S)
NAME = re.compile(r"[a-z]+")

#: What a block is: text of the article, text that markup says nothing about, text that markup or a name says is not of the article.
CONTENT, OPEN, NOISY = 0, 1, 2
DEEPEST = 4


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", ATTRIBUTE.sub(" ", text)) or "hidden" in out:
        out["hidden"] = "hidden"
    return out


def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


_CLOSING = {name: _closing(name) for name in RAW}


class _Element:
    __slots__ = ("tag", "strong", "weak", "article", "main", "label")

    def __init__(self, tag: str, inner: str, parent: _Element | None):
        given = _attributes(inner) if inner.strip(" /") else {}
        self.tag = tag
        self.article = tag == "article" or bool(parent and parent.article)
        self.main = tag == "main" or given.get("role", "").lower() == "main" or bool(parent and parent.main)
        self.strong = tag in NOISE or given.get("role", "").lower() in NOISE_ROLES or "hidden" in given or bool(parent and parent.strong)
        if tag in ("html", "body", "article", "main"):
            self.weak = False  # a named wrapper or a form around the article is no reason to drop it
        else:
            named = set(NAME.findall(f"{given.get('class', '')} {given.get('id', '')}".lower()))
            self.weak = tag == "form" or bool(named & NOISE_NAMES) or bool(parent and parent.weak)
        own = tag + "".join(f".{x}" for x in sorted(set(NAME.findall(given.get("class", "").lower()))))
        self.label = ">".join([*(parent.label.split(">")[1 - DEEPEST :] if parent else []), own])


def blocks(html: str) -> list[tuple[int, str, str]]:
    """(what, path, text) of each block that has text, in page order. A block is the text between starts and ends of elements other than inline ones;
    white space in it is one blank, a br too, and character references are resolved. Elements that are never closed end with an ancestor or with the page."""
    stack: list[_Element] = []
    out: list[tuple[bool, bool, bool, str, str]] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                at = stack[-1] if stack else None
                out.append((bool(at and at.article), bool(at and at.main), bool(at and (at.strong or at.weak)), at.label if at else "", text))

    at = 0
    while (found := TAG.search(html, at)) is not None:
        if found.start() > at:
            parts.append(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    parts.append(" ")
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = _CLOSING[tag].search(html, at)
            at = end.end() if end else len(html)
            parts.append(" ")
            continue
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag == "body":
            stack.clear()
        if tag in ENDS_P and stack and stack[-1].tag == "p":
            stack.pop()
        if tag in SIBLINGS:
            if stack and stack[-1].tag == "p" and len(stack) > 1 and stack[-2].tag in SIBLINGS[tag]:
                stack.pop()
            while stack and stack[-1].tag in SIBLINGS[tag]:
                stack.pop()
        if not found[3].rstrip().endswith("/") or tag not in ("svg", "object"):
            stack.append(_Element(tag, found[3], stack[-1] if stack else None))
    parts.append(html[at:])
    flush()
    by_article = any(article and not noise for article, _, noise, _, _ in out)
    by_main = not by_article and any(main and not noise for _, main, noise, _, _ in out)
    return [(NOISY if noise else CONTENT if (article if by_article else main and by_main) else OPEN, path, text) for article, main, noise, path, text in out]

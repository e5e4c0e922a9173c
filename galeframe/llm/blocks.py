"""Pages cut into leaf blocks: the text between two block-level tags, with its tag path."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|annotation(?:-xml)?|iframe|textarea|select|title|canvas|video|audio|head(?=[\s>]))\b(?P<head>[^>]*)>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    # Values in quotes, which open after the equals sign only, may hold >; others end there.
    r"(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+)>?",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Tags that do not end a block (fixed by HTML); all others do.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math object param q ruby rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
# Tags without content (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag ends these open ones (fixed by HTML): tag -> (ended, kept within).
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# Tags that cannot stand in a formula and end an unclosed one.
_ENDS_FORMULA = frozenset("article body div footer h1 h2 h3 h4 h5 h6 header li main nav ol p section table td tr ul".split())


@dataclass(slots=True)
class Leaf:
    path: tuple[str, ...]  # open elements, outermost first, each with its names
    text: str
    linked: int  # characters inside links


def _element(tag: str, rest: str) -> str:
    """The tag and the parts of its class, id and role."""
    if "=" not in rest and "hidden" not in rest.lower():
        return tag
    names = {p.lower() for m in _NAMES.finditer(rest) for p in _PART.findall(m[1] or m[2] or m[3] or "")}
    if _HIDDEN.search(rest):
        names.add("hidden")
    return " ".join([tag, *sorted(names)])


def leaves(page: str) -> list[Leaf]:
    """Leaf blocks of a page in order.

    Character references are decoded and white space becomes single spaces.  Formulas and
    the text inside objects belong to the block around them.  No text comes from scripts,
    styles, templates, markup comments and the head, from drawings (svg), the contents of
    form fields (textarea, select) and what is shown only if a part cannot be (noscript,
    iframe, canvas, video, audio, annotations of formulas).
    """
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked = links = formulas = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Leaf(tuple(e for _, e in stack if e), text, linked))
            held.clear()
        linked = 0

    at, lower, length = 0, "", len(page)
    while at < length:
        match = _MARKUP.search(page, at)
        if match is None:
            held.append(page[at:])
            break
        if match.start() > at:
            piece = page[at : match.start()]
            held.append(piece)
            if links:
                linked += len(piece)
        at = match.end()
        if match["raw"]:
            name = match["raw"].lower()
            if name != "head" and match["head"].rstrip().endswith("/"):
                continue
            lower = lower or page.lower()
            end = lower.find(f"</{name}", at)
            if name == "head":
                body = lower.find("<body", at)
                end = min(x for x in (end, body, length) if x >= 0)
                at = end
            elif end < 0:
                at = length if name in ("script", "style") else at
            else:
                at = page.find(">", end) + 1 or length
            continue
        if not match["tag"]:
            continue
        tag = match["tag"].lower()
        if tag == "br":
            held.append(" ")
        elif tag in INLINE or formulas:
            if tag == "math":
                formulas = max(0, formulas + (-1 if match["close"] else 0 if match["rest"].endswith("/") else 1))
            elif formulas and tag in _ENDS_FORMULA:
                formulas = 0
                at = match.start()
            if tag == "a":
                links = max(0, links + (-1 if match["close"] else 1))
        elif match["close"]:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    links = 0
                    break
        else:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _ENDS:
                ended, within = _ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in within:
                        break
                    if stack[k][0] in ended:
                        del stack[k:]
            if tag not in VOID and not match["rest"].rstrip().endswith("/"):
                stack.append((tag, _element(tag, match["rest"]) if tag not in ("html", "body") else ""))
    flush()
    return out

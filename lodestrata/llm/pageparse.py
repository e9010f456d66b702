"""Pages as sequences of leaf blocks: their text, the path of elements above them, and the share of text in links."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that stand in running text, those whose content is never shown, and those that have none.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br picture source svg path".split())
UNSEEN = frozenset("script style noscript template head title textarea svg math iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes when it stands open: paragraphs end before any block, items before the next item.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: float


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path: its name and the words of its class, id and role."""
    if not attributes:
        return (name,)
    words = (w.lower() for m in _NAMES.finditer(attributes) for w in _WORDS.findall(m[2] or m[3] or m[4] or ""))
    return (name, *dict.fromkeys(f".{w}" for w in words))


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order: text between the bounds of block elements, references decoded, white space as one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = 0
    link_chars = 0
    at = 0

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(m for _, marks in stack for m in marks), min(1.0, link_chars / max(1, len(text)))))
            parts = []
        link_chars = 0

    def take(text: str) -> None:
        nonlocal link_chars
        if text:
            parts.append(text)
            if links:
                link_chars += len(text)

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE:
                links -= links > 0 and name == "a"
                continue
            flush()
            links = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in UNSEEN:
            if m[3].endswith("/"):
                continue
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            # A head that is never closed ends where the body begins.
            if name == "head":
                body = re.compile(r"<body\b", re.I).search(page, at)
                if body and (not stop or body.start() < stop.start()):
                    at = body.start()
                    continue
            if name != "svg":
                flush()
            at = stop.end() if stop else len(page)
            continue
        if name in INLINE:
            links += name == "a"
            if name == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if stack and stack[-1][0] == "p":
            stack.pop()
        closes = SIBLINGS.get(name)
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CONTAINERS and stack[i][0] not in closes:
                    break
                if stack[i][0] in closes:
                    del stack[i:]
                    break
        if name not in VOID and not m[3].endswith("/"):
            stack.append((name, _marks(name, m[3])))
    flush()
    return out

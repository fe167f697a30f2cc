"""Leaf blocks of an HTML page: their text, and the elements that they stand in.

A forgiving reader: unknown, unclosed and wrongly nested tags are taken as browsers roughly do
(a paragraph ends where the next block begins; an end tag closes up to its start, or nothing).
Scripts, styles, comments and the head hold no text. Character references are decoded, and white
space within a block becomes one space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp "
                    "small span strike strong sub sup time tt u var wbr "
                    "math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow "
                    "ms msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover "
                    "semantics".split())
#: `annotation` repeats a formula in another notation.
_SILENT = frozenset("script style template svg object annotation annotation-xml".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in _SILENT}
_HEAD = frozenset(["head", "title"])
#: Elements that may stand in a head; any other start tag, or text, ends it.
_IN_HEAD = frozenset("title meta link style script base noscript template head html".split())
#: Elements that end an open element of the same kind, and the elements that hold them together.
_ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th",
         "th": "td th", "option": "option"}
_HOLDS = frozenset("article aside blockquote body div dl fieldset figure footer form header html "
                   "main nav ol section table tbody td th ul".split())


@dataclass
class Block:
    text: str
    #: Names of the elements around it, from the outermost, without inline ones; and names in
    #: the attributes of all of them.
    tags: tuple[str, ...]
    names: tuple[str, ...]
    #: Share of the text in links.
    links: float


def blocks_of(html: str) -> list[Block]:
    """The leaf blocks with text, in the order of the page."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    where: tuple | None = None
    linked, size = 0, 0

    def flush() -> None:
        nonlocal where, linked, size
        if where is not None:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(t for t, _ in where if t not in _INLINE), tuple(
                    n for _, names in where for n in names), linked / max(size, 1)))
        parts.clear()
        where, linked, size = None, 0, 0

    def close(upto: int) -> None:
        del stack[upto:]

    def leave_head() -> None:
        """A head that was never closed ends here."""
        for i, (t, _) in enumerate(stack):
            if t == "head" and all(u not in ("title", "noscript") for u, _ in stack[i:]):
                del stack[i]
                break

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            piece = m[0]
            if piece.startswith(("<!", "<?")):
                continue
            if not piece.isspace():
                leave_head()
            if any(t in _HEAD for t, _ in stack):
                continue
            if where is None and not piece.isspace():
                where = tuple(stack)
            parts.append(piece)
            size += len(piece)
            if any(t == "a" for t, _ in stack):
                linked += len(piece)
            continue
        tag = tag.lower()
        rest = m["rest"] if m["tag"] else m["rest2"]
        if m["end"] or m["end2"]:
            if tag not in _INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break                       # an inline end tag closes no block
            continue
        if tag not in _IN_HEAD:
            leave_head()
        if tag in _SILENT:
            if not rest.rstrip().endswith("/"):
                found = _END[tag].search(html, at)
                stop = html.find(">", found.end()) if found else end
                at = end if stop < 0 else min(stop + 1, end)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            if tag == "body":                   # a head that was never closed ends here
                stack[:] = [s for s in stack if s[0] not in _HEAD]
            ends = _ENDS.get(tag, "p").split()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in _HOLDS and stack[i][0] not in ends:
                    break
        names = tuple(n for a in _ATTRIBUTE.finditer(rest)
                      for n in _NAME.findall((a[2] or a[3] or a[4] or "").lower()))
        if not rest.endswith("/") or tag not in ("div", "span", "p"):
            stack.append((tag, names))
    flush()
    return out

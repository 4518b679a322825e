"""A page as flat arrays of its nodes, in page order: elements, and blocks of text as leaves."""

from __future__ import annotations

import html
import re
from collections import Counter

# Fixed values of HTML: elements without content, with raw content, that break the line, and that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea select title head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SELF_ENDING = {"p": BLOCK - {"html", "body", "td", "th", "tr", "caption", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
_ENDS = {t: frozenset(k for k, v in _SELF_ENDING.items() if t in v) for t in BLOCK}
#: An open li, p or cell is only ended inside the nearest of these.
_SCOPE = {"p": BLOCK - {"p"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"form"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}
_HEAD_END = re.compile(r"</head(?=[\s/>])[^>]*>|<(?=(?:body|div|p|article|main|header|nav|h1|table|section)[\s>])", re.I)
#: Elements whose text is not of the lines around it.
LINES = BLOCK | {"noscript"}


class Page:
    """parent, tag, attributes, depth of each node (a text block has tag '#'); text and the letters under links of blocks."""

    __slots__ = ("parent", "tag", "attrs", "depth", "text", "linked", "end")

    def __init__(self, source: str | None):
        self.parent, self.tag, self.attrs, self.depth = [-1], ["root"], [""], [0]
        self.text, self.linked, self.end = [""], [0], []
        stack, open_ = [0], Counter()
        held: list[str] = []
        linked = links = 0
        at, s = 0, source or ""

        def flush() -> None:
            nonlocal held, linked
            if held:
                line = " ".join(html.unescape("".join(held)).split())
                if line:
                    self._add("#", "", stack[-1 if len(stack) == 1 else self._owner(stack)], line, min(linked, len(line)))
                held, linked = [], 0

        def keep(part: str) -> None:
            nonlocal linked
            if part:
                held.append(part)
                if links:
                    linked += len(part.strip())

        def close(k: int) -> None:
            open_.subtract(self.tag[x] for x in stack[k:])
            del stack[k:]

        while m := _TAG.search(s, at):
            keep(s[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing = name.lower(), bool(m[1] or m[4])
            if closing:
                if name in LINES or name == "br":
                    flush()
                if not open_[name]:
                    continue
                if name == "a":
                    links = max(0, links - 1)
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[k]]
                    if tag == name:
                        close(k)
                        break
                    if name not in BLOCK and tag in BLOCK or name == "p" and tag in _SCOPE["p"]:
                        break  # an inline end tag doesn't end a block
                continue
            attrs = m[3] or m[6] or ""
            if name in RAW:
                if name == "head":
                    e = _HEAD_END.search(s, at)
                    at = e.end() if e and e[0][1:2] == "/" else e.start() if e else at
                elif not attrs.endswith("/"):
                    e = _RAW_END[name].search(s, at)
                    at = e.end() if e else len(s) if name in ("script", "style", "textarea") else at
                continue
            if name in LINES or name == "br":
                flush()
                for old in _ENDS.get(name, ()):
                    if not open_[old]:
                        continue
                    for k in range(len(stack) - 1, 0, -1):
                        tag = self.tag[stack[k]]
                        if tag == old:
                            if any(self.tag[x] == "a" for x in stack[k:]):
                                links = 0
                            close(k)
                            break
                        if tag in _SCOPE[old]:
                            break
            if name in VOID or attrs.endswith("/") and name not in BLOCK:
                continue
            if name == "a":
                links = 1
            stack.append(self._add(name, attrs, stack[-1], "", 0))
            open_[name] += 1
        keep(s[at:])
        flush()
        n = len(self.parent)
        self.end = [0] * n
        for k in range(n - 1, -1, -1):
            self.end[k] = self.end[k] or k + 1
            if (p := self.parent[k]) >= 0:
                self.end[p] = max(self.end[p], self.end[k])

    def _owner(self, stack: list[int]) -> int:
        """Place in the stack of the nearest element that breaks the line."""
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in LINES:
                return k
        return 0

    def _add(self, tag: str, attrs: str, parent: int, text: str, linked: int) -> int:
        self.parent.append(parent), self.tag.append(tag), self.attrs.append(attrs), self.depth.append(self.depth[parent] + 1)
        self.text.append(text), self.linked.append(linked)
        return len(self.parent) - 1

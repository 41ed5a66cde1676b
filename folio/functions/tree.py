"""HTML as a flat tree: a scan over tags folded to the elements that are open, for markup as it is found.

Nodes stand in document order, each with where its subtree ends, so that a subtree is a slice, its text a join over that slice, and
a walk a scan with jumps. End tags without an open element are passed over, missing ones are put where the next element or
the end of a parent asks for them; a kind nests within itself wherever it may. No step recurses; as at most MOST_OPEN elements are
open at once (deeper ones stand beside each other, as in browsers), all are linear in the markup.
"""

from __future__ import annotations

import re
from html import unescape

# Elements without content, those whose content is text, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
MOST_OPEN = 512
#: What an element ends when it starts, and the elements beyond which it doesn't look.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS |= {part: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for part in ("thead", "tbody", "tfoot")}
#: An end tag from within these doesn't reach out of them, but for their own family's.
CELLS = frozenset("td th caption".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_LINE_ENDS, _BLANKS, _AROUND, _MANY = re.compile("\r\n?"), re.compile("[ \t ]+"), re.compile(" *\n *"), re.compile("\n{3,}")


def normal(text: str) -> str:
    """Line ends as LF, runs of blanks as one, none beside LF, at most one empty line; the same as the column function."""
    text = _AROUND.sub("\n", _BLANKS.sub(" ", _LINE_ENDS.sub("\n", text)))
    return _MANY.sub("\n\n", text).strip(" \n")


class Tree:
    """tag of each node ('' for text), its value (an element's attributes as they stand, or a text), and the end of its subtree."""

    def __init__(self, html: str):
        self.tag, self.value, self.end = [""], [""], [0]
        open_ = [0]
        at, size = 0, len(html)
        while at < size:
            found = _TOKEN.search(html, at)
            self._text(html[at : found.start() if found else size])
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                self._close(open_, name)
                continue
            self._make_room(open_, name)
            here = self._add(name, found[3])
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                self._text(html[at : stop.start() if stop else size], name in ("textarea", "title"))
                self.end[here] = len(self.tag)
                at = stop.start() if stop else size
            elif name not in VOID and len(open_) < MOST_OPEN and not (found[3].endswith("/") and self._foreign(open_)):
                open_.append(here)
        self._pop_to(open_, 0)
        self.end[0] = len(self.tag)

    def _add(self, tag: str, value: str) -> int:
        self.tag.append(tag)
        self.value.append(value)
        self.end.append(len(self.tag))
        return len(self.tag) - 1

    def _text(self, text: str, decode: bool = True) -> None:
        if text:
            self._add("", unescape(text) if decode and "&" in text else text)

    def _pop_to(self, open_: list[int], depth: int) -> None:
        for node in open_[max(1, depth) :]:
            self.end[node] = len(self.tag)
        del open_[max(1, depth) :]

    def _foreign(self, open_: list[int]) -> bool:
        return any(self.tag[k] in ("math", "svg") for k in open_)

    def _close(self, open_: list[int], name: str) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[depth]]
            if tag == name:
                return self._pop_to(open_, depth)
            if tag in CELLS and name not in TABLE:
                return None
        return None

    def _make_room(self, open_: list[int], name: str) -> None:
        """Ends what can't hold the element that starts."""
        if name in ENDS:
            ended, bounds = ENDS[name]
            for depth in range(len(open_) - 1, 0, -1):
                tag = self.tag[open_[depth]]
                if tag in bounds or (tag == "table" and name not in TABLE):
                    break
                if tag in ended:
                    self._pop_to(open_, depth)
                    if name in ("li", "dt", "dd", "option"):
                        break
        if name in BLOCK:
            for depth in range(len(open_) - 1, 0, -1):
                tag = self.tag[open_[depth]]
                if tag == "p":
                    self._pop_to(open_, depth)
                    break
                if tag in CELLS or tag in ("table", "button"):
                    break
            if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.tag[open_[-1]]):
                self._pop_to(open_, len(open_) - 1)

    def attributes(self, node: int) -> dict[str, str]:
        return {name.lower(): unescape(a or b or c) for name, a, b, c in reversed(_ATTRIBUTE.findall(self.value[node]))}

    def inside(self, node: int, *tags: str) -> list[int]:
        """Elements of these kinds below a node, in document order."""
        return [k for k in range(node + 1, self.end[node]) if self.tag[k] in tags]

    def text(self, node: int, without: frozenset[str] = frozenset()) -> str:
        out, k = [], node + 1
        while k < self.end[node]:
            if self.tag[k] in without:
                k = self.end[k]
                continue
            if not self.tag[k]:
                out.append(self.value[k])
            k += 1
        return "".join(out)

"""A lenient reader of HTML into flat lists: block elements as nodes of a tree, and the pieces of text with their node and line.

End tags may be missing or unmatched; a block start ends an open paragraph, an item ends the item before it. Elements nested
deeper than ``MOST_DEPTH`` become siblings at that depth, as in browsers (inline ones are passed over). Scripts, styles and other raw text give no text; an
element that isn't closed goes on to the end. Work is linear in the length of a page but for tags with thousands of quotes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

MOST_DEPTH = 512
# Elements by how HTML treats them.
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp template svg math object audio video canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
_CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SAME_LEVEL |= {x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for x in ("thead", "tbody", "tfoot")}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*'){0,4000}+)>|([^>]*)(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Attributes that are read; the values of others are skipped.
READ = ("class", "id", "role", "itemprop", "aria-label", "aria-hidden", "hidden", "style", "data-label")


@dataclass
class Dom:
    """Nodes in page order; a parent comes before its children. Node 0 stands for the page."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    attrs: list[dict[str, str]] = field(default_factory=lambda: [{}])
    #: (node, line, inside a link, text); a line is what stands between two borders of blocks.
    pieces: list[tuple[int, int, bool, str]] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        name = name.lower()
        if name in READ and name not in out:
            out[name] = a or b or c
    return out


def read(source: str, wanted=lambda tag, attrs: False) -> Dom:  # noqa: ANN001
    """``wanted``: whether an inline element with attributes is a node of its own."""
    dom = Dom()
    open_tags: list[tuple[str, int, bool]] = []  # name, node, whether it is one
    node, line, links = 0, 0, 0

    def text(begin: int, to: int) -> None:
        if begin < to:
            part = source[begin:to]
            dom.pieces.append((node, line, links > 0, html.unescape(part) if "&" in part else part))

    def close(n: int) -> None:
        """Leave the innermost elements down to ``n`` open ones."""
        nonlocal node, line, links
        while len(open_tags) > n:
            name, parent, _ = open_tags.pop()
            if name in BLOCK:
                line += 1
            if name == "a":
                links -= 1
            node = parent

    def find(names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> int:
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i][0] in names:
                return i
            if open_tags[i][0] in stops:
                break
        return -1

    pos, end = 0, len(source)
    while pos < end:
        m = _TOKEN.search(source, pos)
        if m is None:
            break
        text(pos, m.start())
        pos = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            inline = name not in BLOCK
            i = find({name}, BLOCK if inline else {"table"} if name in ("td", "th", "tr") else {"ul", "ol"} if name == "li" else frozenset())
            if i >= 0:
                close(i)
            continue
        source_attrs = m[3] if m[3] is not None else m[4] or ""
        if name in RAW and not source_attrs.endswith("/"):
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, pos)
            shut = source.find(">", stop.end()) if stop else -1
            pos = end if shut < 0 else shut + 1
            continue
        if name in _CLOSES_P and (i := find({"p"}, BLOCK - {"p"})) >= 0:
            close(i)
        if name in _SAME_LEVEL and (i := find(*_SAME_LEVEL[name])) >= 0:
            close(i)
        if name in ("br", "wbr", "img", "input"):
            if name != "wbr":
                dom.pieces.append((node, line, False, " "))
            continue
        if name in VOID:
            line += name == "hr"
            continue
        if name in ("html", "body") and find({name}, frozenset()) >= 0:
            continue
        attrs = attributes(source_attrs) if "=" in source_attrs or "hidden" in source_attrs else {}
        is_node = name in BLOCK or (bool(attrs) and wanted(name, attrs))
        if name in BLOCK:
            line += 1
        if name not in BLOCK and (source_attrs.endswith("/") or len(open_tags) >= 2 * MOST_DEPTH):
            continue
        if is_node and dom.depths[node] >= MOST_DEPTH:
            close(len(open_tags) - 1 - next(k for k, x in enumerate(reversed(open_tags)) if x[2]))
        open_tags.append((name, node, is_node))
        if name == "a":
            links += 1
        if is_node:
            dom.tags.append(name)
            dom.parents.append(node)
            dom.depths.append(dom.depths[node] + 1)
            dom.attrs.append(attrs)
            node = len(dom.tags) - 1
    text(pos, end)
    return dom


def lines(dom: Dom, kept) -> str:  # noqa: ANN001
    """The text of the kept nodes: white space within a line is one space, lines that aren't empty are joined by line feeds."""
    out: list[str] = []
    held: list[str] = []
    now = -1
    for node, line, _, part in dom.pieces:
        if line != now:
            if held:
                out.append(" ".join("".join(held).split()))
                held = []
            now = line
        if kept[node]:
            held.append(part)
    out.append(" ".join("".join(held).split()))
    return "\n".join(x for x in out if x)

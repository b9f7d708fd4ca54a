"""A small HTML tokeniser that yields a tree of elements and the text between them.

It takes time in proportion to the page: where each name is open is kept in a table, so no end tag
searches the open elements, and no tag is read twice.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"']+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element names of the HTML standard by how they nest and lay out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = set("script style textarea title noscript iframe noembed noframes template xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
FRAME = {"#root", "html", "body"}
DEEPEST = 512  # what nests deeper lies side by side in the element of this depth, as in browsers


@dataclass
class Tree:
    """Elements in page order, and text runs as (element, block number, text).

    Elements are all block elements, and inline ones that carry a class, id, role or a mark that hides them.
    Text right in the page's frame (body, or no element at all) gets an element ``#text`` for each block.
    """

    tags: list[str] = field(default_factory=lambda: ["#root"])
    marks: list[str] = field(default_factory=lambda: [""])  # class, id and role, lower-cased
    hidden: list[bool] = field(default_factory=lambda: [False])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    texts: list[tuple[int, int, str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=lambda: [0])  # characters within links, by element


def _marks(attributes: str) -> tuple[str, bool]:
    """The words that mark an element, and whether it is not shown."""
    words, hidden = [], False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = html.unescape(a or b or c).strip()
        if name == "style":
            hidden |= _INVISIBLE.search(value) is not None
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "hidden":
            hidden |= value.lower() != "false"
        elif value:
            words.append(value.lower())
    return " ".join(words), hidden


def parse(page: str) -> Tree:
    """Read a page; unclosed and stray tags are handled as browsers commonly do."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", 0)]  # names, and the element that each is in
    open_at: dict[str, list[int]] = {}  # places in the stack by name
    blocks = [0]  # places in the stack of what is not inline
    block, links, at = 0, 0, 0
    loose, loose_block = 0, -1  # the last #text element and its block

    def text(run: str) -> None:
        nonlocal loose, loose_block
        if run:
            place = stack[-1][1]
            if "&" in run:
                run = html.unescape(run)
            if tree.tags[place] in FRAME and (block == loose_block or not run.isspace()):
                if block != loose_block:
                    loose, loose_block = element("#text", "", False), block
                place = loose
            tree.texts.append((place, block, run))
            if links:
                tree.linked[place] += len(run.strip())

    def nearest(names: set[str]) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def close(place: int) -> None:
        nonlocal block, links
        while len(stack) > place:
            name, _ = stack.pop()
            open_at[name].pop()
            if name == "a":
                links -= 1
            if name not in INLINE:
                blocks.pop()
                block += 1

    def element(name: str, marks: str, hidden: bool) -> int:
        parent = stack[-1][1]
        while tree.depths[parent] >= DEEPEST:
            parent = tree.parents[parent]
        tree.tags.append(name)
        tree.marks.append(marks)
        tree.hidden.append(hidden)
        tree.parents.append(parent)
        tree.depths.append(tree.depths[parent] + 1)
        tree.linked.append(0)
        return len(tree.tags) - 1

    while (match := _TOKEN.search(page, at)) is not None:
        text(page[at : match.start()])
        at = match.end()
        if match[2] is not None:
            name = match[2].lower()
            if name in CLOSED_BY_SAME:
                place = nearest(CLOSED_BY_SAME[name])
                if place > nearest(SCOPES[name]):
                    close(place)
            elif name in CLOSES_P and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            marks, hidden = _marks(match[3]) if match[3].strip(" \t\r\n\f/") else ("", False)
            if name in INLINE or name in VOID:
                if name == "br":
                    text(" ")
                elif name not in INLINE:
                    block += 1
                elif name not in VOID and not match[3].endswith("/"):
                    links += name == "a"
                    open_at.setdefault(name, []).append(len(stack))
                    stack.append((name, element(name, marks, hidden) if marks or hidden else stack[-1][1]))
                continue
            block += 1
            number = element(name, marks, hidden)
            if name in RAW_TEXT:
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                block += 1
            elif not match[3].endswith("/"):
                open_at.setdefault(name, []).append(len(stack))
                blocks.append(len(stack))
                stack.append((name, number))
        elif match[1] is not None:
            name = match[1].lower()
            if open_at.get(name) and (name not in INLINE or open_at[name][-1] > blocks[-1]):
                close(open_at[name][-1])
    text(page[at:])
    return tree

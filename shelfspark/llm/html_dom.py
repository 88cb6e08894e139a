"""A small forgiving HTML parser: elements as flat arrays, texts as runs in page order.

Text and inline elements that stand directly in body, or outside any element,
get a block element of their own, LOOSE, which the next block ends.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag, and never shown.
RAW = frozenset("script style noscript template iframe textarea title svg object select button canvas audio video annotation".split())
#: Elements whose own text is loose, the name of the block that holds it, and elements that take input.
SHELLS, LOOSE = frozenset(["#root", "html", "body"]), "#loose"
CONTROLS = frozenset("input textarea select button".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption #loose".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of these, if no element of the second set lies between.
_LIST, _CELL = frozenset(["ul", "ol", "menu", "dir"]), frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), _LIST),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), _CELL),
    "th": (frozenset(["td", "th"]), _CELL),
    "tr": (frozenset(["tr", "td", "th"]), _CELL),
    "tbody": (frozenset(["thead", "tbody", "tr", "td", "th"]), _CELL),
    "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th"]), _CELL),
}
_P_SCOPE = frozenset("html body article aside blockquote div li td th section main footer header nav form table button".split())
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Page:
    """tags, parents, depths, attributes by element; runs: (element, block number, text) in page order; controls: the elements that inputs stand in."""

    __slots__ = ("tags", "parents", "depths", "attributes", "runs", "controls")

    def __init__(self):
        self.tags, self.parents, self.depths, self.attributes, self.runs, self.controls = ["#root"], [-1], [0], [""], [], []


_END: dict[str, re.Pattern] = {}


def _end_of(name: str) -> re.Pattern:
    if name not in _END:
        _END[name] = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)
    return _END[name]


def parse(source: str) -> Page:
    page = Page()
    tags, parents, depths, attributes, runs = page.tags, page.parents, page.depths, page.attributes, page.runs
    stack = [0]
    block = at = 0
    size = len(source)

    def opened(name: str, attribute: str) -> None:
        tags.append(name)
        parents.append(stack[-1])
        depths.append(depths[stack[-1]] + 1)
        attributes.append(attribute)

    def loose() -> None:
        """Before text or an inline element: a block for what no other block holds."""
        nonlocal block
        if tags[stack[-1]] in SHELLS:
            opened(LOOSE, "")
            stack.append(len(tags) - 1)
            block += 1

    def text(a: int, b: int) -> None:
        if a < b:
            piece = source[a:b]
            if tags[stack[-1]] in SHELLS:
                if piece.isspace():
                    return
                loose()
            runs.append((stack[-1], block, html.unescape(piece) if "&" in piece else piece))

    def close(tagset, scope) -> None:
        nonlocal block
        for i in range(len(stack) - 1, 0, -1):
            name = tags[stack[i]]
            if name in tagset:
                del stack[i:]
                block += 1
                return
            if name in scope:
                return

    while at < size:
        m = _MARKUP.search(source, at)
        if m is None:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == name:
                    if any(tags[x] in BLOCK for x in stack[i:]):
                        block += 1
                    del stack[i:]
                    break
                if name not in BLOCK and tags[stack[i]] in BLOCK:
                    break
            continue
        if name in BLOCK:
            block += 1
            if tags[stack[-1]] == LOOSE:
                stack.pop()
            close(frozenset(["p"]), _P_SCOPE)
        if name in ENDS:
            close(*ENDS[name])
        if name in CONTROLS:
            page.controls.append(stack[-1])
        if name == "br":
            if tags[stack[-1]] not in SHELLS:
                runs.append((stack[-1], block, " "))
            continue
        if name in VOID:
            continue
        rest = m[3]
        if name not in BLOCK and name not in RAW and name != "head":
            loose()
        opened(name, " ".join(" ".join(filter(None, (a[0] if a[0] in ("hidden",) else "", a[1], a[2], a[3]))) for a in _ATTRIBUTE.findall(rest)).lower() if rest.strip() else "")
        if name in RAW:
            if rest.rstrip().endswith("/") and name == "svg":
                continue
            end = _end_of(name).search(source, at)
            # An end tag that never comes leaves the rest of the page inside.
            at = end.end() if end else size
            continue
        stack.append(len(tags) - 1)
    return page

"""A small, forgiving HTML parser: document order arrays of element and text nodes, in time linear in the page."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style template title head iframe select textarea button desc metadata".split())
#: Tags that leave an open head open; any other, and any word, ends it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
RAW = frozenset("script style title textarea iframe".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr legend li main menu nav ol option p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}
#: Blocks that keep an outer paragraph open.
SCOPE = frozenset("td th caption table button object html body".split())

#: Elements whose own are written as in XML.
FOREIGN = ("svg", "math")
#: Ends of a comment: at once, or behind two hyphens.
ABRUPT, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, quotes counting behind an equals sign only; nothing is tried twice.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"'])|\Z))*+>""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|data-main|hidden)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


class Page:
    """Nodes in document order: parent index (-1 for the root), tag ('' for text), attributes, text and block number."""

    def __init__(self):
        self.parent, self.tag, self.attrs, self.text, self.block = [-1], ["#root"], [{}], [""], [0]


class Open:
    """The open elements, with the depths at which each tag, blocks and scopes stand, so that none is searched for."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#root"]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        for key in self._keys(tag):
            self.depths.setdefault(key, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def pop(self) -> str:
        tag = self.tags.pop()
        self.nodes.pop()
        for key in self._keys(tag):
            self.depths[key].pop()
        return tag

    @staticmethod
    def _keys(tag: str) -> list[str]:
        return [tag] + ["#block"] * (tag in BLOCK) + ["#scope"] * (tag in SCOPE)

    def last(self, *keys: str) -> int:
        """Depth of the innermost of these, 0 if there is none."""
        return max((self.depths[k][-1] for k in keys if self.depths.get(k)), default=0)


def tokens(source: str):
    """(start, end, slash, name, attributes) of each tag; comments and declarations have no name. RAW content is skipped."""
    at, careful, foreign = 0, True, 0
    while (lt := source.find("<", at)) >= 0:
        if source.startswith("<!--", lt):
            found = ABRUPT.match(source, lt + 4) or COMMENT_END.search(source, lt + 4)
            at = found.end() if found else len(source)
            yield lt, at, "", None, ""
            continue
        if source[lt + 1 : lt + 2] in ("!", "?"):
            end = source.find(">", lt)
            if end < 0:
                return
            at = end + 1
            yield lt, at, "", None, ""
            continue
        name = NAME.match(source, lt + 1)
        if not name:
            at = lt + 1
            continue
        rest = REST.match(source, name.end()) if careful else None
        end = rest.end() if rest else 0
        if not rest:
            # A quote that is never closed: from here on tags end at the next bracket, whatever is quoted.
            careful, end = False, source.find(">", name.end()) + 1
            if not end:
                return
        at = end
        tag = name[2].lower()
        rest = source[name.end() : end - 1]
        yield lt, end, name[1], tag, rest
        if tag in FOREIGN and not (not name[1] and rest.endswith("/")):
            foreign = max(0, foreign - 1) if name[1] else foreign + 1
        if not name[1] and tag in RAW and not (foreign and rest.endswith("/")):  # within a script or the like only its end counts
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = close.start() if close else len(source)


def parse(source: str | None) -> Page:
    page, stack = Page(), Open()
    block = silent = at = 0
    source = source or ""

    def add(tag, attrs, text):
        page.parent.append(stack.nodes[-1])
        page.tag.append(tag)
        page.attrs.append(attrs)
        page.text.append(text)
        page.block.append(block)

    def say(text):
        if stack.tags[-1] == "head" and text.strip():
            shut(len(stack.nodes) - 1)
        if text and not silent:
            add("", None, html.unescape(text))

    def shut(depth):
        nonlocal block, silent
        while len(stack.nodes) > depth:
            tag = stack.pop()
            block += tag in BLOCK
            silent -= tag in SILENT

    for start, end, slash, tag, rest in tokens(source):
        raw = stack.tags[-1] in RAW  # what stands in a script or the like is no text
        if not raw:
            say(source[at:start])
        at = end
        if tag is None:
            continue
        if slash:
            depth = stack.last(tag)
            # An inline end tag ends no block.
            if depth and (tag in BLOCK or tag in SILENT or depth > stack.last("#block")):
                shut(depth)
            block += tag in BLOCK
            continue
        if stack.tags[-1] == "head" and tag not in HEAD:
            shut(len(stack.nodes) - 1)
        if tag in ENDS:
            which, limit = ENDS[tag]
            if (depth := stack.last(*which)) > stack.last(*limit):
                shut(depth)
        if tag in ENDS_P and (depth := stack.last("p")) > stack.last("#scope"):
            shut(depth)
        if tag == "body" and silent and (depth := stack.last("head")):  # a head that was left open
            shut(depth)
        block += tag in BLOCK
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        add(tag, attrs, " " if tag == "br" and not silent else "")
        # A slash at a tag's end means nothing in HTML, but ends elements of drawings and formulas.
        if tag not in VOID and not (rest.endswith("/") and (tag in FOREIGN or stack.last(*FOREIGN))):
            stack.push(len(page.tag) - 1, tag)
            silent += tag in SILENT
    if stack.tags[-1] not in RAW:
        say(source[at:])
    return page

"""Main text of web pages by tree scoring.

A page is parsed to a forgiving element tree.  What can't be article text is cut off: scripts, styles, forms, navigation, page headers and
footers, asides, and elements whose class, id or role names them as adverts, notices, menus, comments and the like.  Each paragraph that remains
earns points for its length and commas and passes them to its ancestors (all to the parent, half to the next, less further up), discounted by the
share of link text.  The container with the most points is kept; at it and at each of its ancestors those siblings are kept that hold headings or
paragraphs and aren't mostly links.  A best container inside ``main`` or ``article`` stands for all of it.

Defined results: null, empty and textless pages: the empty text; broken or cut-off markup: open elements end with the page, and from the first tag
whose quotes never close on, tags end at their first ``>``; equally good containers: the first by place; repeated rows: a row each; an empty table
gives an empty table; only ``html_col`` is read, and a column of the result's name leads to another name.  Depth and length aren't limited: nothing
is recursive, and work grows with the length of the page whatever its markup.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import unused_name

_MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
#: The same where quotes don't count.
_LOOSE = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|(?:(?!))()()()|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed", "noframes"))
_CUT = frozenset("script style noscript template nav footer aside form button select option textarea input iframe svg canvas object embed dialog menu title head label fieldset audio video map noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
_SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "li", "dd", "dt"))
#: Words of class, id and role that name what isn't article text: adverts, wherever they stand in a name, and others.
_ADVERT = re.compile(r"ad|ads|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|outbrain|taboola")
_NEGATIVE = re.compile(
    r"banner\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|newsletter\w*|subscri\w*|signup|popup\w*|modal\w*|overlay\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|footer\w*|foot|masthead|topbar|comment\w*|disqus\w*|repl(?:y|ies)|respond\w*|discussion|related\w*|recommend\w*|share\w*|sharing|social\w*|pagination|pager|toolbar|login|search\w*|copyright|legal|disclaimer\w*|hidden|navigation|contentinfo|complementary|form|skip|teaser\w*"
)
_HEADER = re.compile(r"header|head")
#: What names an article as none, and words that say nothing of what an element holds.
_NO_ARTICLE = re.compile(r"comment\w*|repl(?:y|ies)|advert\w*|sponsor\w*|promo\w*|related\w*|teaser\w*")
_PLAIN = frozenset("area bar block body bottom box btn button buttons col column container content frame global group inner item items large left link links list main outer page panel post posts primary right row secondary section site small strip text thread top ul wrap wrapper zone".split())
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPLIT = re.compile(r"[-_\d]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _negative(name: str, pattern: re.Pattern, strict: bool) -> bool:
    """Whether a class or id names something that isn't article text.

    Within an article (``strict``) only the name's last word of substance counts: ``comment-list`` holds comments, ``legal-news`` holds news.
    """
    words = [w for w in _SPLIT.split(_CAPITAL.sub("-", name).lower()) if w]
    if words and words[0] in ("has", "with", "no", "without"):  # says what stands beside or inside
        return False
    if any(_ADVERT.fullmatch(w) for w in words):
        return True
    if strict:
        words = [w for w in words if w not in _PLAIN][-1:]
    return any(pattern.fullmatch(w) for w in words)


def _attributes(raw: str) -> dict[str, str]:
    return {a.lower(): b or c or d for a, b, c, d in reversed(_ATTRIBUTE.findall(raw))}


TAG, NAME = 1, 2


def _cuts(tree: Tree) -> list[bool]:
    """Nodes that are cut off, with all below them.

    A name like ``has-sidebar`` may stand on the frame of the whole page: an element that holds most of the text and a heading or article isn't
    cut for its name.
    """
    n = len(tree.tag)
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[tree.parent[i]] or tree.why[i] == TAG
    size, core = [0] * n, [False] * n
    for node, text in tree.pieces:
        if text is not None and not gone[node]:
            size[node] += len(text.strip())
    for i in range(n - 1, 0, -1):
        core[i] = core[i] or not gone[i] and (tree.tag[i] in ("h1", "main") or tree.tag[i] == "article" and tree.why[i] != NAME)
        size[tree.parent[i]] += size[i]
        core[tree.parent[i]] = core[tree.parent[i]] or core[i]
    cut = gone
    for i in range(1, n):
        cut[i] = cut[i] or cut[tree.parent[i]] or tree.why[i] == NAME and not (core[i] and 2 * size[i] > size[0])
    return cut


class Tree:
    """Parallel lists by node number; a parent's number is below its children's."""

    def __init__(self, html: str):
        self.tag, self.parent = ["#root"], [-1]
        #: Why a node isn't article text by itself: its tag (or being hidden), its name, or 0.
        self.why = [0]
        #: Places in the stack of open elements by tag, and of open blocks: what a tag closes is found without a walk.
        self.opened: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        #: Pieces in page order: (node, text), or (node, None) where a block begins or ends.
        self.pieces: list[tuple[int, str | None]] = []
        self._parse(html)

    def _open(self, tag: str, raw: str, stack: list[int]) -> int:
        inside = bool(self.opened["article"] or self.opened["main"])
        own = _attributes(raw) if raw else {}
        frame = tag in ("html", "body", "main")
        hidden = own and not frame and ("hidden" in own or own.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(own.get("style", "")))
        why = 0
        if tag in _CUT or tag == "header" and not inside or hidden:
            why = TAG
        elif own and not frame:
            names = " ".join(own.get(k, "") for k in ("class", "id", "role")).split()
            if tag == "article":
                why = NAME if any(_negative(x, _NO_ARTICLE, False) for x in names) else 0
            elif any(_negative(x, _NEGATIVE, inside) or not inside and _negative(x, _HEADER, False) for x in names):
                why = NAME
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.why.append(why)
        return len(self.tag) - 1

    def _end(self, stack: list[int], at: int) -> None:
        """Close the elements of the stack from ``at`` on."""
        if self.blocks and self.blocks[-1] >= at:
            self.pieces.append((stack[at], None))
        for n in stack[at:]:
            self.opened[self.tag[n]].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        del stack[at:]

    def _last(self, tags: set[str]) -> int:
        """Place in the stack of the innermost open element of these, or 0."""
        return max((self.opened[t][-1] for t in tags if self.opened[t]), default=0)

    def _parse(self, html: str) -> None:
        stack, at = [0], 0
        find, tags = _MARKUP.search, self.tag
        while True:
            m = find(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text:
                self.pieces.append((stack[-1], text))
            if not m:
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            if m[5]:  # its quotes never close, nor would those of later tags be told from others
                find = _LOOSE.search
            tag, attributes = name.lower(), m[3] or m[6] or ""
            innermost = self.blocks[-1] if self.blocks else 0
            if m[1] or m[4]:
                if not self.opened[tag]:
                    if tag in _BLOCK:
                        self.pieces.append((stack[-1], None))
                elif tag in _BLOCK or self.opened[tag][-1] > innermost:  # an inline end tag closes nothing beyond its block
                    self._end(stack, self.opened[tag][-1])
                continue
            if tag in _CLOSES_P and innermost and tags[stack[innermost]] == "p":
                self._end(stack, innermost)
            if tag in _SAME_LEVEL:
                own, scope = _SAME_LEVEL[tag]
                if (k := self._last(own)) > self._last(scope):
                    self._end(stack, k)
            if tag in ("html", "body") and self.opened[tag]:
                continue
            node = self._open(tag, attributes, stack)
            if tag in _BLOCK:
                self.pieces.append((node, None))
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                if tag == "textarea" or tag == "title":
                    self.pieces.append((node, html[at : end.start()] if end else html[at:]))
                at = end.end() if end else len(html)
            elif tag not in _VOID and (tag in _BLOCK or not attributes.rstrip().endswith("/")):
                self.opened[tag].append(len(stack))
                if tag in _BLOCK:
                    self.blocks.append(len(stack))
                stack.append(node)


def main_text(html: str | None) -> str:
    """The article of a page."""
    if not html:
        return ""
    tree = Tree(html)
    tag, parent, cut = tree.tag, tree.parent, _cuts(tree)
    n = len(tag)
    in_link = [False] * n
    block = [0] * n  # nearest block at or above each node
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
        block[i] = i if tag[i] in _BLOCK else block[parent[i]]
    length, linked, commas, direct, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.pieces:
        if text is None or cut[node] or text.isspace():
            continue
        size = len(text.strip())
        length[node] += size
        linked[node] += size if in_link[node] else 0
        commas[node] += text.count(",") + text.count("，") + text.count("、")
        direct[block[node]] += 0 if in_link[node] else size
    for i in range(1, n):
        if tag[i] == "a" and not cut[i]:
            links[i] += 1
    for i in range(n - 1, 0, -1):
        up = parent[i]
        length[up] += length[i]
        linked[up] += linked[i]
        commas[up] += commas[i]
        links[up] += links[i]
    framed = [False] * n  # inside an article or main element
    for i in range(1, n):
        framed[i] = framed[parent[i]] or tag[i] in ("article", "main")
    # lists and blocks that are mostly short links are menus, whatever they are called; within an article they are references
    for i in range(1, n):
        menu = not framed[i] and tag[i] in ("ul", "ol", "div", "section", "table", "dl") and links[i] >= 3 and linked[i] > 0.6 * length[i] and linked[i] < 40 * links[i]
        cut[i] = cut[i] or cut[parent[i]] or menu
    points, prose = [0.0] * n, [False] * n
    for i in range(1, n):
        if cut[i] or not length[i] or tag[i] not in _BLOCK:
            continue
        prose[i] = tag[i] in _PARAGRAPHS or tag[i] in _HEADINGS or direct[i] >= 25
        if not (tag[i] in _PARAGRAPHS or direct[i] >= 25):
            continue
        earned = (1 + commas[i] + min(length[i] / 100, 3.0)) * (1 - linked[i] / length[i])
        if tag[i] not in _PARAGRAPHS:  # text straight in a container is a paragraph of its own
            points[i] += earned
        up = i
        for level in range(5):
            if not up:
                break
            up = block[parent[up]]
            points[up] += earned / (1 if level == 0 else 2 if level == 1 else 3 * level)
    for i in range(n - 1, 0, -1):
        prose[parent[i]] = prose[parent[i]] or prose[i] and not cut[i]
    for i in range(n):
        if tag[i] in ("article", "main"):
            points[i] *= 1.5
        if length[i]:
            points[i] *= 1 - linked[i] / length[i]
    best = max(range(n), key=lambda i: (0.0 if cut[i] else points[i], -i))
    if cut[best] or not points[best]:
        best = 0
    outer, up = 0, best
    while up > 0:
        if tag[up] == "main" or tag[up] == "article" and tag[outer] != "main":
            outer = up
        up = parent[up]
    keep = [False] * n
    keep[outer or best] = True
    path, up = {0}, parent[outer or best]  # ancestors, whose children may be parts of the article
    while up > 0:
        path.add(up)
        up = parent[up]
    if best:
        for i in range(1, n):
            if parent[i] not in path or i in path or keep[i] or cut[i] or not length[i]:
                continue
            if outer:  # further parts that stand beside an article
                keep[i] = parent[i] == parent[outer] and tag[i] in ("article", "main", "section", "p") and points[i] >= max(10.0, 0.2 * points[outer])
            else:
                keep[i] = prose[i] and 3 * linked[i] <= length[i]
    for i in range(1, n):
        keep[i] = keep[i] or keep[parent[i]]
    blocks, own = [], []
    for node, text in tree.pieces:
        if text is None:
            if own:
                blocks.append("".join(own))
                own = []
        elif keep[node] and not cut[node]:
            own.append(text)
    if own:
        blocks.append("".join(own))
    return " ".join(x for b in blocks if (x := " ".join(unescape(b).split())))


def with_main_text(pages: DataFrame, html_col: str = "html", out: str | None = None) -> tuple[DataFrame, str]:
    """``pages`` with the main text; narrow.  Returns the frame and the column's name."""
    out = out or unused_name(pages, "main_text")

    def extracted(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h) for h in html.to_pylist()], pa.string())

    extracted.__annotations__ = {"html": pa.Array, "return": pa.Array}
    return pages.withColumn(out, F.arrow_udf(extracted, "string").asNondeterministic()(F.col(html_col))), out

"""Main text of html pages by composite text density.

Every node has a density: its characters by tags, adjusted for links (text in links counts against a node, the more the
larger its share). The sum of its children's densities finds the node that holds the text; the least density on the path from it
up to the body is the threshold under which other nodes are furniture. Inside an article or main element, that element's
subtree is taken whole; without one, from the body down, each node at least as dense gives the subtree with the largest sum.
Scripts, styles, form controls and hidden elements never hold text. All other signs (menus, footers, adverts, notices, comments
by readers, by tag, role, class or heading) are hints: a node goes only if its measured text agrees, and never if the node with the
largest sum is it or lies in it.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_words = str.split
#: Elements without an end tag; whose content isn't markup; that never hold the article: fixed values of html.
VOID = frozenset(_words("area base br col embed hr img input link meta param source track wbr"))
RAW = frozenset(_words("script style textarea title noscript iframe noframes template xmp svg canvas select"))
DROP = RAW | frozenset(_words("head button object audio video datalist label"))
#: Elements that seldom hold the article: as good as a whole name.
ASIDE = frozenset(_words("nav footer aside form dialog menu fieldset"))
BLOCK = frozenset(_words("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"))
#: A start tag on the left ends an open element on the right, up to one of those at the end.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"br", "button", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
#: Words of class, id or role that name furniture.
FURNITURE = frozenset(_words("ad ads advert adverts advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail widget footer foot masthead topbar cookie cookies consent notice notices gdpr popup modal overlay alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies reply discussion pagination pager toolbar skip complementary contentinfo search"))
#: A node whose name holds such a word goes only with less than one part in so many of the page's text, or if it is mostly links.
PART = 5
#: Characters without links outside all furniture that are an article, however much the furniture holds.
ENOUGH = 300
#: A tag ends before the next one starts, so that a sign like that in `a<b` is text.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*)>", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""", re.S)
#: Headings over what readers wrote, in the languages at hand.
REMARKS = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader |user )?comments?|responses?|replies|leave a (?:reply|comment)|join the (?:discussion|conversation)|(?:leser)?kommentare?|commentaires?|réactions|comentarios?|opiniones)\b", re.I)
#: Such a heading and no more: whatever follows it, up to the next heading, is by readers too.
ONLY_REMARKS = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader |user )?comments?|responses?|replies|(?:leser)?kommentare?|commentaires?|réactions|comentarios?|opiniones)\W*(?:\d+\W*)?", re.I)
HEADS = frozenset(_words("h1 h2 h3 h4 h5 h6"))
#: Who wrote a remark, or when, stands in one of these, in no more than so many characters.
BYLINE, BYLINE_CHARS = frozenset(_words("b strong a span cite time small address em i h4 h5 h6 div header")), 60
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "linked", "links", "density", "total", "named")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []  # children: Node or str
        self.chars = self.tags = self.linked = self.links = 0
        self.density = self.total = 0.0
        self.named = 0  # by a word of furniture: 1 as a part of a name, 2 as a whole name


def _furniture(tag: str, attrs: str, inside: frozenset | set) -> int:
    """3: goes whatever it holds; 2: a tag or a whole name says furniture; 1: a part of a name does; 0: none."""
    if tag in DROP:
        return 3
    named = 2 if tag in ASIDE or tag == "header" and not inside & {"article", "main"} else 0
    if not attrs:
        return named
    words_of = FURNITURE if inside & {"article", "main"} else FURNITURE | {"header"}
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return 3
        if key in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            if any(w.lower() in words_of for w in value.split()):
                named = 2
            elif not named and any(w.lower() in words_of for w in NAME.findall(value)):
                named = 1
    return named


def parse(page: str) -> Node:
    """The tree of what may hold text. Open elements at the end, stray ends and bad nesting are repaired as browsers do for the usual cases."""
    root = Node("body", None)
    stack, at, lost = [root], 0, None  # lost: the furniture element being skipped, and how deep its name is nested
    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not lost:
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not lost:
                stack[-1].children.append(html.escape(m[0][9:-3]))
            continue
        end, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in RAW and not end and not attrs.endswith("/"):  # to its end tag, whatever is inside
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else (n if tag in ("script", "style", "textarea", "title") else at)
            continue
        if lost:
            if tag == lost[0] and tag not in VOID:
                lost[1] += -1 if end else 1
                if not lost[1]:
                    lost = None
            elif end and tag in ("body", "html") or not end and tag in ("article", "main") and lost[0] not in ("article", "main") and lost[0] in ("li", "p", "a", "span"):
                lost = None
            if lost or end:
                continue
        if tag in ("html", "body", "head"):
            if tag == "head" and not end:
                stop = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (stop.end() if stop[0][1] == "/" else stop.start()) if stop else at
            continue
        if end:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p", stack[-1]))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            own, until = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in own:
                    del stack[k:]
                    break
        if tag in VOID:
            stack[-1].children.append(Node(tag, stack[-1]))
            continue
        named = _furniture(tag, attrs, {x.tag for x in stack})
        if named == 3:
            stack[-1].children.append(Node("br", stack[-1]) if tag in BLOCK else " ")
            if not attrs.endswith("/"):
                lost = [tag, 1]
            continue
        node = Node(tag, stack[-1])
        node.named = named
        stack[-1].children.append(node)
        if not attrs.endswith("/"):
            stack.append(node)
    return root


def _nodes(root: Node) -> list[Node]:
    """Every node, parents first."""
    out = [root]
    for x in out:
        out += [c for c in x.children if isinstance(c, Node)]
    return out


def _count(nodes: list[Node]) -> None:
    """Sets characters, tags and links of nodes, which come parents first."""
    for x in reversed(nodes):
        x.chars = x.tags = x.linked = x.links = 0
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(" ".join(c.split()))
            else:
                x.chars += c.chars
                x.linked += c.chars if c.tag == "a" else c.linked
                x.tags += c.tags + 1
                x.links += c.links + (c.tag == "a")


def _up(x: Node | None):
    while x is not None:
        yield x
        x = x.parent


def _plain(x: Node | str) -> str:
    if isinstance(x, str):
        return x
    return "".join(c if isinstance(c, str) else _plain(c) for c in x.children) if x.chars < 400 else ""


def _headed(x: Node) -> bool:
    """Does a heading say that readers wrote this: the first thing in it?"""
    first = next((c for c in x.children if not isinstance(c, str) and c.chars or isinstance(c, str) and c.strip()), None)
    if not isinstance(first, Node):
        return False
    return bool(REMARKS.match(html.unescape(_plain(first)).strip())) and first.chars < 60 if first.tag in HEADS else first.tag not in ("p",) and first.chars < 120 and _headed(first)


def _remarks(x: Node) -> bool:
    """Is this a list of remarks: several blocks alike, each with a short byline first?"""
    items = [c for c in x.children if isinstance(c, Node) and c.chars]
    if len(items) == 1:
        return items[0].tag in BLOCK and _remarks(items[0])
    blocks = [c for c in items if c.tag in ("div", "li", "article", "section", "dd", "blockquote")]
    if len(blocks) < 2 or sum(c.chars for c in blocks) * 2 < x.chars or len({c.tag for c in blocks}) > 1:
        return False

    def signed(c: Node) -> bool:
        own = [y for y in c.children if isinstance(y, Node) and y.chars or isinstance(y, str) and y.strip()]
        return len(own) > 1 and isinstance(own[0], Node) and own[0].tag in BYLINE and own[0].chars <= BYLINE_CHARS and own[0].chars * 2 < c.chars

    return all(map(signed, blocks))


#: Who wrote a remark inside an article stands in one of these; in `_remarks`, headings and blocks count too.
NAMED = frozenset(("a", "address", "b", "cite", "em", "i", "small", "span", "strong", "time"))
REMARK = ("article", "blockquote", "dd", "div", "li", "section")


def _signed(x: Node) -> bool:
    """Is this a remark: a short name, and blocks of text by it?"""
    own = [y for y in x.children if isinstance(y, Node) and y.chars or isinstance(y, str) and y.strip()]
    if len(own) < 2 or not isinstance(own[0], Node) or own[0].tag not in NAMED or own[0].chars > BYLINE_CHARS:
        return False
    return own[0].chars * 2 < x.chars and any(isinstance(y, Node) and y.tag in ("p", "div", "blockquote") for y in own[1:])


def _signed_tail(x: Node) -> set[int]:
    """The remarks that end a node: two or more children alike, each a name and its text. A list of them only is one as a whole."""
    rest = [c for c in x.children if isinstance(c, Node) and c.chars or isinstance(c, str) and c.strip()]
    out: list[Node] = []
    for c in reversed(rest):
        if not isinstance(c, Node) or c.tag not in REMARK or out and c.tag != out[-1].tag or not _signed(c):
            break
        out.append(c)
    return {id(c) for c in out} if len(out) > 1 else set()


def cut_furniture(root: Node) -> None:
    """Takes out the nodes that tags, names or headings hint at, where their text agrees.

    Tags and whole names are followed if a fair part of the page's text without links, or an article, lies outside all of them; parts
    of names if the node holds little text or is mostly links. What holds the node with the largest sum of densities always stays.
    """
    nodes = measure(root)
    whole = root.chars - root.linked
    inside: set[int] = set()
    for x in nodes:  # parents first
        if x.named == 2 or x.parent is not None and id(x.parent) in inside:
            inside.add(id(x))
    lost = sum(x.chars - x.linked for x in nodes if x.named == 2 and (x.parent is None or id(x.parent) not in inside))
    free = [x for x in nodes if id(x) not in inside]
    trusted = (whole - lost) * PART > whole or whole - lost > ENOUGH or any(x.tag in ("article", "main") and x.chars > x.linked for x in free)
    best = max(free if trusted else nodes, key=lambda x: x.total)
    held = {id(x) for x in _up(best)}

    def goes(x: Node | str, before: Node | str | None) -> bool:
        if isinstance(x, str) or id(x) in held:
            return False
        own = x.chars - x.linked
        if x.named == 2 and (trusted or own * PART <= whole or x.linked > own):
            return True
        if x.named == 1 and (own * PART <= whole or x.linked > own):
            return True
        if own * 2 > whole or x.tag not in BLOCK or x.tag in HEADS:
            return False
        return _headed(x) or isinstance(before, Node) and before.tag in HEADS and x.tag != "p" and bool(REMARKS.match(html.unescape(_plain(before)).strip()))

    def by_readers(x: Node) -> set[int]:
        """Children of x that readers wrote: below a heading that says so, or signed one by one at its end; never half of the page's text."""
        cut, under = _signed_tail(x), False
        for c in x.children:
            if isinstance(c, Node) and c.tag in HEADS and c.chars:
                under = c.chars < 60 and bool(ONLY_REMARKS.fullmatch(html.unescape(_plain(c)).strip()))
            if under and isinstance(c, Node):
                cut.add(id(c))
        lost = [c for c in x.children if id(c) in cut]
        return cut if not any(id(c) in held for c in lost) and sum(c.chars - c.linked for c in lost) * 2 <= whole else set()

    for x in nodes:
        out, before, readers = [], None, by_readers(x)
        for c in x.children:
            if id(c) in readers or goes(c, before):
                if isinstance(before, Node) and before.tag in HEADS and REMARKS.match(html.unescape(_plain(before)).strip()) and before in out:
                    out.remove(before)
                out.append(Node("br", x) if c.tag in BLOCK else " ")
            else:
                out.append(c)
            if not isinstance(c, str) or c.strip():
                before = c
        x.children = out


def _density(x: Node, whole: float) -> float:
    c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.linked), max(1, x.links)
    if not c:
        return 0.0
    # the base of the logarithm grows with the share of links; text without links is damped alike everywhere
    base = math.log(c / max(1, c - x.linked) * lc + whole * c + math.e)
    return c / t * max(0.0, math.log(max(1e-9, c / lc * t / lt))) / max(0.5, math.log(max(base, 1.001)))


def measure(root: Node) -> list[Node]:
    """Sets the densities and their sums of all nodes; returns the nodes, parents first."""
    nodes = _nodes(root)
    _count(nodes)
    whole = root.linked / max(1, root.chars)
    for x in nodes:
        x.density = _density(x, whole)
    for x in nodes:
        x.total = sum(c.density for c in x.children if isinstance(c, Node))
    return nodes


def _bare_runs(x: Node, path: Node, whole: float) -> None:
    """Makes a node of each run of bare text directly in x, with the inline elements in it, beside the child `path`."""
    out: list = []
    run: list = []
    for c in [*x.children, None]:
        if c is not None and c is not path and (isinstance(c, str) or c.tag not in BLOCK):
            run.append(c)
            continue
        if any(isinstance(y, str) and y.strip() for y in run):
            piece = Node("span", x)
            piece.children = run
            for y in run:
                if isinstance(y, Node):
                    y.parent = piece
            _count([piece, *(z for y in run if isinstance(y, Node) for z in _nodes(y))])
            piece.density = _density(piece, whole)
            run = [piece]
        out += run
        run = []
        if c is not None:
            out.append(c)
    x.children = out


def _text(nodes: list[Node]) -> str:
    blocks: list[str] = [""]
    for top in nodes:
        todo: list = [("end",), top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                blocks[-1] += x
            elif isinstance(x, tuple):
                blocks.append("")
            else:
                if x.tag in BLOCK:
                    blocks.append("")
                    todo.append(("end",))
                todo += reversed(x.children)
    out = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in out if b)


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks in page order, one to a line."""
    if not page:
        return ""
    root = parse(page)
    cut_furniture(root)
    nodes = measure(root)
    whole = root.linked / max(1, root.chars)
    best = max(nodes, key=lambda x: x.total)
    if best.total <= 0:  # no element with text of its own: what is left of the body
        return _text([root])
    scope = next((x for x in _up(best) if x.tag in ("article", "main")), None)
    if scope is not None and (scope.chars - scope.linked) * 2 >= best.chars - best.linked:
        outer = next((x for x in _up(scope.parent) if x.tag in ("article", "main")), None)
        if outer is not None and scope.tag == "article" and sum(c.tag == "article" and c.chars > 0 for c in nodes if c.parent is scope.parent) > 1 and outer.chars > 2 * scope.chars:
            scope = outer  # one of several parts
        return _text([scope])
    least = min(x.density for x in _up(best))
    # a run of text directly in the chosen node, or a part of it too sparse by itself, stays with it
    marked: list[Node] = []
    todo = [root]
    while todo:
        x = todo.pop(0)
        if x.density < least or not x.chars:
            continue
        inside = _nodes(x)
        top = max(inside, key=lambda y: y.total)
        if top.total <= 0:
            top = x
        while top is not x and (top.parent.tag in ("article", "main") or top.tag not in BLOCK or top.parent.tag in ("p", "ul", "ol", "dl", "table", "tbody", "blockquote")):
            top = top.parent
        marked.append(top)
        if top is not x:  # what lies beside the path to the node is judged by itself
            y = top
            while y is not x:
                _bare_runs(y.parent, y, whole)
                todo += [c for c in y.parent.children if isinstance(c, Node) and c is not y and not _remarks(c)]
                y = y.parent
    chosen = {id(x) for x in marked}
    order, todo = [], [root]
    while todo:  # page order; nothing twice
        x = todo.pop()
        if id(x) in chosen:
            order.append(x)
        else:
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return _text(order)


def extract(pages: DataFrame, page_html: str = "html", out: str = "text") -> DataFrame:
    """pages with a column more: the main text of each row's page, "" if it has none (null, empty or no text at all).

    Every row is worked on by itself, whatever its ids; the html column and all others stay, one named as `out` is replaced.
    """
    names = [c for c in pages.columns if c != out]
    src = pages.select(*(F.col(f"`{c}`") for c in names))
    if page_html not in names:
        raise ValueError(f"{page_html} is replaced by {out}; give out another name")
    k = names.index(page_html)
    schema = src.withColumn(out, F.lit("")).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([main_text(x.as_py()) for x in b.column(k)], pa.string())], [*names, out])

    return src.mapInArrow(run, schema)

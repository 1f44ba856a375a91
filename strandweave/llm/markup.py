"""Pages as trees of block elements, and wrappers: union-free regular expressions over such trees.

A page's token stream is balanced first (what HTML lets authors leave open is closed), so
a mismatch of two streams is a mismatch between the children of one element.  Neighbouring
children of one kind are folded into a repeated one, and neighbouring equal sequences into
a repeated group; children that only one side has become optional; texts become slots.
A wrapper is the outcome for many pages: it has a node for every slot, with the counts
that tell content from furniture.
"""

from __future__ import annotations

import html as entities
import re
import zlib

_RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
_SKIPPED = "noscript|template|svg|math|select|button|object|audio|video|canvas"
_ATTRIBUTES = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
#: Comments, elements whose content is no text, tags, tags with a lone quote, other markup, markup that the page's end cuts off.
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)|<({_SKIPPED})\b[^>]*>.*?</\2\b[^>]*>"
    rf"|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})|<(/?)([a-z][^\s/>]*)([^>]*>)|<[!?/][^>]*>|<[!?/a-z][^>]*\Z",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INLINE = frozenset(
    "a abbr acronym area b base bdi bdo big br cite code col data del dfn em embed font i img input ins kbd label link map mark meta"
    " output param picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
#: What a start tag closes, up to the element that holds such parts.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"datalist"}),
    "body": ({"head"}, set()),
}
#: Elements that are furniture by their name, and words that say so in a class, an id or a role.
_FURNITURE = frozenset("nav footer aside dialog menu head datalist".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars"
    " footer footers share sharing social related recommended recommendations comment comments disqus reply replies respond pagination pager toolbar topbar masthead"
    " complementary contentinfo search skip copyright paywall toast response responses discussion".split()
)
#: Containers that tell nothing without a class or an id.
_PLAIN = frozenset("div section td th li center table".split())
FLAGGED, ARTICLE, MAIN, KEY, SOFT = 1, 2, 4, 8, 16
#: Elements nested deeper than this are read as part of the one above.
DEEPEST = 150
#: Nodes of a wrapper; beyond that it forgets its rarest parts, and pages that have them go by what stands around.
MOST_NODES = 3000
#: Cells of an exact alignment of two lists of children; longer lists are aligned greedily.
MOST_CELLS = 40_000


class Node:
    """An element, a text (``#``), or a repeated group (its parts' signatures in brackets) of a page or wrapper."""

    __slots__ = ("sig", "flag", "kids", "n", "chars", "links", "text", "main")

    def __init__(self, sig: str, flag: int = 0):
        self.sig, self.flag, self.kids = sig, flag, []
        self.n, self.chars, self.links, self.text, self.main = 1, 0, 0, None, None


def _element(tag: str, attributes: str, inside: bool) -> Node:
    """An element with its signature; ``inside`` an article."""
    flag = FLAGGED if tag in _FURNITURE or (tag == "header" and not inside) else 0
    if tag == "form":
        flag = FLAGGED | SOFT
    names = []
    role = ""
    if len(attributes) > 3:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                names.append(value)
            elif key in ("role", "itemprop"):
                role = value.lower()
            elif (key == "hidden" and tag not in ("html", "body")) or "display:none" in value.replace(" ", "").lower():
                flag |= FLAGGED
    sig = tag
    if names or role:
        words = _PART.findall(" ".join([*names, role]))
        lowered = [w.lower() for w in words]
        sig = f"{tag}.{'-'.join(sorted(set(lowered)))}" if lowered else tag
        if tag not in ("html", "body", "main") and not flag & FLAGGED and not _WORDS.isdisjoint(lowered):
            flag |= FLAGGED | SOFT
        if "header" in lowered and not inside and not flag & FLAGGED and tag not in ("html", "body", "main", "article", "h1"):
            flag |= FLAGGED | SOFT
    if not flag & FLAGGED:
        if tag == "article" or role == "articlebody":
            flag |= ARTICLE | KEY
        elif tag == "main" or role == "main":
            flag |= MAIN | KEY
        elif tag == "h1":
            flag |= KEY
    return Node(sig, flag)


def _finish(node: Node) -> bool:
    """Frees elements that only a word or a form makes furniture but that hold the content; says whether a node holds any.

    Plain containers, without a name of their own, get one by what they hold.
    """
    holds = False
    for kid in node.kids:
        if kid.sig != "#":
            holds |= _finish(kid)
    if node.sig in _PLAIN:
        kinds = {k.sig for k in node.kids}
        node.sig += ":text" if kinds <= {"#"} else ":title" if not kinds.isdisjoint(("h1", "h2")) else ":block" if "p" in kinds else ""
    if node.flag & FLAGGED:
        if not (holds and node.flag & SOFT):
            return False
        node.flag &= ~FLAGGED
    return holds or bool(node.flag & KEY)


def parse(page: str) -> Node:
    """The tree of a page's block elements and texts; character references are decoded, white space is one space."""
    root = Node("page")
    stack, names = [root], [""]
    pieces: list[str] = []
    link, link_chars, articles, too_deep = False, 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                node = Node("#")
                node.text, node.chars, node.links = text, len(text), min(link_chars, len(text))
                stack[-1].kids.append(node)
        link_chars = 0

    def close(to: int) -> None:
        nonlocal articles
        while len(stack) > to:
            articles -= bool(stack.pop().flag & (ARTICLE | MAIN))
            names.pop()

    at = 0
    for m in _MARKUP.finditer(page):
        begin, end = m.span()
        if begin > at:
            pieces.append(page[at:begin])
            if link:
                link_chars += begin - at
        at = end
        tag = m[4] or m[7]
        if tag is None:
            continue
        tag, ending = tag.lower(), bool(m[3] or m[6])
        if tag in _INLINE:
            if tag == "a":
                link = not ending
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if tag == "hr":
            continue
        if ending:
            if too_deep and tag != "body":
                too_deep -= 1
            elif tag in names:
                close(len(names) - 1 - names[::-1].index(tag))
            continue
        if len(stack) > DEEPEST:
            too_deep += 1
            continue
        shut, holder = _CLOSES.get(tag, ({"p"}, {"td", "th", "li", "article", "section", "div", "body"}))
        for i in range(len(names) - 1, 0, -1):
            if names[i] in shut:
                close(i)
            if i >= len(names) or names[i] in holder:
                break
        node = _element(tag, m[5] or m[8] or "", articles > 0)
        stack[-1].kids.append(node)
        if (m[5] or m[8] or "").rstrip(">").endswith("/") and tag not in ("p", "div", "section", "article", "main"):
            continue
        stack.append(node)
        names.append(tag)
        articles += bool(node.flag & (ARTICLE | MAIN))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    _finish(root)
    return root


def texts(node: Node, out: list[str] | None = None) -> list[str]:
    """All texts below a node, in order."""
    out = [] if out is None else out
    if node.text is not None and node.sig == "#":
        out.append(node.text)
    for kid in node.kids:
        texts(kid, out)
    return out


# Wrappers


def _merge(a: Node, b: Node) -> Node:
    """Adds wrapper b of the same signature to wrapper a."""
    if a.text != b.text:
        a.text = None  # a slot with differing texts
    a.n, a.chars, a.links = a.n + b.n, a.chars + b.chars, a.links + b.links
    a.flag = (a.flag & b.flag & FLAGGED) | ((a.flag | b.flag) & ~FLAGGED)
    a.kids = _aligned(a.kids, b.kids)
    return a


def _group(kids: list[Node]) -> Node:
    out = Node("(" + " ".join(k.sig for k in kids) + ")")
    out.kids = kids
    return out


def _pairs(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence, the longest one unless the lists are long."""
    n, m = len(xs), len(ys)
    out = []
    if n * m > MOST_CELLS:
        where: dict[str, list[int]] = {}
        for j in range(m - 1, -1, -1):
            where.setdefault(ys[j], []).append(j)
        last = -1
        for i, x in enumerate(xs):
            places = where.get(x, [])
            while places and places[-1] <= last:
                places.pop()
            if places:
                last = places.pop()
                out.append((i, last))
        return out
    best = [[0] * (m + 1)]
    for i in range(n - 1, -1, -1):
        below, row = best[-1], [0] * (m + 1)
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if xs[i] == ys[j] else max(below[j], row[j + 1])
        best.append(row)
    i = j = 0
    while i < n and j < m:
        if xs[i] == ys[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[n - i - 1][j] >= best[n - i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _regrouped(xs: list[Node], groups: list[Node]) -> list[Node]:
    """Sequences that the other side has as a repeated group become one, even where they stand once."""
    for g in groups:
        want = [k.sig for k in g.kids]
        out: list[Node] = []
        i = 0
        while i < len(xs):
            if [k.sig for k in xs[i : i + len(want)]] == want:
                found = _group(xs[i : i + len(want)])
                out[-1:] = [_merge(out[-1], found)] if out and out[-1].sig == found.sig else [*out[-1:], found]
                i += len(want)
            else:
                out.append(xs[i])
                i += 1
        xs = out
    return xs


def _aligned(xs: list[Node], ys: list[Node]) -> list[Node]:
    """Children of both sides in one order; where a side lacks one it is optional."""
    if len(xs) != len(ys) or any(x.sig != y.sig for x, y in zip(xs, ys, strict=True)):
        mine, other = [x for x in xs if x.sig[0] == "("], [y for y in ys if y.sig[0] == "("]
        xs, ys = (_regrouped(xs, other) if other else xs), (_regrouped(ys, mine) if mine else ys)
    else:
        return [_merge(x, y) for x, y in zip(xs, ys, strict=True)]
    out: list[Node] = []
    i = j = 0
    for a, b in [*_pairs([x.sig for x in xs], [y.sig for y in ys]), (len(xs), len(ys))]:
        out += xs[i:a] + ys[j:b]
        if a < len(xs):
            out.append(_merge(xs[a], ys[b]))
        i, j = a + 1, b + 1
    return _folded(out)


def _folded(kids: list[Node]) -> list[Node]:
    """Neighbours of one signature become one repeated node, equal neighbouring sequences of two or three a repeated group."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].sig == k.sig:
            _merge(out[-1], k)
        else:
            out.append(k)
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            sigs = [k.sig for k in out[i : i + size]]
            j, same = i + size, 1
            while [k.sig for k in out[j : j + size]] == sigs:
                j, same = j + size, same + 1
            if same > 1:
                group = _group(out[i : i + size])
                for at in range(i + size, j, size):
                    _merge(group, _group(out[at : at + size]))
                out[i:j] = [group]
            i += 1
    return out


def wrapper_of(node: Node) -> Node:
    """A page's own wrapper."""
    out = Node(node.sig, node.flag)
    out.chars, out.links = node.chars, node.links
    if node.sig == "#":
        out.text = zlib.crc32(node.text.encode("utf-8", "replace"))
    out.kids = _folded([wrapper_of(k) for k in node.kids])
    return out


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.kids))


def _prune(node: Node, least: int) -> None:
    node.kids = [k for k in node.kids if k.n >= least]
    for k in node.kids:
        _prune(k, least)


def merged(a: Node, b: Node) -> Node:
    """Wrapper a with the pages of wrapper b; it forgets its rarest parts where it grows beyond bounds."""
    _merge(a, b)
    least = 2
    while _size(a) > MOST_NODES:
        _prune(a, least)
        least *= 2
    return a


def dump(node: Node) -> list:
    return [node.sig, node.flag, node.n, node.chars, node.links, node.text, [dump(k) for k in node.kids]]


def load(x: list) -> Node:
    out = Node(x[0], x[1])
    out.n, out.chars, out.links, out.text = x[2:6]
    out.kids = [load(k) for k in x[6]]
    return out


# Which slots are the article


def _mass(node: Node) -> int:
    """Characters outside links below a node, without furniture."""
    if node.flag & FLAGGED:
        return 0
    return node.chars - node.links + sum(map(_mass, node.kids)) if node.sig == "#" else sum(map(_mass, node.kids))


def _marked(node: Node, flag: int, out: list[Node]) -> list[Node]:
    """Outermost elements with a flag, outside furniture."""
    if not node.flag & FLAGGED:
        if node.flag & flag:
            out.append(node)
        else:
            for k in node.kids:
                _marked(k, flag, out)
    return out


def _titles(node: Node, out: list[Node]) -> list[Node]:
    """First headings outside furniture."""
    if not node.flag & FLAGGED:
        if node.sig.split(".")[0] == "h1":
            out.append(node)
        for k in node.kids:
            _titles(k, out)
    return out


def _region(root: Node) -> tuple[Node, bool]:
    """The element that holds the article, and whether the page names it."""
    article = max(_marked(root, ARTICLE, []), key=_mass, default=None)
    main = max(_marked(root, MAIN, []), key=_mass, default=None)
    if article is not None and _mass(article) and (main is None or 2 * _mass(article) >= _mass(main)):
        return article, True
    if main is not None and _mass(main):
        return main, True
    if article is not None:
        return article, True
    node, total = root, _mass(root)
    while total and node.kids:
        best = max(node.kids, key=_mass)
        title = any(k is not best and k.sig.split(".")[0] in ("h1", "h2") and not k.flag & FLAGGED for k in node.kids)
        if title or best.sig == "#" or 10 * _mass(best) < 8 * total or not any(k.kids for k in best.kids):
            break
        node = best
    return node, False


def _decide(node: Node, inside: bool, plain: bool, varied: bool) -> None:
    inside = inside and not node.flag & FLAGGED
    if node.sig == "#" and inside and plain:
        fixed = varied and node.n > 2 and node.text is not None
        inside = not fixed and 10 * node.links < 6 * node.chars
    node.main = inside
    for k in node.kids:
        _decide(k, inside, plain, varied)


def _find(node: Node, region: Node, plain: bool, varied: bool) -> None:
    node.main = False
    for k in node.kids:
        _find(k, region, plain, varied)
    if node is region:
        _decide(node, True, plain, varied)


def _varies(node: Node) -> bool:
    return (node.sig == "#" and node.n > 2 and node.text is None) or any(map(_varies, node.kids))


def _plan(node: Node, region: Node) -> list | None:
    """[signature, main, region, children] without parts that only say what stands around them."""
    kids = [p for k in node.kids if (p := _plan(k, region)) is not None and (k is region or p[3] or k.main != node.main)]
    return [node.sig, int(node.main), int(node is region), kids]


def plan(root: Node) -> list:
    """The decisions of a wrapper: which of its nodes are the article."""
    region, named = _region(root)
    _find(root, region, not named, not named and _varies(region))
    titles = _titles(root, [])
    if not _titles(region, []):
        # the title stands apart from the article; one that all pages share is the site's
        for t in titles:
            _decide(t, root.n < 3 or _varies(t), False, False)
    return _plan(root, region)


# Pages by their wrapper


def _apply(node: Node, decided: list | None, inside: bool, out: list[str]) -> bool:
    """Collects the article's texts of a page; says whether its region occurs."""
    seen = bool(decided and decided[2])
    if decided is not None:
        inside = bool(decided[1])
    if node.flag & FLAGGED:
        inside = False
    if node.sig == "#":
        if inside:
            out.append(node.text)
        return seen
    rules = decided[3] if decided is not None else []
    if not rules:
        if inside or seen:
            for k in node.kids:
                _apply(k, None, inside, out)
        return seen
    runs: list[list[Node]] = []
    for k in node.kids:
        if runs and runs[-1][0].sig == k.sig:
            runs[-1].append(k)
        else:
            runs.append([k])
    sigs = [r[0].sig for r in runs]
    flat: list[list] = []
    for r in rules:
        parts = r[0][1:-1].split(" ") if r[0][0] == "(" else []
        known = {k[0]: k for k in r[3]}
        # a repeated group is unrolled as often as its first part occurs
        flat += [known.get(p, [p, r[1], 0, []]) for _ in range(max(1, sigs.count(parts[0]))) for p in parts] if parts else [r]
    met = dict(_pairs(sigs, [r[0] for r in flat]))
    for i, run in enumerate(runs):
        rule = flat[met[i]] if i in met else None
        for k in run:
            seen |= _apply(k, rule, inside, out)
    return seen


def article(page: str, decided: list | None) -> str:
    """The article's blocks of a page, by its wrapper's decisions; a page without the wrapper's region goes by its own."""
    tree = parse(page)
    out: list[str] = []
    if decided is None or not _apply(tree, decided, False, out):
        out.clear()
        _apply(tree, plan(wrapper_of(tree)), False, out)
    return "\n".join(out)

"""Block trees of HTML pages and their alignment by simple tree matching.

``parse`` reads any text as a browser would: optional end tags, unclosed and
misplaced tags, comments, scripts, cut-off pages. Only elements that make blocks
become nodes; inline markup belongs to the text of its block. A node's label is its
tag, id and first classes (digits as ``#``), marked ``!`` where its names say that
it is no part of an article, ``^`` where they say header.

A template is a tree of labels with the number of pages that hold each node.
Consecutive siblings of one label that are items (paragraphs, list entries, cells)
are one repeated node. Templates are merged by simple tree matching: two nodes of
one label match; their children are aligned in order so that most nodes match.
"""

from __future__ import annotations

import html as _html
import json
import re

# Fixed values of HTML: elements that make blocks, that are void, whose content is not text of the page,
# and what an opening tag closes up to which container.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNREAD = frozenset("audio button canvas datalist math noscript object optgroup option select svg template video".split())
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
ITEMS = frozenset("p li dt dd tr td th".split())
#: Consecutive siblings of one label, whatever their tag, count as items from this number on.
MANY = 8
# Names of elements beside an article.
BESIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
BESIDE_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar".split())
BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
NOT_OWN = frozenset("has no with without is not".split())
FRAME = frozenset("html body main article".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "label", "kids", "n", "repeated", "id")

    def __init__(self, tag: str, label: str, kids: list | None = None, n: int = 1, repeated: bool = False):
        self.tag, self.label, self.kids, self.n, self.repeated, self.id = tag, label, [] if kids is None else kids, n, repeated, -1

    def beside(self) -> bool:
        return self.label.startswith("!")


_LABELS: dict[tuple[str, str], tuple[str, bool]] = {}


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """(label, whether the element is marked as no part of an article)."""
    known = _LABELS.get((tag, attributes))
    if known:
        return known
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    beside = tag in BESIDE_TAGS or found.get("role", "").lower() in BESIDE_ROLES
    beside |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    header = tag == "header" or found.get("role", "").lower() == "banner"
    if tag not in FRAME:
        for name in names:
            words = [w.lower() for w in _WORDS.findall(name)]
            if words and words[0] not in NOT_OWN:
                beside |= words[0] in BESIDE_WORDS or words[-1] in BESIDE_WORDS
                header |= words[0] in HEADER_WORDS or words[-1] in HEADER_WORDS
    own = [re.sub(r"\d+", "#", x)[:24] for x in (*found.get("class", "").split()[:2], *found.get("id", "").split()[:1])]
    role = "main" if found.get("role", "").lower() == "main" or "articleBody" in found.get("itemprop", "") else ""
    label = ("!" if beside else "^" if header else "") + ".".join([tag, *own, *([f"@{role}"] if role else [])])
    if len(_LABELS) > 50_000:
        _LABELS.clear()
    _LABELS[tag, attributes] = label, beside
    return label, beside


def parse(text: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """(root, blocks): every block in page order with its node and how many of its characters are in links."""
    root = Node("#page", "#page")
    stack, blocks = [root], []
    buffer: list[str] = []
    linked, in_link = 0, False
    skip: list | None = None  # [tag, how often it is open, height of the stack]

    def flush() -> None:
        nonlocal linked
        if buffer:
            block = " ".join("".join(buffer).split())
            buffer.clear()
            if block:
                blocks.append((stack[-1], block, min(linked, len(block))))
        linked = 0

    def close(down_to: int) -> None:
        nonlocal skip
        flush()
        del stack[down_to:]
        if skip is not None and len(stack) < skip[2]:
            skip = None

    at, n = 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        upto = m.start() if m else n
        if upto > at and skip is None:
            piece = text[at:upto]
            if "&" in piece:
                piece = _html.unescape(piece)
            buffer.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if text.startswith(("<!", "<?"), upto):
            continue
        complete = m[2] is not None
        ends, tag, attributes = (m[1], m[2], m[3]) if complete else (m[4], m[5], m[6])
        if not complete and text[at - 1] != ">":
            break  # a tag cut off at the end of the page
        tag = tag.lower()
        if ends:
            if skip is not None and tag == skip[0]:
                skip[1] -= 1
                skip = skip if skip[1] else None
            elif tag == "a":
                in_link = False
            elif tag in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr" and skip is None:
                flush()
            elif tag == "br" and skip is None:
                buffer.append(" ")
            continue
        empty = attributes.endswith("/")
        if tag not in BLOCK:
            if skip is not None:
                skip[1] += tag == skip[0] and not empty
            elif not empty and (tag in UNREAD or ("=" in attributes or "hidden" in attributes) and _label(tag, attributes)[1]):
                skip = [tag, 1, len(stack)]
            elif tag == "a":
                in_link = True
            continue
        if skip is not None and skip[0] in UNREAD:
            continue
        skip = None
        flush()
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in CLOSES:
            own, outer = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in outer:
                    break
                if stack[k].tag in own:
                    close(k)
                    break
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        node = Node(tag, _label(tag, attributes)[0])
        stack[-1].kids.append(node)
        if not empty:
            stack.append(node)
    flush()
    return root, blocks


def runs_of_siblings(kids: list[Node]) -> list[list[Node]]:
    """Children in order; consecutive ones of one label that are items together."""
    out: list[list[Node]] = []
    for k in kids:
        if out and out[-1][0].label == k.label:
            out[-1].append(k)
        else:
            out.append([k])
    parts: list[list[Node]] = []
    for run in out:
        if run[0].tag in ITEMS or len(run) >= MANY:
            parts.append(run)
        else:
            parts += [[k] for k in run]
    return parts


def as_template(node: Node) -> Node:
    """The template of one page."""
    kids = []
    for run in runs_of_siblings(node.kids):
        one = as_template(run[0])
        for other in run[1:]:
            one = merge(one, as_template(other), again=False)
        one.repeated = len(run) > 1
        kids.append(one)
    return Node(node.tag, node.label, kids)


def matching(a: Node, b: Node) -> int:
    """Simple tree matching: the most nodes of two trees that match, order and parents kept."""
    return 0 if a.label != b.label else 1 + _align(a.kids, b.kids)[-1][-1]


def _align(a: list[Node], b: list[Node]) -> list[list[int]]:
    """Sums of the best alignments of the first i and first j children."""
    sums = [[0] * (len(b) + 1)]
    for x in a:
        row, last = [0], sums[-1]
        for j, y in enumerate(b):
            best = last[j + 1] if last[j + 1] >= row[j] else row[j]
            if x.label == y.label:
                both = last[j] + (1 + _align(x.kids, y.kids)[-1][-1] if x.kids and y.kids else 1)
                if both > best:
                    best = both
            row.append(best)
        sums.append(row)
    return sums


def aligned(a: list[Node], b: list[Node]) -> list[tuple[int | None, int | None]]:
    """Pairs of children numbers in order; None where one has no partner."""
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    sums = _align(a, b)
    i, j, out = len(a), len(b), []
    while i or j:
        here = sums[i][j]
        if i and sums[i - 1][j] == here:
            i -= 1
            out.append((i, None))
        elif j and sums[i][j - 1] == here:
            j -= 1
            out.append((None, j))
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: Node, b: Node, again: bool = True) -> Node:
    """Template of both; ``again``: of different pages, whose numbers add up."""
    kids = []
    for i, j in aligned(a.kids, b.kids):
        if j is None:
            kids.append(a.kids[i])
        elif i is None:
            kids.append(b.kids[j])
        else:
            kids.append(merge(a.kids[i], b.kids[j], again))
    return Node(a.tag, a.label, kids, a.n + b.n if again else max(a.n, b.n), a.repeated or b.repeated)


def size_of(node: Node) -> int:
    return 1 + sum(size_of(k) for k in node.kids)


def pruned(node: Node, most: int) -> Node:
    """The template without its rarest nodes, so that it has ``most`` nodes or fewer; what hangs from them goes too."""
    if size_of(node) <= most:
        return node
    counts: list[int] = []

    def walk(x: Node) -> None:
        counts.append(x.n)
        for k in x.kids:
            walk(k)

    walk(node)
    level = sorted(counts, reverse=True)[most - 1]

    def cut(x: Node, least: int) -> Node:
        return Node(x.tag, x.label, [cut(k, least) for k in x.kids if k.n >= least], x.n, x.repeated)

    out = cut(node, level)
    return out if size_of(out) <= most else cut(node, level + 1)


def assign(page: Node, template: Node) -> None:
    """Sets ``id`` of every page node: its partner's in the template (numbered), or the nearest matched ancestor's.

    Nodes without a partner that stand beside the article by their names, and all below them, get -2.
    """
    page.id = template.id
    groups = runs_of_siblings(page.kids)
    heads = [g[0] if len(g) == 1 else Node(g[0].tag, g[0].label, _joined(g)) for g in groups]
    for i, j in aligned(heads, template.kids):
        if i is None:
            continue
        for k in groups[i]:
            if j is None:
                _lost(k, page.id)
            else:
                assign(k, template.kids[j])


def _joined(group: list[Node]) -> list[Node]:
    return max((g.kids for g in group), key=len)


def _lost(node: Node, ancestor: int) -> None:
    node.id = -2 if node.beside() else ancestor
    for k in node.kids:
        _lost(k, node.id)


def numbered(template: Node) -> list[Node]:
    """All nodes, parents first; ``id`` is the place in this list."""
    out = [template]
    k = 0
    template.id = 0
    while k < len(out):
        for kid in out[k].kids:
            kid.id = len(out)
            out.append(kid)
        k += 1
    return out


def dumps(node: Node) -> str:
    def plain(x: Node) -> list:
        return [x.label, x.n, int(x.repeated), [plain(k) for k in x.kids]]

    return json.dumps(plain(node), ensure_ascii=False, separators=(",", ":"))


def loads(text: str) -> Node:
    def node(x: list) -> Node:
        return Node(re.split(r"[.@]", x[0].lstrip("!^"), maxsplit=1)[0], x[0], [node(k) for k in x[3]], x[1], bool(x[2]))

    return node(json.loads(text))

"""Main text of web pages by composite text density.

Every element of the page gets a composite text density: its characters per
tag, adjusted by how much of its text and of its tags are links. Scores of the
children, summed, are an element's density sum. The least density on the path
from the element of the largest sum to the body is the threshold. Walking down
from the body, every element that reaches it gives the subtree of the largest
sum below it, so an article in several sections is kept whole. The text is what
the least element around all of these holds, without thin containers and lists
of links.

Elements whose tag says that they are no article text (menus, forms, scripts
...) take no part in the densities. Those that only a class, id or role marks
(adverts, notices, comment lists ...) take none either, unless the page is
nearly empty without them.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import text as T
from gridframe.session import ship_package

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template title head iframe object embed svg canvas math audio video map "
                    "nav aside footer form button select option textarea input label fieldset dialog menu xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
                   "tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: an element of the first name ends open ones of the others
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"),
        "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr"), "tfoot": ("td", "th", "tr")}
SCOPES = frozenset("ul ol dl table select body html".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template object".split())
# words of a class, id or role that mark text outside the article, wherever they stand
OUTSIDE = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertis\w*|adsense|sponsor(?:ed|s)?|promo(?:s|tion)?|footer|breadcrumbs?|"
    r"comments?|commentlist|disqus|respond|reply|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|related|recommended|pagination|pager|"
    r"copyright|complementary|contentinfo)(?![a-z])", re.I)
# the same for layout words, unless the name speaks of the content around them
LAYOUT = re.compile(r"(?<![a-z])(?:nav|navbar|navigation|menu|side-?bar|header|masthead|banner|social|widgets?|toolbar|skip|search|aside)(?![a-z])", re.I)
AROUND = re.compile(r"(?<![a-z])(?:has|with|without|no|content|main|wrap|wrapper|article|entry|post|story|container|layout|page)(?![a-z])", re.I)
COMMENT = re.compile(r"(?<![a-z])(?:comments?|reply|replies)(?![a-z])", re.I)
NEVER = frozenset("html body".split())
#: blocks that hold text of their own; the other ones hold blocks
TEXTS = HEADINGS | frozenset("p pre blockquote ul ol dl li dt dd table figure figcaption address caption center".split())
#: an element marked by its class is text after all if the rest of the page has less than this part of its characters
REST = 0.2

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "parts", "dropped", "marked", "paragraph", "in_article",
                 "chars", "tags", "link_chars", "link_tags", "density", "total", "top")

    def __init__(self, name: str, parent: Node | None, dropped: bool, marked: str = ""):
        self.name, self.parent, self.dropped, self.marked = name, parent, dropped, marked
        self.parts: list = []  # strings and nodes in page order
        self.paragraph: Node | None = self if name == "p" else None
        if parent is not None and name not in ("p", "td", "th", "table", "button"):
            self.paragraph = parent.paragraph
        self.in_article = name in ("article", "main") or parent is not None and parent.in_article
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.top: Node = self  # the node of the largest density sum in this subtree


def _hidden(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag says that it is no article text, or it is not shown."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or attributes.isspace() or name in NEVER:
        return False
    return any(
        (key := k.lower()) == "hidden" or key == "aria-hidden" and v.strip("\"'") == "true" or key == "style" and HIDDEN_STYLE.search(v)
        for k, v in ATTRIBUTE.findall(attributes))


def _mark(name: str, attributes: str, in_article: bool) -> str:
    """What an element's class, id or role says that it is, if no article text: a
    ``comment``, something ``outside`` the article, or an empty string."""
    if not attributes or attributes.isspace() or name in NEVER:
        return ""
    for key, value in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            for word in value.strip("\"'").replace("_", "-").split():
                if COMMENT.search(word):
                    return "comment"
                if name in ("article", "main"):
                    continue
                if OUTSIDE.search(word):
                    return "outside"
                if not (in_article and name == "header" or name in HEADINGS) and LAYOUT.search(word) and not AROUND.search(word):
                    return "outside"
    return ""


def parse(page: str) -> Node:
    """The page as a tree; unclosed, misplaced and cut-off tags are mended."""
    root = Node("html", None, False)
    here, at = root, 0
    count: dict[str, int] = {}  # open elements by name

    def leave(node: Node) -> None:
        """Close the open elements up to ``node``, with it."""
        nonlocal here
        while True:
            count[here.name] -= 1
            last, here = here, here.parent
            if last is node:
                return

    while True:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            if here.name == "head" and not text.isspace():
                leave(here)
            here.parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        at, name = m.end(), (m[2] or "").lower()
        if not name or name == "html":
            continue
        if m[1]:
            if count.get(name):
                node = here
                while node.name != name:
                    node = node.parent
                leave(node)
            continue
        if name == "body":
            if count.get("body"):
                continue
            while here is not root:
                leave(here)
        elif count.get("head") and name not in IN_HEAD:
            node = here
            while node.name != "head":
                node = node.parent
            leave(node)
        if name in CLOSES_P and here.paragraph is not None:
            leave(here.paragraph)
        for other in ENDS.get(name, ()):
            if count.get(other):
                node = here
                while node.name != other and node.name not in SCOPES:
                    node = node.parent
                if node.name == other:
                    leave(node)
        gone = here.dropped or _hidden(name, m[3], here.in_article)
        new = Node(name, here, gone, "" if gone else _mark(name, m[3], here.in_article))
        here.parts.append(new)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        count[name] = count.get(name, 0) + 1
        here = new


def _walk(root: Node) -> list[Node]:
    """All kept nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed([p for p in node.parts if not isinstance(p, str) and not p.dropped]))
    return out


def _plain_chars(node: Node, stop: bool) -> int:
    """Characters outside links below a node; ``stop`` leaves out marked elements."""
    n, stack = 0, [node]
    while stack:
        for p in stack.pop().parts:
            if isinstance(p, str):
                n += len(SPACE.sub(" ", p).strip())
            elif not p.dropped and p.name != "a" and not (stop and p.marked):
                stack.append(p)
    return n


def settle(root: Node) -> None:
    """Drop the elements that their class marks, but for one that holds nearly all
    text of a page without an article element. Comments always go."""
    marked, rest, article = [], 0, False
    stack = [root]
    while stack:
        node = stack.pop()
        if node.marked:
            marked.append(node)
            continue
        article = article or node.name in ("article", "main")
        stack.extend(p for p in node.parts if not isinstance(p, str) and not p.dropped)
    if marked:
        rest = _plain_chars(root, stop=True)
    for node in marked:
        if node.marked == "outside" and not (article and rest):
            own = _plain_chars(node, stop=True)
            if rest < REST * own:
                node.marked = ""
                inner = [p for p in node.parts if not isinstance(p, str) and not p.dropped]
                while inner:  # marks inside it hold
                    p = inner.pop()
                    p.dropped = bool(p.marked)
                    if not p.dropped:
                        inner.extend(q for q in p.parts if not isinstance(q, str) and not q.dropped)
                continue
        node.dropped = True


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, densities and density sums of all kept nodes."""
    nodes = _walk(root)
    for node in reversed(nodes):
        link = node.name == "a"
        for p in node.parts:
            if isinstance(p, str):
                n = len(SPACE.sub(" ", p).strip()) if not p.isspace() else 0
                node.chars += n
                node.link_chars += n if link else 0
            elif not p.dropped:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.chars if link else p.link_chars
                node.link_tags += p.link_tags + (1 if p.name == "a" else 0)
    body_chars, body_links = root.chars, root.link_chars
    for node in reversed(nodes):
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        plain = max(c - lc, 1)
        if c:
            base = math.log(c / plain * lc + body_links / max(body_chars, 1) * c + math.e)
            node.density = c / t * math.log(c / max(lc, 1) * t / lt + 1) / base
        node.total = sum(p.density for p in node.parts if not isinstance(p, str) and not p.dropped)
        if any(isinstance(p, str) and not p.isspace() for p in node.parts):
            node.total += 0.0 if node.name == "a" else node.density * 1e-9  # text of its own breaks ties
        node.top = node
        for p in node.parts:
            if not isinstance(p, str) and not p.dropped and p.top.total > node.top.total:
                node.top = p.top
    return nodes


def _block_of(node: Node) -> Node:
    while node.name not in BLOCKS and node.parent is not None:
        node = node.parent
    return node


def _plain(node: Node) -> bool:
    """Whether a node is paragraphs without links."""
    return not node.link_chars and (node.name in TEXTS or any(p.name in TEXTS for p in node.parts if not isinstance(p, str)))


def _content(root: Node) -> tuple[Node, float, set[int], set[int]]:
    """The element around all kept subtrees, the threshold, and the kept subtrees and
    the elements above them (by ``id``).

    The element of the largest density sum and its path to the body set the
    threshold; every element that reaches it, from the body down, gives its
    subtree of the largest sum. A kept paragraph stands for the element it is in.
    """
    best = root.top if root.top.chars else root
    threshold, node = best.density, best
    while node is not None and node.name != "html":
        if node.density:
            threshold = min(threshold, node.density)
        node = node.parent
    kept, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.density >= threshold:
            kept.append(_block_of(node.top))
        if node.top is not node:
            stack.extend(p for p in node.parts if not isinstance(p, str) and not p.dropped and p.name != "a" and p.chars)
    best = _block_of(best)
    if (best.name in HEADINGS or best.name == "p") and best.parent is not None:
        best = best.parent
    whole = {id(best), *map(id, kept)}
    above: dict[int, int] = {}  # kept subtrees in an element that holds some
    for node in {id(n): n for n in [best, *kept]}.values():
        while node is not None:
            above[id(node)] = above.get(id(node), 0) + 1
            node = node.parent
    around = best
    while above[id(around)] < len(whole) and around.parent is not None:
        around = around.parent
    article = around
    while article is not None and article.name not in ("article", "main"):
        article = article.parent
    if article is not None:
        around = article
    while article is None and around.parent is not None:  # headings, and plain text in one container with it, belong to it
        outer = around.parent.name in ("body", "html")
        beside = [p for p in around.parent.parts if p is not around]
        if any(not p.isspace() if isinstance(p, str) else not p.dropped and p.chars and p.name not in HEADINGS and (outer or not _plain(p)) for p in beside):
            break
        around = around.parent
    return around, threshold, whole, set(above)


def _blocks(node: Node, threshold: float, whole: set[int], above: set[int], out: list[list[str]]) -> None:
    """Collect the text of a subtree, a new block wherever a block element begins or
    ends. Outside the kept subtrees, containers below the threshold go: inside an
    article element those that are links in good part, elsewhere those with links or
    without a paragraph."""
    stack: list = [("open", node, id(node) in whole)]
    while stack:
        what, x, kept = stack.pop()
        if what == "text":
            out[-1].append(x)
            continue
        block = x.name in BLOCKS
        if what == "close":
            if block:
                out.append([])
            continue
        thin = x is not node and block and x.name not in HEADINGS and x.density < threshold
        # lists of links: mostly link text, several links, thinner than the path's threshold
        linked = thin and x.link_tags > 1 and x.link_chars > 0.5 * x.chars
        beside = thin and not kept and id(x) not in above and x.name not in TEXTS and (
            x.link_chars > x.chars / 3 if x.in_article else not _plain(x))
        if linked or beside:
            out.append([])
            continue
        if block:
            out.append([])
        if x.name == "br":
            out[-1].append(" ")
        stack.append(("close", x, kept))
        for p in reversed(x.parts):
            if isinstance(p, str):
                stack.append(("text", p, kept))
            elif not p.dropped:
                stack.append(("open", p, kept or id(p) in whole))
            elif p.name in BLOCKS:
                stack.append(("close", p, kept))


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, joined by two line ends."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    measure(root)
    out: list[list[str]] = [[]]
    _blocks(*_content(root), out)
    texts = (SPACE.sub(" ", "".join(parts)).strip() for parts in out)
    return "\n\n".join(t for t in texts if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the page by default), text and n_chars (code points)
    of every row; a kept column of one of these names is replaced.

    * null or empty page, or one without text: empty text, 0 characters;
    * ties between elements: the first of the page;
    * very long and deeply nested pages: read whole, without recursion;
    * repeated rows: each gives its row; an empty table gives none.
    """
    ship_package(pages.sparkSession)
    keep = [c for c in ([c for c in pages.columns if c != html_col] if keep is None else keep) if c not in ("text", "n_chars")]
    picked = pages.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, T.plain_names(len(keep)), strict=True)], F.col(html_col).alias("_gf_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_extract, f"{fields}, text string, n_chars long" if fields else "text string, n_chars long").toDF(*keep, "text", "n_chars")

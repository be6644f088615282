"""Main text of web pages: paragraphs score their ancestors, and the best container is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import in_batches, slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes on the way up to the given elements.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Never part of the article.
DROPPED = RAW | frozenset(
    "head nav footer aside form menu dialog button select option object svg canvas template audio video map search".split()
)
#: Words in a class, id or role that tell what an element is for. The first lists are decisive, the
#: second not if the element also calls itself content. Inside an article a longer name counts only if its
#: other words tell how the page is built: `related-box` does, `related-work` doesn't.
CERTAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios kommentare "
    "commentaires consent cookie cookies disqus feedback footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice pager pagination paywall popup promo promoted promotion recommended related replies reply share sharing shoutbox "
    "sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar contentinfo complementary "
    "dialog alert search login respond adsense adsbygoogle".split()
)
DOUBTFUL = frozenset("header foot extra widget meta tags tools side rail topbar bottom form rss links list".split())
#: Words for how a page is built, which leave the decisive word beside them decisive.
STRUCTURE = frozenset(
    "user users reader readers post article entry story page site main blog list lists slot box container wrapper wrap inner outer "
    "bar block area section content contents text item items panel unit zone region group row col column holder module body thread "
    "form button buttons icon icons top bottom left right middle center inline title heading count wp div".split()
)
#: Decisive words that are topics as well: they don't tell against a paragraph, heading or table.
TOPICAL = frozenset(
    "social search promotion feedback menu navigation skip alert dialog consent subscription sponsor login advertising respond".split()
)
#: Words of any name that make a menu of what is mostly links.
MENU = CERTAIN | DOUBTFUL - frozenset("list links tools meta side extra".split())
CONTENT = frozenset("article body content entry main page post story text hentry column".split())
TAG_SCORE = {"article": 25, "main": 15, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3,
             "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5}
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the text of an article.
HOLDS_TEXT = PARAGRAPH | HEADING | frozenset("ul ol dl dt table thead tbody tfoot tr th caption figure figcaption details summary".split())
LISTS = frozenset("ul ol dl".split())
#: The share of link text from which a list or group that has the sign of a menu is left out.
MOSTLY_LINKS = 0.6


class Node:
    __slots__ = ("tag", "names", "whole", "built", "parent", "children", "never", "dropped", "score", "length", "linked")

    def __init__(
        self, tag: str, parent: Node | None, names: frozenset = frozenset(), whole: frozenset = frozenset(),
        built: frozenset = frozenset(), hidden: bool = False,
    ):
        self.tag, self.parent, self.names, self.whole, self.built = tag, parent, names, whole, built
        self.children: list[Node | str] = []
        self.never = self.dropped = hidden or tag in DROPPED
        self.score, self.length, self.linked = 0.0, 0, 0


def parsed(html: str) -> Node:
    """A tree of elements and their decoded text; tags that are left open or out of order do no harm."""
    root = at = Node("html", None)
    place, end = 0, len(html)
    while place < end:
        found = MARKUP.search(html, place)
        text = html[place:found.start() if found else end]
        if text:
            at.children.append(unescape(text) if "&" in text else text)
        if not found:
            break
        place = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            at = closed(at, tag)
            continue
        if tag == "html":
            continue
        if tag in BLOCK and tag != "body":
            at = up(at, {"p"}, BLOCK - {"p"})
        if tag in HEADING and at.tag in HEADING:
            at = at.parent or at
        if tag in CLOSES:
            at = up(at, *CLOSES[tag])
        node = Node(tag, at, *described(found[3], tag))
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, place)
            place = close.end() if close else end
        elif tag not in VOID and not found[3].endswith("/"):
            at = node
        elif found[3].endswith("/") and tag not in VOID and tag in BLOCK:
            at = node  # a slash doesn't close an element of HTML
    return root


def described(attributes: str, tag: str) -> tuple[frozenset, frozenset, frozenset, bool]:
    """The words in what an element is called, those of names that are listed whole, those of names whose
    other words tell how the page is built, and whether it is hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return frozenset(), frozenset(), frozenset(), False
    words, whole, built, hidden = set(), set(), set(), False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "itemprop"):
            for called in value.split():
                own = words_of(called)
                words |= own
                if name == "id" and tag in HEADING:
                    continue  # a heading's id repeats its text
                decisive, doubtful = own & CERTAIN, own <= DOUBTFUL
                # `cookie-notice` is as decisive as its parts.
                if own and (doubtful or own <= CERTAIN and not own <= TOPICAL):
                    whole |= own
                topic = name == "id" and tag == "section" and own <= TOPICAL
                layout = "sidebar" in own and own & {"content", "main"}
                if doubtful or decisive and own <= CERTAIN | DOUBTFUL | STRUCTURE and not topic and not layout:
                    built |= decisive or own
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return frozenset(words), frozenset(whole), frozenset(built), hidden


@lru_cache(10_000)
def words_of(called: str) -> frozenset:
    """The words of a name: `commentList`, `comment-list` and `commentlist` have the same two."""
    found: set[str] = set()
    for word in (w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", called)):
        known = word in CERTAIN or word in DOUBTFUL or word in CONTENT
        cuts = () if known else range(2, len(word) - 1)
        joined = next((
            (word[:n], word[n:]) for n in cuts
            if word[:n] in CERTAIN and word[n:] in STRUCTURE or word[:n] in STRUCTURE and word[n:] in CERTAIN
        ), (word,))
        found.update(joined)
    return frozenset(found)


def up(at: Node, tags: set[str], stop: frozenset | set[str]) -> Node:
    """The parent of the nearest open element of `tags` that is not beyond one of `stop`; else where we are."""
    node = at
    while node and node.tag not in stop:
        if node.tag in tags:
            return node.parent or at
        node = node.parent
    return at


def closed(at: Node, tag: str) -> Node:
    if tag in ("html", "body"):
        return at  # what follows still belongs to the page
    node = at
    while node and node.tag != tag:
        if tag not in BLOCK and node.tag in BLOCK:
            return at
        node = node.parent
    return (node.parent or at) if node else at


def walked(root: Node) -> Iterator[Node]:
    """All elements, parents first, without recursion."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]


def main_text(html: str) -> str:
    """The article of a page: blocks in page order, joined by an empty line."""
    root = parsed(html)
    order = list(walked(root))
    holds = marked(order)
    kept = [n for n in order if not n.dropped]
    weighed(kept)
    scored(kept)
    chosen = container(root, kept)
    for top in chosen:
        if top.tag not in ("html", "body"):
            restored(top, holds)
    return "\n\n".join(blocks(chosen))


def marked(order: list[Node]) -> set[Node]:
    """Mark what can't be of the article, and all below it; gives the elements that hold the article."""
    holds: set[Node] = set()
    for node in reversed(order):  # children first
        heart = node.tag in ("main", "h1") or node.tag == "article" and not node.names & CERTAIN
        if not node.dropped and (heart or node in holds) and node.parent:
            holds.add(node.parent)
    articles: set[Node] = set()  # and what is in them
    for node in order:
        if node.tag == "article" or node.parent in articles:
            articles.add(node)
        if node.parent and node.parent.dropped:
            node.dropped = True
        elif node.tag not in ("html", "body", "main") and node not in holds and not node.dropped:
            node.dropped = unfit(node, node.parent in articles)
            if node.tag == "header" and not inside(node, ("article", "main")):
                node.dropped = True
    return holds


def unfit(node: Node, within: bool) -> bool:
    """Whether an element's names say that it isn't text of the article; `within` is inside it."""
    if node.tag in HOLDS_TEXT - LISTS:
        names = node.whole
    else:
        names = node.built if within or node.tag in LISTS else node.names
    doubtful = names & DOUBTFUL and not node.names & CONTENT and node.tag not in HOLDS_TEXT
    return bool(names & CERTAIN or doubtful and not (within and node.tag == "section"))


def restored(top: Node, holds: set[Node]) -> None:
    """Inside the chosen container, what went for a word of a longer name is back."""
    inner = list(walked(top))
    for node in inner[1:]:
        node.dropped = node.never or node.parent.dropped or node not in holds and node.tag != "main" and unfit(node, True)
        if node.tag == "header" and not inside(node, ("article", "main")):
            node.dropped = True
    for node in inner:
        node.length = node.linked = 0
    above, top.parent = top.parent, None
    weighed([n for n in inner if not n.dropped])
    top.parent = above


def inside(node: Node, tags: tuple[str, ...]) -> Node | None:
    """The outermost element of `tags` around a node or the node itself."""
    found = None
    while node:
        if node.tag in tags:
            found = node
        node = node.parent
    return found


def weighed(kept: list[Node]) -> None:
    """Text lengths, in links and in all."""
    for node in reversed(kept):
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.length += own
        if node.tag == "a":
            node.linked = node.length
        if node.parent:
            node.parent.length += node.length
            node.parent.linked += node.linked


def scored(kept: list[Node]) -> None:
    """The points of paragraphs for their ancestors."""
    for node in kept:
        node.score += TAG_SCORE.get(node.tag, 0) + 25 * bool(node.names & CONTENT)
    for node in kept:
        if not node.length or not paragraph(node):
            continue
        commas = sum(c.count(",") + c.count("，") + c.count("、") for c in texts_of(node))
        points = (1 + commas + min(node.length / 100, 3)) * (1 - node.linked / node.length)
        above, level = node.parent, 1
        while above and above.tag != "html" and level <= 5:
            above.score += points / (level if level <= 2 else level * 1.5)
            above, level = above.parent, level + 1


def paragraph(node: Node) -> bool:
    """A paragraph by its tag, or a block with text of its own and no block in it."""
    if node.tag in PARAGRAPH:
        return True
    return node.tag in BLOCK - HEADING and node.tag != "body" and not any(
        c.tag in BLOCK for c in node.children if not isinstance(c, str)
    )


def texts_of(node: Node) -> Iterator[str]:
    for below in walked(node):
        if not below.dropped:
            yield from (c for c in below.children if isinstance(c, str))


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def container(root: Node, kept: list[Node]) -> list[Node]:
    """The best container, or it and those of its siblings that go with it."""
    able = [n for n in kept if n.tag in BLOCK - HEADING and n.length and (n.tag == "td" or not paragraph(n))]
    if not able:
        return [root]
    best = max(able, key=lambda n: n.score * (1 - density(n)))
    # An article is whole: a section of it that scores best stands for all of it.
    whole = inside(best, ("article", "main"))
    best = whole or best
    if whole or not best.parent or best.tag == "body":
        return [best]
    least = max(10.0, 0.2 * best.score)
    group = [c for c in best.parent.children if not isinstance(c, str) and not c.dropped]
    return [
        c for c in group
        if c is best or c.tag in HEADING
        or paragraph(c) and density(c) < 0.25
        or c.tag in BLOCK and c.score * (1 - density(c)) >= least
    ]


def headed(nodes: list[Node]) -> set[Node]:
    """The elements below the nodes that hold a heading or stand right behind one."""
    found: set[Node | None] = set()
    inner = [n for top in nodes for n in walked(top) if not n.dropped]
    for node in reversed(inner):
        if node.tag in HEADING or node in found:
            found.add(node.parent)
    for node in inner:
        below = [c for c in node.children if not isinstance(c, str) and not c.dropped]
        found.update(c for before, c in zip(below, below[1:]) if before.tag in HEADING)
    return found


def menus(nodes: list[Node]) -> set[Node]:
    """Lists and groups that are mostly links and look like a menu: by a word in their names or, unless
    the article is marked as one, by holding links alone and standing under no heading."""
    marked_up = any(inside(n, ("article", "main")) or n.names & CONTENT for n in nodes if n.tag != "body")
    titled = headed(nodes)
    return {
        n for top in nodes for n in walked(top)
        if n.tag in ("ul", "ol", "div", "table", "section", "dl") and density(n) > MOSTLY_LINKS
        and (n.names & MENU and n is not top or not marked_up and n.linked == n.length and n not in titled)
    }


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of blocks below the nodes; lists and groups that are menus are left out."""
    left_out = menus(nodes)
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.dropped or item in left_out:
            continue
        else:
            if item.tag == "br":
                line.append(" ")
            block = item.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo += reversed(item.children)
    flush()
    return out


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of `pages` but `html`, with `text` and `n_chars` (columns of these names are replaced).

    `text` is the main text of the whole page; `n_chars` its code points. Character references are
    decoded, white space within a block is one blank, blocks stand in page order with an empty line
    between. Null and empty pages, and pages without any text, give an empty text. Cut-off pages and
    tags that are out of order are read as far as they go. Repeated rows stay; an empty table gives
    an empty one.

    The page is parsed into a tree. What is never article goes: scripts, menus, headers, footers,
    sidebars, forms, hidden elements, and what calls itself advert, notice, comment and so on, unless
    it holds the page's article. Inside the article, and for lists, a longer name counts if its other
    words tell how the page is built (`user-comments`, `ad-slot`), not if they tell a topic
    (`related-work`); for tables, headings and paragraphs only whole names count (`cookie-notice`), and
    not topics (`search`). A list of links is left out only if it looks like a menu. Each paragraph then earns points by its length and commas, less its
    share of links, for the elements around it, fewer with distance; the container with the most
    points, less its own share of links, is kept with the siblings that belong to it.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*rest, F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page) if page else "" for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in rest), pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"],
            )

    kind = rows.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return in_batches(rows).mapInArrow(run, kind)

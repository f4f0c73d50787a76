"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and commas to its ancestors,
fewer the further up (all of them to an article or main element around it);
a container's points are discounted by the share of its text that stands in
links, and by names that tell of something beside the article. The container
with the most points is kept, with the siblings that belong to it, and its
blocks make the text. Inside it, parts that are named as comments, adverts,
notices, menus, sidebars, headers, footers or forms and nothing else are left
out; other names only where the text doesn't read like prose.

A form isn't part of the text, unless the page stands in it: then it is a
container like others.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of elements and of the parts that aren't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option title canvas iframe object audio video".split())
INLINE = frozenset("svg g text tspan math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("head nav footer aside button fieldset menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation menu menus menubar breadcrumb breadcrumbs masthead footer sidebar sidebars aside widget widgets notice notices cookie cookies consent gdpr alert alerts popup popups modal overlay newsletter subscribe subscription signup login register form search comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations pagination pager toolbar disclaimer skip".split()
)
#: Those of them that name what never is the article, whatever it reads like.
NEVER_NAMES = OUTSIDE_NAMES - frozenset("search share sharing social related recommended recommendations subscribe subscription respond reply widget widgets promotion skip register alert alerts disclaimer".split())
#: Names that also count inside a line.
ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsored".split())
#: Void elements that end a line; the others stand inside words.
BREAKS = frozenset("br hr".split())
#: Words that say nothing of their own beside one of those names, and words
#: that turn a name into something about the layout of another part.
NEUTRAL_NAMES = frozenset("area bar block blog body bottom box btn button card col column container content div entry field fixed float global group head header holder icon id in inline inner is item items js large left link links list main mini module my news outer page pane panel post primary reader readers right row secondary section site small posts articles stories sticky strip text thread tile title top unit user users wide wrap wrapper zone article".split())
MODIFIERS = frozenset("no not non has have with without".split())
#: What is left of an element's points by its name: no other name, some other.
NAMED, PARTLY_NAMED = 0.1, 0.5
#: Characters from which on a block counts as prose, for what a form holds,
#: and for a part named as something that may be the article's too.
PROSE_CHARS, PROSE_PART = 80, 200
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: An element that an implied end doesn't reach beyond.
SCOPES = frozenset("html body div section article main table ul ol dl nav header footer aside form td th blockquote".split())

#: A value without quotes ends at white space or at the end of the tag.
_ONE = r"%s(?:\s*+=\s*+(?:\"%s\"|'%s'|%s))?"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _ONE % (r"[^\s/>][^\s/>=]*+", r"[^\"]*+", r"[^']*+", r"[^\s>]*+") + r")*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(_ONE % (r"([^\s/>][^\s/>=]*+)", r"([^\"]*+)", r"([^']*+)", r"([^\s>]*+)"))
#: A slash that belongs to such a value doesn't close the element.
_SLASH_OF_VALUE = re.compile(r"=\s*[^\s>\"']+/\s*\Z")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Node:
    """An element, with the texts and elements inside it in page order.

    ``named``: 3 if its class or id names what never is the article, 2 if it
    names something else beside it, 1 if in part; ``factor``: what is left of
    points inside it; ``prose``: unlinked characters of its longer blocks."""

    __slots__ = ("chars", "factor", "inside", "kids", "linked", "links", "named", "outside", "points", "prose", "tag", "total", "up")

    def __init__(self, tag: str, up: Node | None, outside: bool = False, named: int = 0):
        self.tag, self.up, self.outside, self.named = tag, up, outside, named
        self.kids: list[Node | str] = []
        self.inside = bool(up and (up.inside or up.tag in ("article", "main")))
        self.factor = (up.factor if up else 1.0) * (1.0, PARTLY_NAMED, NAMED, NAMED)[named]
        self.cleared()

    def cleared(self) -> None:
        self.points = self.total = self.chars = self.linked = self.prose = 0.0
        self.links = 0


def _named(names: str, header: bool) -> int:
    """Whether a class or id is one of a part beside the article: 2 if all its
    words are such names or neutral (3 if one is never the article's), 1 if
    some are names."""
    most = 0
    for name in names.split():
        parts = {x.lower() for x in _NAME_PART.findall(name)}
        own = parts & OUTSIDE_NAMES | ({"header"} & parts if header else set())
        if own and not parts & MODIFIERS:
            whole = all(x in own or x in NEUTRAL_NAMES or x.isdigit() for x in parts)
            most = max(most, (3 if own & NEVER_NAMES or "header" in own else 2) if whole else 1)
    return most


def _judged(tag: str, attributes: str, up: Node) -> tuple[bool, int]:
    """Whether an element isn't part of the main text by tag, role or style,
    and what its names tell."""
    inside = up.inside or up.tag in ("article", "main")
    outside = tag in OUTSIDE or tag == "header" and not inside
    if not attributes.strip():
        return outside, 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    outside = outside or "hidden" in found or found.get("role", "").lower() in OUTSIDE_ROLES or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    if tag in HEADINGS or tag in ("html", "body", "main", "article"):
        return outside, 0
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in INLINE:
        return outside, 3 if ADVERT_NAMES & set(names.lower().split()) else 0
    return outside, _named(names, not inside)


def _closed(attributes: str) -> bool:
    """Whether a start tag is its element's end too."""
    return attributes.rstrip().endswith("/") and not _SLASH_OF_VALUE.search(attributes)


def parse(page: str) -> Node:
    """The tree of a page; ends that are missing are implied."""
    root = Node("html", None)
    here, at, n = root, 0, len(page)
    held: Counter[str] = Counter()  # open elements by tag, so that no end without a start is searched for

    def up_from(node: Node) -> Node:
        """Close what is open down to and with ``node``."""
        nonlocal here
        while here is not node:
            held[here.tag] -= 1
            here = here.up
        held[node.tag] -= 1
        return node.up

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside raw text
            continue
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2] or page[at - 1] != ">":  # no tag, or one cut short by the page's end
            continue
        tag = m[2].lower()
        if m[1]:
            if held[tag]:
                node = here
                while node.tag != tag:
                    node = node.up
                here = up_from(node)
            elif tag == "p":
                here.kids.append(Node("br", here))
            continue
        if tag in RAW:
            if not _closed(m[3]):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in ("html", "body"):
            continue
        if tag not in INLINE and tag not in VOID:
            # A block ends an open paragraph, and the inline elements in it.
            if held["p"] or any(held[x] for x in CLOSES.get(tag, ())):
                node = here
                while node.up and node.tag not in SCOPES:
                    if node.tag == "p" or node.tag in CLOSES.get(tag, ()):
                        here = up_from(node)
                        break
                    node = node.up
            if tag in CLOSES and here.tag in CLOSES[tag] and here.up:
                here = up_from(here)
        node = Node(tag, here, *(_judged(tag, m[3], here) if tag not in VOID and (tag not in INLINE or m[3]) else ()))
        here.kids.append(node)
        if tag not in VOID and not _closed(m[3]):
            here = node
            held[tag] += 1
    if at < n:
        rest = page[at:]
        here.kids.append(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", rest))  # a tag cut short
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Nodes that aren't outside: (node, False) before and (node, True) after
    their content."""
    stack = [(root, False)]
    while stack:
        node, after = stack.pop()
        yield node, after
        if not after:
            stack.append((node, True))
            stack.extend((k, False) for k in reversed(node.kids) if isinstance(k, Node) and not k.outside)


def score(root: Node) -> None:
    """Points, characters, links and linked characters of every node."""
    for node, after in _walk(root):
        if not after:
            node.cleared()
            continue
        text = [k for k in node.kids if isinstance(k, str)]
        node.chars += sum(len(t.strip()) for t in text)
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        up = node.up
        if up:
            up.chars += node.chars
            up.linked += node.linked
            up.links += node.links
        if node.tag in INLINE or node.tag in VOID:
            continue
        own = sum(len(t.strip()) for t in text) + sum(k.chars for k in node.kids if isinstance(k, Node) and k.tag in INLINE and not k.outside)
        if own < 1:
            continue
        commas = sum(t.count(",") for t in text)
        points = (1 + commas + min(own / 100, 3)) * (1 - node.linked / max(node.chars, 1)) * node.factor
        node.total += points
        if own >= PROSE_CHARS and node.named < 2:
            node.prose += own * (1 - node.linked / max(node.chars, 1))
        target, level = (up if node.tag in PARAGRAPHS and up else node), 1
        while target is not None and level < 6:
            target.points += points / level
            target, level = target.up, level + 1 if level == 1 else level * 2
    for node, after in _walk(root):
        if not after:
            continue
        if node.up:
            node.up.total += node.total
            node.up.prose += node.prose
        if node.tag in ("article", "main"):  # all points, however deep they are
            node.points = node.total * (1.25 if node.tag == "article" else 1.0)
        node.points *= 1 - node.linked / max(node.chars, 1)


def _beside(node: Node) -> bool:
    """Whether a part of the best container doesn't belong to the text: it has
    the name of something else and doesn't read like prose, or is a menu."""
    if node.outside or node.named == 3:
        return True
    density = node.linked / max(node.chars, 1)
    if node.named == 2:
        return density > 0.1 or node.chars < PROSE_PART
    if node.named:
        return density > 0.3 or node.chars < 60
    return node.tag not in INLINE and node.tag not in PARAGRAPHS and node.links > 2 and density > 0.8 and node.linked / node.links < 30


def chosen(root: Node) -> list[Node]:
    """The container with the most points, and the siblings that belong to it."""
    score(root)
    forms = [node for node, after in _walk(root) if not after and node.tag == "form"]
    if forms:
        for form in forms:
            form.outside = not form.prose or 2 * form.prose < root.prose
        score(root)
    best = root
    for node, after in _walk(root):
        if not after and node.tag not in INLINE and node.points > best.points:
            best = node
    if not best.up:
        return [best]
    headed = any(k.tag in HEADINGS for k, after in _walk(best) if not after)
    kept, before = [], True
    for k in best.up.kids:
        if k is best:
            kept.append(k)
            before = False
        elif isinstance(k, Node) and k.chars and not _beside(k):
            density = k.linked / max(k.chars, 1)
            paragraph = k.tag in PARAGRAPHS and k.tag not in HEADINGS and density < 0.3 and best.tag not in ("article", "main")
            heading = k.tag in HEADINGS and density < 0.5 and before and not headed
            if paragraph or heading or (k.tag not in INLINE and k.tag not in PARAGRAPHS and k.points >= max(2.0, 0.2 * best.points) and density < 0.3):
                kept.append(k)
    return kept


def blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of the blocks, in page order, white space not yet joined."""
    run: list[str] = []
    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None or isinstance(x, Node) and x.tag not in INLINE and (x.tag not in VOID or x.tag in BREAKS):
                if run:
                    yield "".join(run)
                    run = []
            if isinstance(x, str):
                run.append(x)
            elif isinstance(x, Node) and (x is top or not _beside(x)):
                if x.tag not in INLINE and x.tag not in VOID:
                    stack.append(None)
                stack.extend(reversed(x.kids))
        if run:
            yield "".join(run)
            run = []


def main_text(page: str) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = (" ".join(html.unescape(b).split()) for b in blocks(chosen(parse(page))))
    return " ".join(b for b in found if b)


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row a row: page_id, url, text, n_chars (code points).

    A null or empty page, and one without text, has the empty text. Text that
    isn't HTML is one block. A page is read whole, however long or deep; of
    containers with equal points the outer and earlier one is kept. Repeated rows give the same text each; an empty
    table gives no rows; extra columns are ignored.
    """
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), pages[page].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x.as_py() or "") for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars bigint")

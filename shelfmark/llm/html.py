"""Main text of a page by tree scoring: paragraphs pass points to their ancestors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp title svg math object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("head nav header footer aside form button select menu dialog label input".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class or id that mark what is hardly the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments "
    "consent cookie cookies disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promotion related replies responses share sharing sidebar signup "
    "skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
#: Part of its points that a marked element keeps if it is not dropped.
MARKED = 0.5
#: An open element that a new one of the given name ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_SCOPES = frozenset("table ul ol dl body html article section div td th main blockquote".split())
_KEEPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "marked", "points", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, marked: str = ""):
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped, marked
        self.children: list[Node | str] = []
        self.points, self.length, self.linked = 0.0, 0, 0


def _is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _marks(tag: str, attributes: str) -> str:
    if not attributes or tag in ("html", "body", "main") or re.fullmatch("h[1-6]", tag):
        return ""
    found = [m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")]
    return " ".join(sorted({w.lower() for value in found for w in NAME.findall(value)} & MARKS))


def parse(page: str) -> Node:
    """The tree of a page. Elements that are no part of the article are dropped, with all below them; doubtful ones marked."""
    root = Node("#root", None, False)
    at, end, size = root, 0, len(page)
    raw_end = ""
    while end < size:
        if raw_end:  # everything up to the closing tag is the content of a raw element
            found = re.compile(rf"</{raw_end}\b", re.I).search(page, end)
            raw_end, end = "", found.start() if found else size
            continue
        begin = page.find("<", end)
        match = TOKEN.match(page, begin) if begin >= 0 else None
        if begin < 0 or match is None:
            stop = size if begin < 0 else begin + 1
            at.children.append(page[end:stop])
            end = stop
            continue
        if begin > end:
            at.children.append(page[end:begin])
        end = match.end()
        if match[2] is None:
            if match[0].startswith("<![CDATA["):
                at.children.append(match[0][9:].removesuffix("]]>"))
            continue
        tag = match[2].lower()
        if match[1]:
            up = at
            while up is not root and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root  # an inline end tag does not reach beyond its block
                    break
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            up = at
            while up is not root and up.tag not in _SCOPES and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in ENDS:
            up, last = at, None
            while up is not root and up.tag not in _KEEPS[tag]:
                if up.tag in ENDS[tag]:
                    last = up
                up = up.parent
            if last is not None:
                at = last.parent
        if tag == "body" and any(isinstance(c, Node) and c.tag == "html" for c in root.children) and at.tag not in ("html", "#root"):
            while at is not root and at.tag != "html":  # a head that was never closed
                at = at.parent
        node = Node(tag, at, at.dropped or _is_boilerplate(tag, match[3] or ""), _marks(tag, match[3] or ""))
        at.children.append(node)
        if tag in VOID or match[0].endswith("/>") and tag not in BLOCK:
            continue
        at = node
        raw_end = tag if tag in RAW else ""
    return root


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Nodes and texts in page order; each kept node twice, on entry and (True) on exit."""
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, leaving = stack.pop()
        yield item, leaving
        if isinstance(item, Node) and not leaving:
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children) if isinstance(c, str) or not c.dropped)


def _drop_marked(root: Node) -> None:
    """Drops the marked elements but those that hold the article: ``main``, the largest article, or else most of the page.

    Elements of the same marks hold most of a page together, so that one cut into widgets stays. An article that
    is marked itself (a comment) counts if it is most of the page.
    """
    size: dict[int, int] = {}
    open_: list[Node] = []
    marked: list[Node] = []
    chosen: list[Node] = []
    articles: list[Node] = []
    links = 0
    for item, leaving in _walk(root):
        if isinstance(item, str):
            if open_ and not links:
                size[id(open_[-1])] = size.get(id(open_[-1]), 0) + len(" ".join(item.split()))
        elif not leaving:
            open_.append(item)
            links += item.tag == "a"
            if item.marked:
                marked.append(item)
            if item.tag == "main":
                chosen.append(item)
            elif item.tag == "article":
                articles.append(item)
        else:
            open_.pop()
            links -= item.tag == "a"
            if item.parent is not None:
                size[id(item.parent)] = size.get(id(item.parent), 0) + size.get(id(item), 0)
    if not marked:
        return
    whole = size.get(id(root), 0)
    plain = [a for a in articles if not a.marked] or [a for a in articles if 2 * size.get(id(a), 0) > whole]
    chosen = [n for n in chosen if size.get(id(n), 0)]
    if plain:
        chosen.append(max(plain, key=lambda a: size.get(id(a), 0)))
    held: set[int] = set()
    for n in chosen:
        up: Node | None = n
        while up is not None:
            held.add(id(up))
            up = up.parent
    inner: set[int] = set()
    group: dict[str, int] = {}
    for n in marked:
        up = n.parent
        while up is not None and up.marked != n.marked:
            up = up.parent
        if up is not None:
            inner.add(id(n))
        else:
            group[n.marked] = group.get(n.marked, 0) + size.get(id(n), 0)
    for n in marked:
        held_text = size.get(id(n), 0) if id(n) in inner else group[n.marked]
        if id(n) not in held and (chosen or 2 * held_text <= whole):
            n.dropped = True


def blocks(top: list[Node]) -> list[str]:
    """The texts of blocks in page order, white space made single, references decoded."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    for root in top:
        for item, _ in _walk(root):
            if isinstance(item, str):
                now.append(item)
            elif item.tag in BLOCK:
                flush()
            elif item.tag in VOID:
                now.append(" ")
        flush()
    return out


def _score(root: Node) -> list[Node]:
    """Sets length, linked length and points; returns the nodes that got points."""
    links = 0
    order: list[Node] = []
    commas: dict[int, int] = {}
    for item, leaving in _walk(root):
        if isinstance(item, str):
            text = " ".join(item.split())
            holder = order[-1] if order else root
            holder.length += len(text)
            holder.linked += len(text) * bool(links)
            commas[id(holder)] = commas.get(id(holder), 0) + sum(text.count(c) for c in ",，、،")
        elif not leaving:
            order.append(item)
            links += item.tag == "a"
        else:
            order.pop()
            links -= item.tag == "a"
            up = item.parent
            own = commas.get(id(item), 0)
            is_text = item.tag in PARAGRAPHS or item.tag in ("div", "section", "article", "main", "body") and any(
                isinstance(c, str) and c.strip() for c in item.children
            )
            if is_text and item.length > 0:
                gained = (1 + own + min(item.length / 100, 3)) * (1 - item.linked / item.length)
                # a container with text of its own counts as a paragraph for itself as well
                above, share = (up if item.tag in PARAGRAPHS else item), 1.0
                level = 0
                while above is not None and above.tag != "#root":
                    above.points += gained * share
                    level += 1
                    share = 0.5 if level == 1 else 1 / (3 * level)
                    above = above.parent
            if up is not None:
                up.length += item.length
                up.linked += item.linked
                if item.tag not in PARAGRAPHS or up.tag in PARAGRAPHS:
                    commas[id(up)] = commas.get(id(up), 0) + (own if item.tag not in BLOCK else 0)
    return [n for n, leaving in _walk(root) if isinstance(n, Node) and not leaving and n.points > 0]


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def extract(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page and one without text of its own."""
    if not page:
        return ""
    root = parse(page)
    _drop_marked(root)
    found = _main(root)
    if found:
        return found
    return _main(parse(page))  # marks may have taken all there is


def _main(root: Node) -> str:
    scored = _score(root)
    containers = [n for n in scored if n.tag not in ("html", "#root")]
    if not containers:
        return "\n\n".join(blocks([root]))
    value = {id(n): n.points * (1 - _density(n)) * (MARKED if n.marked else 1) for n in containers}
    best = max(containers, key=lambda n: value[id(n)])
    up = best
    while up.parent is not None:  # the element that says it is the article, if the best is inside one
        up = up.parent
        if up.tag in ("article", "main"):
            best = up
    if best.parent is None or best.tag in ("body", "article", "main"):
        kept = [best]
        if best.tag == "article":
            kept = [c for c in best.parent.children if c is best or isinstance(c, Node) and c.tag == "article" and not c.dropped and value.get(id(c), 0) >= 0.2 * value.get(id(best), 0)]
        return "\n\n".join(blocks(kept))
    least = max(1.0, 0.2 * value[id(best)])
    kept = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif isinstance(c, Node) and not c.dropped and c.length:
            prose = c.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and _density(c) < 0.25
            if prose or value.get(id(c), 0) >= least and _density(c) < 0.5:
                kept.append(c)
    return "\n\n".join(blocks(kept))


def main_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` (code points) for each row of ``pages``.

    Null and empty pages, and pages without text, give an empty text. Rows are worked on alone, so repeated
    rows give repeated results. Columns not in ``keep`` are left out, so that no name can clash.
    """
    kept = [f for f in pages.schema.fields if f.name in keep and f.name not in ("text", "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(page.as_py()) for page in batch.column("_html")]
            columns = [*[batch.column(f.name) for f in kept], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "text", "n_chars"])

    return pages.select(*[f.name for f in kept], F.col(html).alias("_html")).mapInArrow(run, schema)

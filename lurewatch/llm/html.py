"""Main text of web pages: paragraphs score their ancestors, the best container and its good siblings stay."""

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import functions as F

_token = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_cut_tag = re.compile(r"</?[a-zA-Z][^<>]*$|<!?$")
_name = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_parts = re.compile(r"[a-z0-9]+")

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "button", "select", "dialog", "menu", "head", "fieldset"}
MAIN = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "html",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "div", "article", "main", "section", "figcaption"}
#: Words in a class, id or role that mark what does not belong to an article.
UNWANTED = {
    "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "header", "notice", "notices", "cookie",
    "cookies", "consent", "gdpr", "comment", "comments", "disqus", "reply", "replies", "respond", "related", "share",
    "sharing", "social", "subscribe", "newsletter", "signup", "login", "popup", "modal", "widget", "pagination",
    "pager", "contentinfo", "complementary", "search", "alert",
}
#: Of these, the words for what readers write: never the article, however long.
READERS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: First words of names that tell what stands elsewhere on the page, and words of containers of articles.
STATES = {"has", "no", "with", "without"}
CONTENT = {"article", "body", "column", "content", "entry", "main", "page", "post", "story", "text"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl"}
CLOSED_BY_BLOCK = {"p"} | HEADINGS
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SHORT = 25
#: Points from which a block with an unwanted name counts as large.
LARGE = 10


@dataclass(frozen=True)
class Mark:
    """What a class, id or role says against a block: how much (0 the most), where, and around what it stands."""

    level: int
    names: str
    in_main: bool
    outer: object

    def kept(self, names):
        """Whether the block stays, given the (level, names, in_main) that do."""
        if (self.level, self.names, self.in_main) not in names:
            return False
        outer = self.outer
        while outer is not None:
            if outer.level < 2 and (outer.level, outer.names, outer.in_main) not in names:
                return False
            outer = outer.outer
        return True


def _level(tag, attributes):
    """(level, names) of a block's class, id and role: 0 readers' texts, 1 a name of unwanted words only, 2 a name
    with one, 3 the same beside a word for content, or a form; None if nothing is unwanted."""
    if tag in ("html", "body"):
        return None
    names = [n for m in _name.findall(attributes) for n in "".join(m).lower().split()]
    words = [set(w) for n in names if (w := _parts.findall(n)) and w[0] not in STATES]
    unwanted = UNWANTED - {"header", "masthead"} if tag in HEADINGS else UNWANTED
    found = [w for w in words if w & unwanted]
    if not found and tag == "form":
        level = 3
    elif any(w <= unwanted for w in found):
        level = 0 if any(w & READERS for w in found) else 1
    elif not found or tag in HEADINGS:
        return None
    else:
        level = 0 if any(w & READERS for w in found) else 3 if any(w & CONTENT for w in words) else 2
    return level, " ".join([tag, *names])


def _points(text, tag):
    """Points of a block of text: one, one for each comma and up to three for its length."""
    return 1 + text.count(",") + min(len(text) // 100, 3) if len(text) >= SHORT and tag in PARAGRAPHS else 0


@dataclass
class Node:
    tag: str
    parent: object
    dropped: bool
    mark: object = None
    in_main: bool = False
    score: float = 0.0
    chars: int = 0
    linked: int = 0


class Page:
    """Blocks of text of a page with the element each stands in, and the scores of the elements."""

    def __init__(self, html):
        self.root = Node("#root", None, False)
        self.here = self.root
        self.blocks = []
        self.nodes = []
        self.inline = []
        self.in_link = 0
        self._read(html)
        self._end_block()
        self._decide()
        self._score()

    def _read(self, html):
        at = 0
        while True:
            found = _token.search(html, at)
            if found is None:
                rest = html[at:]
                self._text(_cut_tag.sub("", rest) if "<" in rest else rest)
                return
            self._text(html[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
            elif tag in RAW and not found[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            else:
                self._open(tag, found[3])

    def _end_head(self):
        """A head without an end ends where something begins that cannot stand in it."""
        if self.here.tag == "head":
            self.here = self.here.parent

    def _text(self, text):
        if self.here.tag == "head" and text.strip():
            self._end_head()
        if text and not self.here.dropped:
            self.inline.append((text, self.in_link > 0))

    def _open(self, tag, attributes):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.inline.append((" ", False))
            return
        if tag not in BLOCKS:
            self.in_link += tag == "a"
            return
        self._end_block()
        self._end_head()
        if tag in ITEMS:
            self._leave(ITEMS[tag], {"ul", "ol", "dl", "table", "menu"} | MAIN)
        elif self.here.tag in CLOSED_BY_BLOCK:
            self.here = self.here.parent
        here, level = self.here, _level(tag, attributes) if attributes or tag == "form" else None
        if tag == "body" or tag in MAIN and level is None:
            self.here = Node(tag, here, False, None, tag in MAIN or here.in_main)
        else:
            mark = here.mark if level is None else Mark(*level, here.in_main, here.mark)
            self.here = Node(tag, here, here.dropped or tag in DROPPED, mark, here.in_main)
        self.nodes.append(self.here)

    def _leave(self, tags, stop):
        node = self.here
        while node is not self.root and node.tag not in stop:
            if node.tag in tags:
                self.here = node.parent
                return
            node = node.parent

    def _close(self, tag):
        if tag not in BLOCKS:
            self.in_link = max(0, self.in_link - (tag == "a"))
            return
        node = self.here
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self._end_block()
            self.here = node.parent

    def _end_block(self):
        text = " ".join(unescape("".join(t for t, _ in self.inline)).split())
        if text:
            linked = sum(len(t) for t, link in self.inline if link)
            self.blocks.append((text, self.here, min(linked, len(text))))
        self.inline = []
        self.in_link = 0

    def _decide(self):
        """Drop what a class, id or role marks, unless the page would lose its article by it.

        Blocks of the same names count together, by the points of their paragraphs less the share of linked
        characters. Forms and blocks with a word for content stay if they have more than all unmarked blocks; others only
        if no unmarked block has any: first those with part of a name, else large ones with a whole name. What
        stands outside an article or main element that has text stays out, and so do comments of readers.
        """
        plain, main, marked = 0.0, False, {}
        for text, node, linked in self.blocks:
            points = _points(text, node.tag) * (1 - linked / len(text))
            mark = node.mark
            if mark is None:
                plain += points
                main = main or node.in_main
            else:
                key = mark.level, mark.names, mark.in_main
                marked[key] = marked.get(key, 0.0) + points
        if not marked:
            return
        for level, least in ((3, plain), (2, 0.0), (1, LARGE)):
            names = {k for k, p in marked.items()
                     if k[0] == level and p > least and (k[2] or not main) and (level == 3 or plain == 0)}
            if names:
                break
        for node in self.nodes:
            node.dropped = node.dropped or node.mark is not None and not node.mark.kept(names)
        self.blocks = [b for b in self.blocks if not b[1].dropped]

    def _score(self):
        """Each paragraph gives its points to its container in full, to the one above half, and so on."""
        for text, node, linked in self.blocks:
            while node is not None:
                node.chars += len(text)
                node.linked += linked
                node = node.parent
        for text, node, _ in self.blocks:
            points = _points(text, node.tag)
            if not points:
                continue
            target = node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd", "figcaption") else node
            level = 0
            while target is not None and target is not self.root and level < 4:
                target.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                target, level = target.parent, level + 1
        for node in self.nodes:
            node.score *= 1 - (node.linked / node.chars if node.chars else 0)

    def main_text(self):
        best = max(self.nodes, key=lambda n: n.score, default=None)
        if best is None or best.score <= 0:
            areas = [n for n in self.nodes if n.tag in MAIN and n.chars] or [self.root]
            kept = {id(areas[0])}
        else:
            while best.tag not in MAIN and (area := self._area(best)) is not None:
                best = area
            kept = {id(best)}
            least = max(10.0, 0.2 * best.score) if best.tag in MAIN else 0.2 * best.score
            beside = [n for n in self.nodes if n.parent is best.parent and (n is best or not n.dropped and n.chars)]
            for node in beside:
                if node.score >= least or node.tag == "p" and node.chars > 80 and node.linked < 0.25 * node.chars:
                    kept.add(id(node))
            if best.tag not in MAIN:
                kept |= self._between(beside, kept)
        return " ".join(t for t, node, _ in self.blocks if self._inside(node, kept))

    @staticmethod
    def _between(beside, kept):
        """Siblings of few links between kept ones, headings and paragraphs that lead to the first, and lists and
        paragraphs that follow the last."""
        good = [id(n) in kept or n.linked < 0.25 * n.chars for n in beside]
        places = [i for i, n in enumerate(beside) if id(n) in kept]
        first, last = places[0], places[-1]
        while first and good[first - 1] and beside[first - 1].tag in HEADINGS | {"p"}:
            first -= 1
        while last + 1 < len(beside) and good[last + 1] and beside[last + 1].tag in LISTS | {"p", "pre", "blockquote", "table"}:
            last += 1
        return {id(n) for n, g in zip(beside[first : last + 1], good[first : last + 1]) if g}

    def _area(self, node):
        """The article or main element around a node."""
        while node.parent is not None:
            node = node.parent
            if node.tag in MAIN:
                return node
        return None

    @staticmethod
    def _inside(node, kept):
        while node is not None:
            if id(node) in kept:
                return True
            node = node.parent
        return False


def main_text(html):
    return Page(html).main_text() if html else ""


def _extractor(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages):
    """One row per row of ``pages`` (page_id, url, html): (page_id, url, text, n_chars).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers go, by
    element or by a word in their class, id or role; the words alone do not remove what the page's article
    stands in (``Page._decide``). Of the rest, a paragraph of at least ``SHORT`` characters
    gives one point, one for each comma and up to three for its length to its container, half to the next, and
    less further up; each container's sum is discounted by the share of linked characters. The best container
    (or the article around it) and siblings with a fifth of its score are the main text, without an article
    element also headings, lists and blocks of few links between or beside them: all their blocks in page
    order. Without any scoring paragraph, the article element or else the whole page counts. Null, empty and
    textless pages give an empty text; cut or badly nested markup ends where the next block says so.
    Repeated rows keep rows of their own; other columns are not looked at. One scan, no shuffle.
    """
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extractor, f"page_id {kind}, url string, text string, n_chars bigint")

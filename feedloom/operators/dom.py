"""Pages as trees: a tolerant tree builder, the cleaner, and the table of nodes that all scoring starts from.

Building and cleaning a page is sequential by nature, so it is one Python pass over each page; pages are independent.
No step recurses, and each visits a node a bounded number of times, so that neither the depth nor the width of a page
matters. What leaves Python is a flat table of nodes with what is counted below each, and all that compares pages,
candidates or blocks later is native.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Sets of tags.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "dd", "dt"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
HEAD = {"title", "meta", "link", "base", "style", "script", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = {"html", "table", "td", "th", "body", "button", "object", "caption", "marquee", "applet"}
OBJECTS = {"img", "embed", "object", "video", "audio"}
INLINE = {"a", "font", "small", "span", "strong", "em", "dt", "dd", "br", "cite"}
BLOCK = {"div", "p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html", "article", "section", "head", "ol", "ul", "dl", "tbody", "td", "tr", "table", "form", "textarea", "input"}
DROPPED = {"script", "link", "iframe", "nav", "aside", "noscript", "style", "input", "textarea", "marquee"}
PLAIN = DROPPED | {"meta", "title", "head", "body", "br", "article", "h1", "h2", "h3", "h4", "form", "ul", "ol", "table", "td", "th", "option", "img", "a"}
# Parts of names whose elements are dropped, and the bounds below.
UNLIKELY = re.compile("combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter")
FILLS = {"#text", "video", "audio", "object", "embed", "img", "a", "form", "input", "textarea"}
STOP = frozenset("。．？！，、；：“”﹃﹄‘’﹁﹂（）［］〔〕【】—…～《》〈〉﹏＿")
#: White space by Unicode; the separators U+001C to U+001F are none.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE, SHARE, SMALL = 65, 20, 180


class Node:
    __slots__ = ("tag", "attrs", "kids", "text", "up", "open", "size", "filled")

    def __init__(self, tag: str, attrs: dict | None = None, text: str = ""):
        self.tag, self.attrs, self.kids, self.text, self.up = tag, attrs or {}, [], text, None
        self.open, self.size, self.filled = False, 0, False

    def add(self, kid: Node) -> Node:
        kid.up = self
        self.kids.append(kid)
        return kid

    def set(self, kids: list[Node]) -> None:
        self.kids = kids
        for k in kids:
            k.up = self

    def walk(self) -> Iterator[Node]:
        """The node and all below it in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.kids)

    def inner_text(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag == "#text")


class _Builder(HTMLParser):
    """The useful part of tree construction: implied elements, auto-closing, reopened formatting.

    For each tag the places of its open elements in the stack are known, so that looking for one takes no search.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = self.root.add(Node("html"))
        self.head = self.html.add(Node("head"))
        self.body: Node | None = None
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.active: list[Node] = []
        self.alike: dict[tuple, int] = Counter()
        self.parts: dict[int, tuple[Node, list[str]]] = {}
        self.unclosed: str | None = None
        self._push(self.html)

    def _push(self, n: Node) -> None:
        self.places[n.tag].append(len(self.stack))
        self.stack.append(n)
        n.open = True

    def _cut(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.stack) > depth:
            n = self.stack.pop()
            self.places[n.tag].pop()
            n.open = False

    def _in_body(self) -> None:
        if self.body is None:
            self.body = self.html.add(Node("body"))
            self._cut(1)
            self._push(self.body)

    def _last(self, tags: set[str]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _scope(self, tags: set[str], stop: set[str]) -> int:
        """Depth of the nearest open element of these tags, 0 if one of `stop` is nearer."""
        i = self._last(tags)
        return i if i and i >= self._last(stop) else 0

    def _close(self, tags: set[str], stop: set[str]) -> None:
        if i := self._scope(tags, stop):
            self._cut(i)

    def _forget(self, at: int) -> None:
        n = self.active.pop(at)
        self.alike[n.tag, tuple(n.attrs.items())] -= 1

    def _reopen(self) -> None:
        """Formatting that a block has closed goes on: what stands behind the last that is still open."""
        k = len(self.active)
        while k and not self.active[k - 1].open:
            k -= 1
        for k in range(k, len(self.active)):
            old = self.active[k]
            self.active[k] = self.stack[-1].add(Node(old.tag, dict(old.attrs)))
            self._push(self.active[k])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        got: dict = {}
        for k, v in attrs:
            got.setdefault(k, v or "")
        if tag in ("html", "head"):
            return
        if tag == "body":
            self._in_body()
            self.body.attrs = {**got, **self.body.attrs}
            return
        if tag in HEAD and self.body is None:
            node = self.head.add(Node(tag, got))
            if tag not in VOID:
                self._push(node)
            return
        self._in_body()
        if tag == "form" and self.places.get("form"):
            return  # forms do not nest
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._cut(len(self.stack) - 1)
        if tag == "li":
            self._close({"li"}, {"ul", "ol"} | SCOPE)
        elif tag in ("dd", "dt"):
            self._close({"dd", "dt"}, {"dl"} | SCOPE)
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self._cut(len(self.stack) - 1)
        elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            self._close({"td", "th"} if tag in ("td", "th") else {"tr"} if tag == "tr" else {"tbody", "thead", "tfoot"}, {"table"})
            if self.stack[-1].tag == "table" and tag in ("tr", "td", "th"):
                self._push(self.stack[-1].add(Node("tbody")))
            if tag in ("td", "th") and self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self._push(self.stack[-1].add(Node("tr")))
        elif tag == "a":
            old = next((n for n in self.active if n.tag == "a"), None)
            if old is not None:
                self.handle_endtag("a")
                left = next((i for i, n in enumerate(self.active) if n is old), None)
                if left is not None:
                    self._forget(left)
        if tag not in CLOSES_P and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            self._reopen()
        node = self.stack[-1].add(Node(tag, got))
        if tag in VOID:
            return
        self._push(node)
        if tag in FORMATTING:
            sign = tag, tuple(got.items())
            if self.alike[sign] >= 3:  # the standard keeps three alike
                self._forget(next(i for i, n in enumerate(self.active) if n.tag == tag and n.attrs == got))
            self.active.append(node)
            self.alike[sign] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" and self.body is None:
                self._cut(1)
            return
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag == "p" and not self._scope({"p"}, SCOPE):
            self.handle_starttag("p", [])
        stop = {"html"} if tag in ("table", "td", "th", "tr") else {"table"} if tag in ("tbody", "thead", "tfoot") else SCOPE - {tag}
        i = self._scope(HEADINGS if tag in HEADINGS else {tag}, stop)
        if tag in FORMATTING:
            at = next((k for k in range(len(self.active) - 1, -1, -1) if self.active[k].tag == tag), None)
            if at is not None:
                self._forget(at)
            if i and self._last(CLOSES_P) > i:
                return  # a block is open inside: it keeps its place, the formatting ends with it
        if i:
            self._cut(i)

    def handle_data(self, data: str) -> None:
        where = self.stack[-1]
        if self.body is None and where is self.html:
            if not data.strip():
                return
            self._in_body()
        if self.body is not None and where.tag not in ("script", "style", "textarea", "title"):
            if where.tag in ("table", "tbody", "tr", "thead", "tfoot") and not data.strip():
                return
            self._reopen()
            where = self.stack[-1]
        if where.kids and where.kids[-1].tag == "#text":
            last = where.kids[-1]
            self.parts.setdefault(id(last), (last, [last.text]))[1].append(data)
        else:
            where.add(Node("#text", text=data))

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.unclosed is self.rawdata:  # no end of a comment was found from a place before
            return -1
        k = super().parse_comment(i, report)
        if k < 0:
            self.unclosed = self.rawdata
        return k

    def check_for_whole_start_tag(self, i: int) -> int:
        return super().check_for_whole_start_tag(i) if self.rawdata.find(">", i) >= 0 else -1

    def handle_comment(self, data: str) -> None:
        self.stack[-1].add(Node("#comment", text=data))

    def finish(self) -> Node:
        self.close()
        self._in_body()
        for n, parts in self.parts.values():
            n.text = "".join(parts)
        return self.root


def parse(text: str) -> Node:
    """A document; it never fails. Not built: foster parenting and the full adoption agency."""
    b = _Builder()
    b.feed(text)
    return b.finish()


_TOKEN = re.compile("[0-9A-Za-z_]+|[^0-9A-Za-z_]")


_NO_STOP = {ord(c): None for c in STOP}


def count_words(text: str) -> int:
    """The tokens that are no stop characters, all of which are beyond ASCII."""
    n = len(_TOKEN.findall(text))
    return n if text.isascii() else n - len(text) + len(text.translate(_NO_STOP))


# -- counts of a subtree (only what cleaning itself decides by) ---------------------------------------------------


def tally(n: Node, forms: bool = True, tables: bool = True) -> dict[str, int]:
    """Words, linked words, images and linked images below a node; forms and tables are passed over if told to."""
    out = {"words": 0, "anchor_words": 0, "imgs": 0, "anchor_imgs": 0, "anchors": 0}
    todo = [(n, 0)]
    while todo:
        x, links = todo.pop()
        if x.tag == "#text":
            w = count_words(x.text)
            out["words"] += w
            out["anchor_words"] += w * links
        elif x.tag == "img":
            out["imgs"] += 1
            out["anchor_imgs"] += links
        elif x.tag == "a":
            out["anchors"] += 1
            todo += [(k, links + 1) for k in x.kids]
        elif not (x.tag in OBJECTS or x.tag in ("input", "textarea") or (x.tag == "form" and forms) or (x.tag == "table" and not tables)):
            todo += [(k, links) for k in x.kids]
    return out


def density(t: dict[str, int]) -> int:
    if not t["words"]:
        return 100 if t["anchors"] else 0
    return (t["anchor_words"] + 4 * t["anchor_imgs"]) * 100 // (t["words"] + 4 * t["anchor_imgs"])


# -- kinds of nodes ----------------------------------------------------------------------------------------------


def measure(root: Node) -> list[Node]:
    """From below: the bytes of text in each node, and whether a text (even of blanks), a medium, a link or a form stands
    in it. Gives the nodes in document order."""
    order = list(root.walk())
    for n in order:
        n.size, n.filled = (len(n.text.encode()) if n.tag == "#text" else 0), n.tag in FILLS
    for n in reversed(order):
        if n is not root:
            n.up.size += n.size
            n.up.filled = n.up.filled or n.filled
    return order


def _narrow_list(li: Node) -> bool:
    """Items of a list with less than 60 bytes of text stand in one line, as in menus; for nodes that are measured."""
    return li.up is not None and li.up.size < 60


def is_inline(n: Node) -> bool:
    return n.tag == "#text" or n.tag in INLINE or n.tag in OBJECTS or (n.tag == "li" and _narrow_list(n))


def is_block(n: Node) -> bool:
    return n.tag in BLOCK or (n.tag == "li" and not _narrow_list(n))


def has_inline(n: Node) -> bool:
    return any(map(is_inline, n.kids))


# -- cleaning ----------------------------------------------------------------------------------------------------


def _integer(s: str | None) -> int | None:
    try:
        return int(s, 0) if not re.fullmatch(r"0[0-7]+", s or "x") else int(s, 8)
    except (ValueError, TypeError):
        return None


def _tail(text: str) -> str:
    return re.sub(r"[ \t]*[\r\n]+[ \t]*", "\n", re.sub(r"[ \t]+\Z", "", text))


class Page:
    """A cleaned page: its article's root and what was counted on the way."""

    def __init__(self, text: str, url: str):
        self.url, self.counts = url, dict.fromkeys(("text_words", "anchor_words", "table_words", "links", "imgs", "link_imgs", "lis"), 0)
        self.found: dict[str, list[Node]] = {t: [] for t in ("h1", "h2", "h3", "h4", "form", "ul", "ol", "table")}
        self.cells: list[tuple[Node, dict]] = []
        self.article: Node | None = None
        root = parse(text)
        self._strip(root)
        for n in root.kids:
            n.kids = [k for k in n.kids if k.tag != "head"]
        self._narrow()
        if self.article is None:
            self.article = root.add(Node("body"))
        self._cells()
        for form in self.found["form"]:
            if tally(form, forms=False)["words"] * 100 // (1 + self.counts["text_words"]) > 33:
                form.tag = "div"
        if self.article.up is not None:
            self.article.up = None  # what stands around it plays no part from here on
        measure(self.article)
        self._tidy(self.article)
        for n in measure(self.article):
            n.set([k for k in n.kids if k.filled])
        self.nodes = measure(self.article)
        for n in self.nodes:
            n.attrs = {k: v for k, v in n.attrs.items() if k in ("id", "class", "href", "src")}

    def _strip(self, root: Node) -> None:
        """Counts, renames and drops, in document order."""
        frames: list[tuple[Node, bool, Iterator[Node], list[Node]]] = [(root, False, iter(root.kids), [])]
        while frames:
            n, linked, kids, kept = frames[-1]
            k = next(kids, None)
            if k is None:
                n.set(kept)
                frames.pop()
            elif k.tag == "#text":
                kept.append(k)
                k.text = _tail(k.text)
                w = count_words(k.text)
                self.counts["text_words"] += w
                self.counts["anchor_words"] += w * linked
            elif k.tag != "#comment" and not (UNLIKELY.search(k.attrs.get("class", "") + k.attrs.get("id", "")) or k.tag in DROPPED):
                kept.append(k)
                self._count(k, n, linked)
                frames.append((k, linked or k.tag == "a", iter(k.kids), []))

    def _count(self, k: Node, n: Node, linked: bool) -> None:
        if k.tag == "li" or k.tag not in PLAIN:
            style = k.attrs.get("style", "")
            self.counts["lis"] += k.tag == "li"
            if "display" in style and "none" in style:
                k.tag = "input"
        if k.tag in self.found:
            self.found[k.tag].append(k)
        if k.tag == "body":
            self.article = k
        elif k.tag == "br":
            k.tag = "p"
        elif k.tag == "option":
            k.tag = "a"
        elif k.tag in ("td", "th"):
            t = tally(k, tables=False)
            self.cells.append((k, t))
            self.counts["table_words"] += t["words"]
        elif k.tag == "img":
            self.counts["imgs"] += 1
            self.counts["link_imgs"] += linked
            w, h = _integer(k.attrs.get("width")), _integer(k.attrs.get("height"))
            h = _integer(k.attrs.get("heigh")) if h is None else h
            if w is not None and h is not None and w * h < SMALL * SMALL and n.tag == "a":
                k.attrs.pop("src", None)
        elif k.tag == "a":
            self.counts["links"] += 1
            if "href" in k.attrs and self.url:
                try:
                    k.attrs["href"] = urljoin(self.url, k.attrs["href"])
                except ValueError:
                    pass

    def _narrow(self) -> None:
        """Of a page with one main heading, the element around it that holds enough text, if it holds enough of the page."""
        heads = self.found["h1"] or (self.found["h2"] if len(self.found["h2"]) == 1 else [])
        if len(heads) != 1:
            return
        n = heads[0].up
        measure(self._top(n))
        while n is not None and n.size <= 3 * LINE:
            n = n.up
        if n is not None:
            w = tally(n)["words"]
            if w >= LINE and w * 100 // (self.counts["text_words"] + 1) >= SHARE:
                self.article = n

    @staticmethod
    def _top(n: Node) -> Node:
        while n.up is not None:
            n = n.up
        return n

    def _cells(self) -> None:
        """Of a page laid out in a table, the cell with the best score; the first of equal ones."""
        if self.cells and self.counts["table_words"] * 100 // (self.counts["text_words"] + 1) >= 33:
            worth = lambda t: int(t["words"] * (100 - density(t)) / 100) + (t["imgs"] - t["anchor_imgs"]) * 8
            self.article = max(self.cells, key=lambda c: worth(c[1]))[0]

    def _tidy(self, root: Node) -> None:
        """Blocks hold either blocks or inline content: runs of inline content among blocks move into paragraphs."""
        todo = [root]
        while todo:
            n = todo.pop()
            blocks, inline = any(map(is_block, n.kids)), has_inline(n)
            if blocks and inline:
                kids: list[Node] = []
                for k, flows in [(k, is_inline(k)) for k in n.kids]:
                    if not flows:
                        kids.append(k)
                        continue
                    if not kids or kids[-1].tag != "p":
                        kids.append(Node("p"))
                        kids[-1].up = n
                    kids[-1].add(k)
                    kids[-1].size += k.size
                n.set(kids)
                inline = False
            if inline and not blocks:
                self._flatten(n)
                self._trim(n, lambda t: t.lstrip(WHITE))
                self._trim(n, lambda t: t.rstrip(WHITE))
            elif blocks:
                todo += n.kids

    @staticmethod
    def _flatten(root: Node) -> None:
        """Inline content without its formatting: texts, media, links and blocks."""
        frames: list[tuple[Node, Iterator[Node], list[Node], bool]] = [(root, iter(root.kids), [], True)]
        while frames:
            n, kids, out, own = frames[-1]
            k = next(kids, None)
            if k is None:
                frames.pop()
                if own:
                    n.set(out)
                    n.filled = n.tag in FILLS or any(x.filled for x in out)
            elif k.tag in ("#text", "img", "object", "video", "audio"):
                out.append(k)
            elif is_block(k) or k.tag == "a":
                out.append(k)
                frames.append((k, iter(k.kids), [], True))
            else:
                frames.append((k, iter(k.kids), out, False))

    @staticmethod
    def _trim(n: Node, how) -> None:
        """Trim the first text of a run, what is empty before it goes; both sides start from the first, for a text is
        never empty."""
        while True:
            at = next((i for i, k in enumerate(n.kids) if k.filled), len(n.kids))
            del n.kids[:at]
            if not n.kids:
                return
            n = n.kids[0]
            if n.tag == "#text":
                n.text = how(n.text)
                return


def paragraphs(root: Node, shells: bool) -> Iterator[Node]:
    """The first nodes with inline content, in document order; shells of hidden nodes too if asked for."""
    todo = [root] if root.tag != "input" else []
    while todo:
        n = todo.pop()
        if n.tag in ("form", "textarea"):
            continue
        if n.tag == "input":
            if shells:
                yield n
        elif has_inline(n):
            yield n
        else:
            todo += reversed(n.kids)


def _escaped(text: str) -> str:
    return escape(text, quote=True).replace("&#x27;", "&#39;").replace("&quot;", "&#34;")


def render(root: Node) -> str:
    """Texts, links, images and media of a paragraph; other elements leave their content."""
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "#text":
            out.append(_escaped(n.text))
        elif n.tag == "a" or n.tag in OBJECTS:
            attrs = "".join(f' {k}="{escape(v, quote=True)}"' for k, v in n.attrs.items())
            if n.tag in ("img", "embed"):
                out.append(f"<{n.tag}{attrs}/>")
            else:
                out.append(f"<{n.tag}{attrs}>")
                todo.append(f"</{n.tag}>")
                todo += reversed(n.kids)
        else:
            todo += reversed(n.kids)
    return "".join(out)


def fragment(text: str | None, url: str | None) -> dict:
    """A piece of HTML cleaned to a div of paragraphs, with the words and images outside links and the links."""
    if text is None:
        return {"html": None, "words": 0, "links": 0, "images": []}
    blocks = list(paragraphs(Page(text, url or "").article, True))
    words, links, images = 0, 0, []

    todo = blocks[::-1]
    while todo:
        n = todo.pop()
        if n.tag == "#text":
            words += count_words(n.text)
        elif n.tag == "img":
            images.append(n.attrs.get("src", ""))
        elif n.tag == "a":
            links += 1
        else:
            todo += reversed(n.kids)
    html = "".join(f"<input>{render(b)}</input>" if b.tag == "input" else f"<p>{render(b)}</p>" for b in blocks)
    return {"html": f"<div>{html}</div>", "words": words, "links": links, "images": images}


# -- tables ------------------------------------------------------------------------------------------------------

_SUMS = ("words", "tokens", "anchor_words", "imgs", "anchor_imgs", "objects", "anchors", "out_words", "links")
_NODE = pa.schema(
    [("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node_id", "parent_id", "end_id")], *[(c, pa.string()) for c in ("tag", "text", "class", "id", "src", "role")], ("points", pa.int64()), ("block_text", pa.string()), ("block_html", pa.string()), ("block_images", pa.list_(pa.string()))]
    + [(c, pa.int64()) for c in _SUMS]
)
NODES = (
    "page_id bigint, node_id int, parent_id int, end_id int, tag string, text string, class string, id string, src string, role string, points bigint, block_text string, block_html string, block_images array<string>, "
    + ", ".join(f"{c} bigint" for c in _SUMS)
)


def _rows(page_id: int, page: Page) -> list[list]:
    """Nodes in document order, numbered so: (node, parent, last node below, ...) with the sums over all below each.

    `role` is block, shell or ''. A form or medium counts for what is around it, what stands in it does not. Words in
    nested links count once for each as linked words; out_words are those outside links. `points` are what the
    paragraphs give: 1 and their lines, at most 3, to the node around each, and half of it to the next unless the first is
    the root; null where there is none. Blocks have their text, the paragraph they become and the images outside links.
    """
    marks = {id(b): "shell" if b.tag == "input" else "block" for b in paragraphs(page.article, True)}
    order, number, rows = page.nodes, {}, []
    block = [-1] * len(order)
    linked = [False] * len(order)
    texts: dict[int, list[str]] = {}
    images: dict[int, list[str]] = {}
    for i, n in enumerate(order):
        number[id(n)] = i
        up = number[id(n.up)] if i else -1
        role = marks.get(id(n), "")
        if role:
            block[i] = i
            texts[i], images[i] = [], []
        elif up >= 0 and not _opaque(order[up]):
            block[i] = block[up]
        linked[i] = up >= 0 and (linked[up] or order[up].tag == "a")
        if block[i] >= 0 and n.tag == "#text":
            texts[block[i]].append(n.text)
        elif block[i] >= 0 and n.tag == "img" and not linked[i]:
            images[block[i]].append(n.attrs.get("src", ""))
        text = n.text if n.tag == "#text" else None
        rows.append([page_id, i, up, i, n.tag, text, n.attrs.get("class", ""), n.attrs.get("id", ""), n.attrs.get("src"), role, None, None, None, None])
    total = [[0] * len(_SUMS) for _ in order]
    for i in range(len(order) - 1, -1, -1):
        n, t, row = order[i], total[i], rows[i]
        if n.tag == "#text":
            t[1] = len(_TOKEN.findall(n.text))
            t[0] = t[7] = count_words(n.text)
        elif n.tag == "img":
            t[3] = 1
        elif n.tag in OBJECTS:
            t[5] = 1
        elif n.tag == "a":
            t[2] += t[0]
            t[4] += t[3]
            t[6] += 1
            t[7], t[8] = 0, 1
        up = row[2]
        if i and not _opaque(order[up]):
            for k, v in enumerate(t):
                total[up][k] += v
        if i:
            rows[up][3] = max(rows[up][3], row[3])
        if row[9] == "block" and i:
            given = 1 + min((t[0] + LINE - 1) // LINE, 3)
            rows[up][10] = (rows[up][10] or 0) + given
            if up:
                grand = rows[rows[up][2]]
                grand[10] = (grand[10] or 0) + given // 2
        if row[9]:
            row[11], row[12], row[13] = "".join(texts[i]), f"<p>{render(n)}</p>", images[i]
    return [row + t for row, t in zip(rows, total, strict=True)]


def _opaque(n: Node) -> bool:
    """What stands in a form or a medium does not count for what is around it."""
    return n.tag in ("form", "input", "textarea", "embed", "object", "video", "audio")


#: Rows of a batch on its way out of Python; a page is never split.
BATCH = 8192


def nodes(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", leaves: bool = True) -> DataFrame:
    """The node table of the cleaned article part of each page (key, url, html); only these columns reach Python.

    Without `leaves` the rows of texts stay there, for steps that need only what is counted of them.

    Null pages count as empty ones: they have a root and nothing else.
    """

    def out(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = []
            for k, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [r for r in _rows(k, Page(h or "", u or "")) if leaves or r[4] != "#text"]
                if len(rows) >= BATCH:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return pages.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{url}` AS u", f"`{html}` AS h").mapInArrow(run, NODES)


FRAGMENT = T.StructType([T.StructField("html", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("links", T.IntegerType()), T.StructField("images", T.ArrayType(T.StringType()))])


def with_fragment(df: DataFrame, html: str, url: str, out: str) -> DataFrame:
    """D14 over a table: add `out` STRUCT<html, words, links, images>."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, FRAGMENT)])
    kind = pa.struct([("html", pa.string()), ("words", pa.int32()), ("links", pa.int32()), ("images", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, urls = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (html, url))
            new = pa.array([fragment(t, u) for t, u in zip(texts, urls, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=schema.names)

    return df.mapInArrow(run, schema)


COUNTS = "page_id bigint, text_words int, anchor_words int, table_words int, links int, imgs int, link_imgs int, lis int, h1 int, h2 int, h3 int, h4 int, forms int, uls int, ols int, tables int"


def page_counts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A2: what the cleaner counts on each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = Page(h or "", u or "")
                rows.append([k, *p.counts.values(), *(len(p.found[t]) for t in ("h1", "h2", "h3", "h4", "form", "ul", "ol", "table"))])
            names = [x.split()[0] for x in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64() if i == 0 else pa.int32()) for i in range(len(names))], names=names)

    return pages.selectExpr(f"cast(`{key}` as bigint) AS k", f"`{url}` AS u", f"`{html}` AS h").mapInArrow(run, COUNTS)

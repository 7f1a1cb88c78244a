"""The main content of pages: tree scoring of their lines.

A page is read as a tree whose leaves are its lines; a plain text is a tree of one level. Each line passes points for
its length and its commas to the container above it, and half of them to the one above that, discounted by its link
density; furniture (see `furniture`) takes points away. The container with most points is the article; of its
children those are kept that are prose or stand among prose, and of its siblings those with enough points. Lines
that recur across the distinct texts of the host are furniture wherever they stand.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from feedloom.llm.furniture import SIDEBAR, fold, is_furniture

_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>")
_TAG_OR_COMMENT = re.compile(r"<!--.*?-->|" + _TAG.pattern, re.S)
_CLASS = re.compile(r"(?i)\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: What no reader sees: scripts and styles, whole or to the end of the line, and elements that are not displayed.
_HIDES = re.compile(r"(?i)<(?:(script|style|template)\b[^<>]*|([a-z]\w*)\b[^<>]*display:\s*none[^<>]*)>")
_HAN = re.compile("[぀-ヿ㐀-鿿]")
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
_BLOCKS = {"div", "section", "article", "main", "body", "html", "ul", "ol", "table", "tbody", "tr", "td", "nav", "aside", "header", "footer", "form", "dl", "blockquote"}
# Names that pages give to furniture and to content.
_FURNITURE_NAME = re.compile(r"(?i)\b(?:nav\w*|menu\w*|foot\w*|side\w*|aside|crumbs?|breadcrumbs?|consent|cookies?|tools?|share|sharing|social|skip\w*|comments?|promo|related|banner|ad|ads|sponsor\w*|popup|pager|pagination|legal|imprint|toolbar|widget\w*)\b")
_FURNITURE_TAG = {"nav", "aside", "footer", "form", "script", "style", "noscript", "iframe"}
_END = (".", "!", "?", "。", "！", "？", "”", "\"", "»", "“", ":", "…")


@dataclass(slots=True)
class Line:
    number: int
    text: str
    group: tuple[str, str]
    place: int
    above: int | None
    density: float
    furniture: bool
    named: bool
    prose: bool


def _tags(raw: str) -> Iterator[re.Match]:
    """Tags and comments of a line; behind the last end of a comment no comment is looked for."""
    last = raw.rfind("-->") + 3
    if last > 2:
        yield from _TAG_OR_COMMENT.finditer(raw, 0, last)
    yield from _TAG.finditer(raw, last if last > 2 else 0)


def _named(tag: str, name: str) -> bool:
    return tag in _FURNITURE_TAG or (tag not in ("html", "body") and _FURNITURE_NAME.search(name) is not None)


def _seen(raw: str) -> tuple[str, str]:
    """A line without what no reader sees, and the tag that ends a script or style that goes on behind it."""
    out, at, low, gone = [], 0, raw.lower(), set()
    for m in _HIDES.finditer(raw):
        if m.start() < at or m[0].lower() in gone:
            continue
        end = f"</{(m[1] or m[2]).lower()}"
        close = low.find(end, m.end())
        if close < 0 and not m[1]:
            gone.add(m[0].lower())  # an element without an end is displayed as far as is known
            continue
        out += [raw[at : m.start()], " "]
        if close < 0:
            return "".join(out), end
        at = low.find(">", close) + 1 or len(raw)
    return "".join(out) + raw[at:], ""


def _prose(text: str) -> bool:
    """A line of sentences."""
    if not text.rstrip().endswith(_END):
        return False
    return len(text) >= 60 or (len(text) >= 20 and not text.isascii() and len(text) + 2 * len(_HAN.findall(text)) >= 60)


def _teaser(t: str) -> bool:
    """A line below the heading of a sidebar that goes on with its titles: no sentence, paragraph or item of a list."""
    return not (t.endswith((".", "。")) or len(t) > 110 or t[:1] in "•-*+" or _prose(t))


def lines_of(text: str, repeated: set[int]) -> tuple[list[Line], dict[int, int]]:
    """The visible lines of a page and the parent of each container."""
    out: list[Line] = []
    parents: dict[int, int] = {}
    names: dict[int, tuple[str, str]] = {0: ("", "")}
    furnished = [False]  # of each container, whether it or one around it has the name of furniture
    opened: Counter = Counter()  # open containers by tag
    stack, nodes, is_html, in_code = [(0, "")], 0, "<" in text and ">" in text, False
    hides = "<script" in text or "<style" in text or "display:" in text or "<template" in text
    ends = ""  # the tag that ends a script or style that goes on
    for number, raw in enumerate(text.split("\n"), 1):
        if hides:
            if ends:
                at = raw.lower().find(ends)
                if at < 0:
                    continue
                raw, ends = raw[at + len(ends) + 1 :], ""
            raw, ends = _seen(raw)
        own: tuple[str, str] | None = None
        link = 0
        before = stack[-1][0]
        if is_html and "<" in raw:
            at, parts, in_link = 0, [], False
            for m in _tags(raw):
                piece = raw[at : m.start()]
                at = m.end()
                parts.append(piece)
                link += len(piece.strip()) * in_link
                tag = (m[2] or "").lower()
                if not tag:
                    continue
                if tag == "a":
                    in_link = not m[1]
                elif m[1]:
                    while opened[tag]:
                        last = stack.pop()[1]
                        opened[last] -= 1
                        if last == tag:
                            break
                elif tag not in _VOID and not (m[3] or "").endswith("/"):
                    c = _CLASS.search(m[3] or "")
                    name = (c[1] or c[2] or c[3] or "") if c else ""
                    if own is None or (not own[1] and name):
                        own = (tag, name)
                    if tag in _BLOCKS:
                        nodes += 1
                        parents[nodes] = stack[-1][0]
                        names[nodes] = (tag, name)
                        furnished.append(furnished[stack[-1][0]] or _named(tag, name))
                        stack.append((nodes, tag))
                        opened[tag] += 1
            parts.append(raw[at:])
            text_of = "".join(parts)
        else:
            text_of = raw
        visible = html.unescape(text_of) if "&" in text_of else text_of
        if raw.startswith("```"):
            in_code = not in_code
        if not fold(visible):
            continue
        # a line that opens and closes its own element belongs to the container around it
        place = stack[-1][0] if stack[-1][0] <= before or own is None else before
        group = own or names.get(place, ("", ""))
        named = furnished[place] or _named(*group)
        size = max(1, len(visible.strip()))
        furniture = not in_code and (number in repeated or is_furniture(visible))
        out.append(Line(number, visible, group, place, parents.get(place), min(1.0, link / size), furniture, named, _prose(visible)))
    return out, parents


def _points(line: Line) -> float:
    commas = line.text.count(",") + line.text.count("，") + line.text.count("、")
    p = (1 + commas + min(len(line.text) / 100, 3)) * (1 - line.density)
    return -p if line.furniture or line.named else p


def split(text: str | None, repeated: list[int] | None = None) -> tuple[list[int], list[int]]:
    """The numbers from 1 of the visible lines of a page that belong to its article, and of those that don't.

    Null, empty and blank texts have none of either.
    """
    if not text or not text.strip():
        return [], []
    if "<" not in text:
        return _plain(text, set(repeated or ()))
    lines, parents = lines_of(text, set(repeated or ()))
    if not lines:
        return [], []
    # containers: points of their lines, half of those of lines one level below
    points: dict[int, float] = defaultdict(float)
    groups: dict[tuple, list[Line]] = defaultdict(list)
    for x in lines:
        p = _points(x)
        points[x.place] += p
        if x.above is not None:
            points[x.above] += p / 2
        if x.group[1]:
            groups[x.place, x.group].append(x)
    best = max(points, key=lambda k: (points[k], -k))
    threshold = max(2.0, points[best] / 5)
    drop = {x.number for x in lines if x.furniture or x.named or x.density > 0.5 and not x.prose}
    # elements of one class stand or fall together
    for (_, (tag, _)), own in groups.items():
        bad = sum(x.number in drop or SIDEBAR.fullmatch(fold(x.text)) is not None for x in own)
        prose = sum(x.prose and x.number not in drop for x in own)
        short = tag in ("li", "span", "a") and not prose and all(len(x.text) < 40 and not x.text.rstrip().endswith(_END) for x in own) and len(own) > 1
        if bad and bad * 3 >= len(own) and bad >= prose or short:
            drop.update(x.number for x in own)
    # a heading of a sidebar takes the teasers below it along
    heading = None
    for x in lines:
        if SIDEBAR.fullmatch(fold(x.text)):
            heading = x
            drop.add(x.number)
        elif heading is not None and _teaser(x.text.strip()) and x.group == heading.group and not x.furniture:
            drop.add(x.number)
        else:
            heading = None
    # siblings of the best container without points of their own
    inside = {best}
    for node in sorted(parents):  # a container is numbered after the one around it
        if parents[node] in inside:
            inside.add(node)
    drop.update(x.number for x in lines if x.place not in inside and points[x.place] < threshold)
    return [x.number for x in lines if x.number not in drop], sorted(drop)


def _plain(text: str, repeated: set[int]) -> tuple[list[int], list[int]]:
    """The same for a text without tags: its tree has one level, so all but furniture and teasers is the article."""
    keep, drop, teasers, in_code = [], [], False, False
    for number, raw in enumerate(text.split("\n"), 1):
        line = html.unescape(raw) if "&" in raw else raw
        if raw.startswith("```"):
            in_code = not in_code
        t = line.strip()
        if not t or not (t.isascii() or fold(t)):
            continue
        if not in_code and SIDEBAR.fullmatch(fold(t)):  # recurrent or not
            drop.append(number)
            teasers = True
        elif not in_code and (number in repeated or is_furniture(line)):
            drop.append(number)
            teasers = False
        elif teasers and not in_code and not raw.startswith("```") and _teaser(t):
            drop.append(number)
        else:
            keep.append(number)
            teasers = False
    return keep, drop


def main_lines(text: str | None, keep: list[int]) -> str | None:
    """The article's own lines; null stays null."""
    if text is None:
        return None
    own = set(keep)
    return "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i in own)


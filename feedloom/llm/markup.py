"""Markup in text documents: which kinds a text carries, and clean text that keeps its structure.

`kinds` recognises constructs of HTML, Markdown, wiki and LaTeX markup, outside code. `clean` turns them into one
plain notation: "# " for headings by level, "- " and "1. " for list items, "> " for quotations, fenced code, cells
joined by " | ", formulas in dollars. Words are kept, tags and marks go.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

_TAGS = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<![A-Za-z][^<>]*>|<\?[^<>]*\?>"
_TAG, _TAG_OR_COMMENT = re.compile(_TAGS), re.compile(f"<!--.*?-->|{_TAGS}", re.S)
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
CODE = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_CODE_TAG = re.compile(r"(?i)<(pre|code|script|style|syntaxhighlight|source)\b[^<>]*>|<(nowiki)>")
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}")
_VERB = re.compile(r"\\verb\|[^|]*\|")
_FENCE = re.compile(r"(?m)^ {0,3}(```+|~~~+)([^\n]*)$")


@lru_cache(maxsize=64)
def _end(kind: str, name: str) -> re.Pattern:
    """What ends a construct: a tag, a LaTeX environment, or something fixed."""
    return re.compile({"tag": rf"(?i)</{name}\s*>", "env": rf"\\end\{{{re.escape(name)}\}}"}.get(kind, re.escape(name)))


def paired(text: str, opener: re.Pattern, end) -> Iterator[tuple[re.Match, int, int]]:
    """(opener, end of its content, end of the construct) of each opener with the nearest end behind it.

    `end` gives the pattern of the end. One pass: an end that is not found is not looked for again, so that many
    openers without ends cost no more than one.
    """
    at, missing = 0, set()
    while (m := opener.search(text, at)) is not None:
        e = end(m)
        close = None if e in missing else e.search(text, m.end())
        if close is None:
            missing.add(e)
            at = m.end()
        else:
            yield m, close.start(), close.end()
            at = close.end()


def replaced(text: str, opener: re.Pattern, end, how) -> str:
    """The text with how(opener, content) in the stead of each construct."""
    out, at = [], 0
    for m, inner, stop in paired(text, opener, end):
        out += [text[at : m.start()], how(m, text[m.end() : inner])]
        at = stop
    return "".join(out) + text[at:] if out else text


def _tag_end(m: re.Match) -> re.Pattern:
    return _end("tag", next(g for g in m.groups() if g).lower())


def tags(text: str) -> Iterator[re.Match]:
    """Tags and comments; behind the last end of a comment no comment is looked for."""
    last = text.rfind("-->") + 3
    if last > 2:
        yield from _TAG_OR_COMMENT.finditer(text, 0, last)
    yield from _TAG.finditer(text, last if last > 2 else 0)


def untagged(text: str, by: str = "") -> str:
    last = text.rfind("-->") + 3
    return _TAG_OR_COMMENT.sub(by, text[:last]) + _TAG.sub(by, text[last:]) if last > 2 else _TAG.sub(by, text)


def fences(text: str) -> list[tuple[int, int]]:
    """Where fenced code stands: an opening line, and the next line of the same marks and nothing else."""
    marks = [(m.start(), m.end(), m[1], not m[2].strip()) for m in _FENCE.finditer(text)]
    closing: dict[str, list[tuple[int, int]]] = {}
    for a, b, sign, bare in marks:
        if bare:
            closing.setdefault(sign, []).append((a, b))
    out, at = [], -1
    for a, b, sign, _ in marks:
        if a < at:
            continue
        ends = closing.get(sign, ())
        i = bisect_left(ends, (b,))
        if i < len(ends):
            at = ends[i][1]
            out.append((a, at))
    return out


def without(text: str, spans: list[tuple[int, int]], by) -> str:
    """The text with by(what stood there) in the stead of each span."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], by(text[a:b])]
        at = b
    return "".join(out) + text[at:]


# Tags of wiki text that are not HTML.
WIKI_TAGS = {"ref", "references", "nowiki", "gallery", "noinclude", "includeonly", "syntaxhighlight", "source", "math"}

MD_STRONG = re.compile(
    r"(?m)^ {0,3}#{1,6} +\S|(?<![\w*\\])\*\*(?=[^\s*])(?:[^*\n]|\*(?!\*))+?(?<=[^\s*])\*\*(?!\w)|(?<![\w_\\])__(?=[^\s_])(?:[^_\n]|_(?!_))+?(?<=[^\s_])__(?![\w_])"
    r"|!?\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))+(?: \"[^\"\n]*\")?\)|^ {0,3}\|?(?: *:?-{2,}:? *\|)+ *(?::?-{2,}:? *)?\r?$|(?<![\w~])~~[^~\s][^~\n]*~~|^\[[^\]\n]+\]: +\S+|^ {0,3}- \[[ xX]\] "
)
MD_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])")
MD_BLOCK = re.compile(r"(?m)^ {0,3}> ?\S|^ {0,3}[*+-] +\S|^ {0,3}\d{1,3}\. +\S|^(?:=|-){3,}\s*$")
SETEXT = re.compile(r"(?m)^(?=[^\n]*\S)[^\n]+\n(?:=+|-{3,})[ \t]*\r?$")
WIKI = re.compile(
    r"(?m)'''[^'\n]+(?:'[^'\n]+)*'''|(?<!')''(?!')[^'\n]+(?:'[^'\n]+)*''(?!')|^(={2,6})[^=\n]+\1[ \t]*\r?$|\[\[[^\[\]\n]+\]\]|(?<!\])\[https?://[^\s\[\]]+ [^\[\]\n]+\](?!\()|^\{\|.*$|^\|\}"
    r"|\{\{[A-Z][^{}]*\}\}|\{\{[^{}|]+\|[^{}]*\}\}|^#REDIRECT|<ref\b|<nowiki>|__(?:TOC|NOTOC|FORCETOC)__|^;[^\n:]+:|~~~~"
)
WIKI_MARKS = re.compile(r"(?m)^[*#:;]+ ?\S|^----+")
LATEX = re.compile(
    r"\\(?:begin|end)\{[A-Za-z]+\*?\}|\\(?:sub)*(?:section|paragraph)\*?\{|\\(?:chapter|title|emph|text[a-z]{2,6}|cite[a-z]*|ref|label|footnote|href|url|caption|item|usepackage|documentclass|includegraphics|underline|frac|sum|alpha|sqrt|begin|maketitle|noindent|par|ldots|LaTeX|TeX)\b"
    r"|\\\((?:(?!\\\().)+?\\\)|\\\[(?:(?!\\\[).)+?\\\]|(?<![\\$])\$\$[^$]+\$\$"
)
#: A formula in single dollars holds a sign of mathematics and no plain prices.
MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]+)(?<=[^\s\\])\$(?![\d$])")
_MATHS = re.compile(r"[\\^_=<>+{}]|\b[a-z]\b")


def kinds(text: str | None) -> set[str]:
    """The kinds of markup of a text: 'html', 'markdown', 'wiki', 'latex'. Null and empty texts have none.

    Wiki text uses list marks, tables, rules and templates in its own way, so these say 'wiki' alone; LaTeX text uses
    braces and percent signs; code in a code block says nothing but the kind of its block.
    """
    found: set[str] = set()
    if not text:
        return found
    bare = text
    if "\\begin{" in bare or "\\verb" in bare:
        shorter = _VERB.sub(" ", replaced(bare, _VERBATIM, lambda m: _end("env", m[1]), lambda *_: " "))
        if shorter != bare:
            found.add("latex")
            bare = shorter
    if "```" in bare or "~~~" in bare:
        spans = fences(bare)
        if spans:
            found.add("markdown")
            bare = without(bare, spans, lambda _: "\n")
    if "<" in bare:
        shorter = replaced(bare, _CODE_TAG, _tag_end, lambda *_: " ")
        if shorter != bare:
            found.add("wiki" if re.search(r"<(?:nowiki|syntaxhighlight|source)", bare) else "html")
            bare = shorter
    if "`" in bare:
        shorter = CODE.sub(" x ", bare)
        if shorter != bare:
            found.add("markdown")
            bare = shorter
    names = {re.sub(r"[^a-z0-9]", "", m[0][:20].lower().split()[0]) if m[0][1] not in "!?" else "!" for m in tags(bare)} if "<" in bare else set()
    if names - WIKI_TAGS or ("&" in bare and ENTITY.search(bare)):
        found.add("html")
    if names:
        bare = untagged(bare, " ")
        # a tag at the begin of a line must not hide a mark, nor make one
        bare = re.sub(r"(?m)^ +(?=\S)", "", bare) if "html" not in found else bare
    wiki = bool(("[" in bare or "''" in bare or "{" in bare or "=" in bare or "<" in text or "~~~~" in bare or "#REDIRECT" in bare or "__" in bare) and WIKI.search(bare)) or bool(names & WIKI_TAGS)
    if wiki:
        found.add("wiki")
    math = [m for m in MATH.finditer(bare) if _MATHS.search(m[1])] if "$" in bare else []
    if math or ("\\" in bare or "$$" in bare) and LATEX.search(bare):
        found.add("latex")
    if math:
        bare = MATH.sub(" x ", bare)
    if "\\" in bare or "$$" in bare:
        bare = replaced(bare, _FORMULA, _formula_end, lambda *_: " x ")
    if "wiki" not in found and "markdown" not in found and (MD_STRONG.search(bare) or MD_EM.search(bare) or _block(bare) or SETEXT.search(bare)):
        found.add("markdown")
    elif "wiki" in found and "markdown" not in found and re.search(r"(?<!\[)\[[^\[\]\n]+\]\(https?://[^()\s]+\)|(?<![\w*])\*\*[^\s*][^*\n]*[^\s*]\*\*(?![\w*])", bare):
        found.add("markdown")
    return found


_FORMULA = re.compile(r"(?<!\\)\\(\()|(?<!\\)\\(\[)|(\$\$)|\\begin\{((?:equation|align|displaymath)\*?)\}")


def _formula_end(m: re.Match) -> re.Pattern:
    return _end("env", m[4]) if m[4] else _end("", {"(": "\\)", "[": "\\]"}.get(m[1] or m[2], "$$"))


def _block(text: str) -> bool:
    """Lists and quotations: at least two marked lines, or one that opens the text."""
    marks = [m[0].strip()[0] for m in MD_BLOCK.finditer(text)]
    return len(marks) >= 2 or (bool(marks) and MD_BLOCK.match(text) is not None) or ">" in marks


# -- clean text --------------------------------------------------------------------------------------------------

_HEAD = re.compile(r"(?i)<(h[1-6])\b[^<>]*>")
_PRE, _INLINE, _QUOTE = re.compile(r"(?i)<(pre)\b[^<>]*>"), re.compile(r"(?i)<(code)\b[^<>]*>"), re.compile(r"(?i)<(blockquote)\b[^<>]*>")
_UNSEEN = re.compile(r"(?i)<(!)--|<(script|style|noscript|template)\b")
_BREAK = re.compile(r"(?i)<br\s*/?>|</?(?:p|div|section|article|main|body|html|header|footer|nav|aside|figure|figcaption|form|center|address|dl|dd|dt|hr)\b[^<>]*>")


def _code(text: str) -> str:
    return "\n```\n" + html.unescape(untagged(text)).strip("\n") + "\n```\n"


def _from_html(t: str) -> str:
    t = replaced(t, _UNSEEN, lambda m: _end("", "-->") if m[1] else _tag_end(m), lambda *_: "")
    t = re.sub(r"(?i)<[a-z]+[^<>]*display:\s*none[^<>]*>[^<]*</[a-z]+>", "", t)
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    t = replaced(t, _PRE, _tag_end, lambda m, inner: hold(_code(inner)))
    t = replaced(t, _INLINE, _tag_end, lambda m, inner: hold("`" + html.unescape(untagged(inner)) + "`"))
    t = replaced(t, _HEAD, _tag_end, lambda m, inner: "\n\n" + "#" * int(m[1][1]) + " " + untagged(inner).strip() + "\n\n")

    def listed(m: re.Match) -> str:
        items = re.findall(r"(?is)<li\b[^<>]*>(.*?)(?=<li\b|\Z)", m[2])
        ordered = m[1].lower() == "ol"
        return "\n" + "\n".join((f"{i}. " if ordered else "- ") + untagged(x).strip() for i, x in enumerate(items, 1)) + "\n"

    t = re.sub(r"(?is)<(ul|ol)\b[^<>]*>((?:(?!<(?:ul|ol)\b).)*?)</\1\s*>", listed, t)
    t = re.sub(r"(?is)<li\b[^<>]*>", "\n- ", t)
    t = re.sub(r"(?is)<tr\b[^<>]*>(.*?)(?=<tr\b|</table|</tr)", lambda m: "\n" + " | ".join(untagged(c).strip() for c in re.findall(r"(?is)<t[hd]\b[^<>]*>(.*?)(?=<t[hd]\b|\Z)", m[1])), t)
    t = replaced(t, _QUOTE, _tag_end, lambda m, inner: "\n" + "\n".join("> " + x for x in untagged(_BREAK.sub("\n", inner)).strip().split("\n")) + "\n")
    t = _BREAK.sub("\n", t)
    t = html.unescape(untagged(t))
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], t)


def _templates(t: str) -> list[tuple[int, int]]:
    """Where templates stand, nested ones within the outermost that is closed."""
    opened, found = [], []
    for m in re.finditer(r"\{\{|\}\}", t):
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            found.append((opened.pop(), m.end()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


_REF = re.compile(r"(?i)<(ref)\b[^<>/]*>|(\{\|)")


def _from_wiki(t: str) -> str:
    t = re.sub(r"(?i)<ref\b[^<>]*/>", "", t)
    t = replaced(t, _REF, lambda m: _tag_end(m) if m[1] else _end("", "|}"), lambda m, inner: "" if m[1] else _table("{|" + inner + "|}"))
    t = without(t, _templates(t), lambda _: "")
    t = re.sub(r"(?m)^(={2,6})[ \t]*([^\s=](?:[^\n]*[^\s=])?)[ \t]*\1[ \t]*\r?$", lambda m: "#" * len(m[1]) + " " + m[2], t)
    t = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei):[^\[\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\[\]]+ ([^\[\]\n]+)\]", r"\1", t)
    t = re.sub(r"'{5}|'{2,3}", "", t)
    t = re.sub(r"(?m)^(\*+) *", lambda m: "  " * (len(m[1]) - 1) + "- ", t)
    return re.sub(r"(?m)^#+ *(?=\S)(?!#)", lambda m: m[0] if m[0].endswith(" ") and len(m[0].strip()) > 1 else "1. ", t)


def _table(t: str) -> str:
    rows = []
    for row in re.split(r"(?m)^\|-.*$", re.sub(r"(?m)^\{\|.*$|^\|\}.*$", "", t)):
        cells = [c.strip() for c in re.split(r"\|\||!!|(?m:^[|!])", row) if c.strip()]
        if cells:
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def _from_markdown(t: str) -> str:
    t = re.sub(r"!\[([^\[\]]*)\]\([^()\s]*(?: \"[^\"]*\")?\)", r"\1", t)
    t = re.sub(r"\[([^\[\]]*)\]\([^()\s]*(?: \"[^\"]*\")?\)", r"\1", t)
    t = re.sub(r"(?m)^(?=[^\n]*\S)([^\n]+)\n=+[ \t]*$", r"# \1", t)
    t = re.sub(r"(?m)^(?=[^\n|]*[^\n|\s])([^\n|]+)\n-{3,}[ \t]*$", r"## \1", t)
    t = re.sub(r"(?m)^ {0,3}\|?(?: *:?-{2,}:? *\|)+ *(?::?-{2,}:? *)?$\n?", "", t)
    t = re.sub(r"(?m)^\|(.*)\|[ \t]*$", lambda m: " | ".join(c.strip() for c in m[1].split("|")), t)
    t = re.sub(r"(?<![\w*\\])\*\*(?=\S)((?:[^*\n]|\*(?!\*))+)(?<=\S)\*\*(?!\w)|(?<![\w_\\])__(?=\S)((?:[^_\n]|_(?!_))+)(?<=\S)__(?![\w_])", lambda m: m[1] or m[2], t)
    t = re.sub(r"(?<![\w*\\])\*([^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])|(?<![\w_\\])_([^\s_](?:[^_\n]*[^\s_])?)_(?![\w_])", lambda m: m[1] or m[2], t)
    return re.sub(r"(?m)^( *)[*+] +", r"\1- ", t)


def _from_latex(t: str) -> str:
    t = re.sub(r"(?m)(?<!\\)%.*$", "", t)
    t = replaced(t, _VERBATIM, lambda m: _end("env", m[1]), lambda m, inner: "\n```\n" + inner.strip("\n") + "\n```\n")
    t = replaced(t, _FORMULA, _formula_end, lambda m, inner: f"${inner.strip()}$" if m[1] else f"$${inner.strip()}$$")
    t = re.sub(r"\\((?:sub)*)section\*?\{([^{}]*)\}", lambda m: "#" * (1 + len(m[1]) // 3) + " " + m[2], t)
    t = re.sub(r"~?\\(?:cite[a-z]*|label|ref)\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:emph|text[a-z]{2,6}|underline|footnote|caption|title|chapter|paragraph)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}[ \t]*\n?", "", t)
    t = re.sub(r"(?m)^[ \t]*\\item\b[ \t]*", "- ", t)
    return re.sub(r"(?<=\w)~(?=\w)", " ", t)


def clean(text: str | None, found: set[str] | None = None) -> str | None:
    """Clean text with its structure kept; null stays null, a text without markup comes back unchanged.

    `found` are the kinds of markup where they are known already.
    """
    if not text:
        return text
    found = kinds(text) if found is None else found
    if not found:
        return text
    t = text.replace("\r\n", "\n")
    held: list[str] = []

    def hold(code: str) -> str:
        held.append(re.sub(r"\A *(?:`{3,}|~{3,})[^\n]*|(?:`{3,}|~{3,}) *\Z", "```", code))
        return f"\x01{len(held) - 1}\x01"

    if "markdown" in found:
        t = without(t, fences(t), hold)
    if "html" in found:
        escaped = next(tags(t), None) is None
        t = _from_html(t)
        if escaped and next(tags(t), None):  # tags that had been escaped once more
            t = _from_html(t)
    t = re.sub(r"(?s)\n```\n.*?\n```\n", lambda m: hold(m[0]), t)
    if "wiki" in found:
        t = _from_wiki(t)
    if "latex" in found:
        t = _from_latex(t)
    if "markdown" in found:
        t = _from_markdown(t)
    t = re.sub("\x01(\\d+)\x01", lambda m: held[int(m[1])], t)
    t = re.sub(r"(?<![ \t])[ \t]+\n", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip("\n")

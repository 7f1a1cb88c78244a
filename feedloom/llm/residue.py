"""Records that hold template residue, filler or error pages instead of an article.

Lines are counted by host first; recurrent boilerplate (lines repeated across a host's distinct texts, and lines that
are furniture by themselves) is subtracted, and what remains is searched for evidence of five kinds: placeholders
that were not filled, missing values printed as text, filler, error pages and notices that scripts are required.
A line that is evidence as a whole is never subtracted, for an error page may recur as often as a legal notice; a
placeholder in a recurrent sentence is.
"""

from __future__ import annotations

import html
import re

from feedloom.llm.furniture import fold, is_furniture

_NAME = r"[A-Za-z_][\w]*(?:\.\w+)*"
#: Placeholders in the syntaxes of common template engines. Wiki templates have capitals, blanks or bars inside.
PLACEHOLDER = re.compile(
    rf"\{{\{{-? ?[a-z_]\w*(?:\.\w+)* ?(?: \| \w+ )?-?\}}\}}(?!\}})|\$\{{{_NAME}\}}|\#\{{{_NAME}\}}|%\({_NAME}\)[sd]|%%\w+%%|@@\w+@@|(?<!\w)__[A-Z][A-Z0-9_]+__(?!\w)"
    rf"|\[(?:INSERT|ADD|YOUR|ENTER) [A-Z _]+\]|\{{%-? ?\w+ [^%}}\n]*%\}}|<%=? ?{_NAME} ?%>|\*\|[A-Z_]+\|\*|(?<![\w\\}}$#{{^])\{{(?:\d|[a-z]+(?:[._A-Z][a-zA-Z]+)*)\}}(?![\w{{}}])"
)
#: Arguments by number. Software that fills them begins at 0.
POSITIONAL = re.compile(r"\{\d\}")
#: A sentence that explains a placeholder names the syntax it belongs to.
EXPLAINED = re.compile(r"(?i)\b(?:type|write|prints?|calls?|called|theme|template|syntax|engine|placeholder|manual|variable|stands for|expands?|means|documentation)\b")

# Words of filler text.
FILLER = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua
    enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure
    reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa
    officia deserunt mollit anim laborum molestra quovat trabes illi cavendi testu nulli menda potura ventis dapis ferent
    sequor vani oculi mirabo ut et in id ad non est qui ex ea do""".split()
)

_STATUS = r"(?:bad request|unauthorized|forbidden|not found|method not allowed|request timeout|gone|payload too large|too many requests|internal server error|bad gateway|(?:service )?(?:temporarily )?unavailable|service (?:temporarily )?unavailable|gateway time-?out)"
_WHOLE = [
    # missing values
    r"(?:null|undefined|nan|none|nil|n/a|tbd|tba|\(null\)|#n/a|\[object object\]|nothing|missing)\.?",
    r"(?:by|from|author:?|posted by|published (?:on|by)|tags?:?|title:?|in|category:?|date:?) ?(?:null|undefined|nan|none|nil|\[object object\])\.?",
    r"(?:null|undefined|nan|none) (?:comments?|views|shares|words|minutes|reads|min read)",
    # filler
    r"(?:test[ .!]*){2,}\d*|(?:this is )?(?:just )?a? ?test post.{0,40}|(?:asdf|qwer|jkl|foo|bar|blah)(?: (?:asdf|qwer|jkl|foo|bar|blah))+ ?\d*|test ?\d*",
    r"(?:blindtext[ ,.]*){2,}.{0,60}|sample (?:page|post|text)\b.{0,60}|hello world!? this is your first post.{0,40}|your (?:text|content|title|summary) (?:goes )?here\.?",
    r"(?:\w+ of \w+ \d+|summary|description|title|content|text|teaser|body|excerpt)(?: of .{1,40})? goes here\.?|todo:? .{0,60}|\(?no (?:description|summary|content|title|text)(?: is)?(?: available| provided| yet)?\)?\.?|untitled(?: \w+)?|(?:foo bar baz ?)+|aquí va el texto.{0,40}|ici le texte.{0,40}|hier (?:steht|kommt) (?:später )?(?:der|ihr) (?:text|artikel).{0,20}|texte? (?:à venir|de prueba).{0,30}|此处填写.{0,20}|(?:这是)?测试(?:内容|文章|文本).{0,20}|тестов(?:ая|ый) (?:запись|текст|пост).{0,40}|\(?(?:placeholder|dummy text|platzhaltertext|texte factice|texto de relleno)\)?\.?|(?:coming soon|under construction)\.?",
    # errors
    rf"(?:http(?: status| error)?|error|fehler|erreur|server answered|status|code)?:? ?[45]\d\d ?(?:[-–|:(]|(?={_STATUS}))? ?{_STATUS}\)?(?:[. ].{{0,80}})?",
    rf"error: the requested url could not be retrieved.*|{_STATUS} ?\([45]\d\d\)|(?:error|fehler|erreur|ошибка) ?[45]\d\d\.?",
    r"access denied\.?(?:you are not.*)?|you (?:are not authorized|don't have permission).*|forbidden\.?|page not found.{0,80}|not found\.?",
    r"error establishing a database connection\.?|fatal error: .*|warning: .{0,40}(?:function|include|mysql|array).*|parse error: .*|uncaught .*|traceback \(most recent call last\):?.*|[a-z]*(?:error|exception): .{0,80}|(?:java|org|com|javax)(?:\.\w+)+(?:exception|error).*|\tat .*|at \w+(?:\.\w+)+\(.*\)",
    r"(?:oops|sorry|whoops)\b.{0,100}|.{0,30}something went wrong.{0,60}|x{3,}(?: x{3,})* ?|系统繁忙.{0,30}|.{0,20}(?:请稍后再试|稍后重试).{0,20}|(?:this|the) (?:page|site) (?:cannot|can't|could not) be .{0,60}|bad gateway\b.*|this (?:account|site|page) has been suspended.*|the domain \S+ (?:is (?:parked|for sale)|has expired).*|.{0,60}upstream .{0,60}did not answer.*",
    r"too many requests\b.*|down for maintenance.*|(?:the )?site is (?:temporarily )?(?:down|under maintenance).*|your session has expired.*|(?:please )?log in again.*|the requested .{1,40} (?:was not found|could not be).*|service unavailable.*|we will be back (?:shortly|soon).*",
    r"fehler \d+: .*|seite nicht gefunden\b.*|zugriff verweigert.*|page introuvable\b.*|accès refusé.*|página no encontrada\b.*|acceso denegado.*|страница не найдена.*|доступ запрещ.н.*|.{0,12}页面不存在.*|(?:404|找不到页面|访问被拒绝|服务器错误).{0,20}|wartungsarbeiten.*|en maintenance.*",
    # scripts and browser checks
    r"(?:please )?(?:enable|turn on|activate|allow) (?:javascript|scripts|cookies).*|you need to (?:enable|turn on|activate) (?:javascript|scripts).*|(?:this (?:site|page|app\w*) )?(?:requires|needs) javascript.*|javascript (?:is|seems to be) (?:disabled|required|turned off|off).*|your browser does not support (?:scripts|javascript).*",
    r"(?:loading\.* ?)?if nothing happens, scripts.*|loading\.\.\.?|(?:to continue, )?(?:please )?(?:prove|verify|confirm) (?:that )?you are (?:not a robot|human).*|checking your browser.*|(?:just )?a moment\.\.\..*|are you (?:a robot|human)\?.*|complete the captcha.*|ddos protection by .*",
    r".{1,40} (?:works? only with|requires?|needs?) (?:active |enabled )?(?:scripts|javascript)\b.{0,40}|scripts must be (?:allowed|enabled).*",
    r"(?:bitte )?aktivieren sie javascript.*|bitte javascript .*|diese (?:anwendung|seite) benötigt javascript.*|(?:veuillez )?activer javascript.*|(?:por favor )?activ[ae] javascript.*|habilite javascript.*|(?:для просмотра )?включите (?:javascript|скрипты).*|请(?:启用|开启|打开) ?javascript.*|.{0,20}需要(?:启用)? ?javascript.*",
]
WHOLE = re.compile("|".join(f"(?:{p})" for p in _WHOLE))
#: A sentence that asks for scripts, and words of sentences that report on such a line.
_NEEDS = re.compile(
    r"(?:\b(?:javascript|scripts?|scripting|js)\b.*(?:enable|turned? o|switch|activ|disabled|blocked|allow|require|needed|benötigt|erforderlich|nécessaire|necesari|включ|启用|开启)"
    r"|(?:need|require|rel(?:y|ies)|works?|loaded by|switch|displayed|without|enable|turn on|allow|activ|benötigt|braucht|erfordert|nécessite|requiert|necesita|requiere|нужен|требует|включ|需要|启用|开启|не работает).*(?:javascript|\bscripts?\b|scripting|\bjs\b|скрипт))"
)
#: One of these stands in whatever _NEEDS matches.
_SCRIPTS = ("script", "js", "скрипт")
_ABOUT = re.compile(r"\b(?:says|said|wrote|explains?|shows|called)\b|[\"“„«]")

_BLOCK = re.compile(r"(?i)</?(?:p|div|h[1-6]|hr|br|li|ul|ol|tr|td|th|table|address|pre|body|html|section|article|title|center)\b[^<>]*>")
_TAG = re.compile(r"<[!/?]?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_FENCE = re.compile(r"(?ms)^```.*?^```|<pre\b.*?</pre>|<code\b.*?</code>|<(script|style)\b.*?</\1>|`[^`\n]+`")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


def visible_lines(text: str) -> list[str]:
    """The visible lines of a text, each block of HTML on a line of its own."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    return [x for x in text.split("\n") if x.strip()]


def _asks(folded: str) -> bool:
    """A line asks for scripts if most of it does: it all where it is short, else more than half of its characters."""
    if not any(x in folded for x in _SCRIPTS) or not _NEEDS.search(folded) or _ABOUT.search(folded):
        return False
    return len(folded) < 150 or 2 * sum(len(x) for x in _SENTENCE.split(folded) if _NEEDS.search(x)) > len(folded)


def _alone(bare: str) -> bool:
    """Little is said but for arguments by number: fewer than three words."""
    return len(_WORDS.findall(POSITIONAL.sub(" ", bare))) < 3


def _evidence(line: str) -> str | None:
    """What the whole of a visible line says: 'whole', 'missing', 'filler' or nothing."""
    known = _KNOWN.get(line)
    if known is None:
        f, known = fold(line), ""
        if WHOLE.fullmatch(f) or _asks(f):
            known = "missing" if _MISSING.search(f) else "whole"
        else:
            words = _WORDS.findall(f)
            if len(words) >= 5 and sum(w in FILLER for w in words) >= 0.8 * len(words):
                known = "filler"
        if len(_KNOWN) > 1 << 16:
            _KNOWN.clear()
        if len(line) < 200:
            _KNOWN[line] = known
    return known


_KNOWN: dict[str, str] = {}
_MISSING = re.compile(r"\b(?:null|undefined|nan|none|nil)\b|\[object")
#: Words, placeholders not counted, that make a line a sentence.
SENTENCE_WORDS = 8
_OPENERS = ("{", "%", "@@", "__", "[", "*|")


def _placeholder(bare: str, recurrent: set[int]) -> bool:
    """Whether a placeholder stands in what is left of a text without its recurrent lines, unexplained.

    A recurrent line goes if it is a sentence; an unfilled byline of all of a host's pages is left. Arguments by number are placeholders if their numbers begin
    at 0 or they are nearly all there is: a single {4} in a sentence is the sentence's own.
    """
    spans, numbered, line, at = [], set(), 1, 0
    for m in PLACEHOLDER.finditer(bare):
        line, at = line + bare.count("\n", at, m.start()), m.start()
        if line in recurrent:
            begin, end = bare.rfind("\n", 0, m.start()) + 1, bare.find("\n", m.end())
            if len(_WORDS.findall(PLACEHOLDER.sub(" ", bare[begin : end if end >= 0 else len(bare)]))) >= SENTENCE_WORDS:
                continue
        if POSITIONAL.fullmatch(m[0]):
            numbered.add(m[0])
        spans.append(m)
    counts = "{0}" in numbered or bool(numbered) and _alone(bare)
    for m in spans:
        if m[0] in numbered and not counts:
            continue
        begin = max(bare.rfind("\n", 0, m.start()), bare.rfind(". ", 0, m.start())) + 1
        end = min(x for x in (bare.find("\n", m.end()), bare.find(". ", m.end()), len(bare)) if x >= 0)
        if not EXPLAINED.search(bare[begin : m.start()] + " " + bare[m.end() : end]):
            return True
    return False


def kinds(text: str | None, repeated: list[int] | None = None) -> set[str]:
    """The kinds of evidence in a text; `repeated` has the numbers from 1 of its lines that recur in the host.

    Null, empty and blank texts have none. Each visible line is compared with all patterns; whether those that match
    are the text's substance is judged by what else remains of it without recurrent lines and furniture.
    """
    if not text:
        return set()
    found: set[str] = set()
    bare = _FENCE.sub(" ", text) if "`" in text or "<" in text else text
    drop = set(repeated or ())
    if any(x in bare for x in _OPENERS) and _placeholder(bare, drop):
        found.add("placeholder")
    hits, rest = 0, []
    for i, raw in enumerate(bare.split("\n"), 1):
        for x in visible_lines(raw):
            what = _evidence(x)
            if what == "filler":
                found.add("filler")
            elif what:
                hits += 1
                if what == "missing":
                    found.add("missing value")
            else:
                rest.append((i, x))
    if hits:
        prose = 0
        for i, x in rest:
            if i not in drop:
                long = len(x) > 110 or len(x) > 80 and len(_SENTENCE.split(x)) > 1
                prose += long and not is_furniture(x)
        if hits >= prose:
            found.add("error, filler or scripts")
    return found

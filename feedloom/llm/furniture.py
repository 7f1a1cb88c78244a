"""Lines that belong to the furniture of a page or feed post, not to its article.

The vocabularies below are fixed values in the six languages of the texts. A line is folded first: lower case, no
zero-width characters, one blank for each run of white space.
"""

from __future__ import annotations

import re
from functools import lru_cache

_ZERO = re.compile("[​﻿]")


def fold(line: str) -> str:
    if not line.isascii():
        line = _ZERO.sub("", line)
    return " ".join(line.split()).lower()


# Items of menus, breadcrumbs and footers.
MENU = set(
    """about archive archives advertise adverts contact culture events forum help home imprint jobs local login mobile
    news opinion photos podcasts press privacy rss search shop sitemap sport staff subscribe terms weather
    abo agb archiv bilder datenschutz hilfe impressum kontakt kultur nachrichten sport startseite suche termine wetter
    abonnement accueil actualités aide boutique culture emploi météo photos recherche
    archivo ayuda buscar contacto cultura deportes empleo foro fotos inicio noticias tiempo tienda
    首页 新闻 论坛 联系 文化 图片 天气 体育 存档 归档 帮助 商店 招聘 活动 视频 评论 搜索 订阅 播客
    архив афиша главная контакты культура магазин новости погода помощь поиск работа спорт форум фото""".split()
) | {"mobile version", "über uns", "à propos", "关于我们", "о нас", "mentions légales", "aviso legal", "sobre nosotros", "联系我们", "contact us", "about us", "правила", "quiénes somos", "plan du site", "mapa del sitio"}

# Headings of sidebars, the whole line.
SIDEBAR = re.compile(
    r"(?:related (?:stories|articles|posts)|most (?:read|popular|viewed)|in this section|latest (?:comments|posts|news)|recent (?:posts|comments)"
    r"|elsewhere on .{1,40}|you may also like|popular (?:posts|now)|more from .{1,40}|das könnte sie auch interessieren|meistgelesen|lesen sie auch|mehr zum thema"
    r"|les plus lus|à lire aussi|sur le même sujet|también te puede interesar|lo más leído|热门文章|相关阅读|相关文章|самое читаемое|читайте также|по теме):?"
)

_PARTS = [
    # consent
    r"cookies?\b.{0,90}(?:accept|refuse|agree|reject|got it|choices|no thanks|fine by me|policy|count visits)",
    r"(?:cookies?|identifiers|tracking tags|similar tools|small (?:text )?files|data about your visit)\b.{0,80}(?:in order to|so that we can|to remember|logged in|measure visits|partners|your mind|fitting adverts|for our newsroom|\\[x\\] close|privacy notice|only needed|accept \\| refuse|to improve .{1,40}\\.)",
    r"(?:we (?:use|place|read)|would like to set|stores?|our pages (?:use|place|read)) (?:cookies|identifiers|small (?:text )?files|tracking tags)",
    r"partners? (?:process|use|store) .{0,40}(?:data|cookies)|on this page use cookies|use cookies and similar",
    r"verwendet cookies|daten auf ihrem gerät|cookies? .{0,60}(?:einverstanden|zustimmen|ablehnen|verstanden)|mit der nutzung erklären",
    r"(?:utilise|dépôt) de[s]? cookies|cookies pour mesurer|vous acceptez .{0,20}cookies|usa cookies|uso de cookies|aceptas .{0,20}cookies",
    r"使用 ?cookies?|在您的设备上保存|использует cookies?|с помощью cookies?|соглашаетесь с",
    # rights and imprint
    r"^\W{0,3}(?:©|\(c\) ?\d|copyright (?:©|\d|\(c\))|contents? ©)|©\W*\d{4}",
    r"all rights reserved|reproduction without permission|(?:may|must) be (?:copied|reproduced|republished) without|registered charity",
    r"alle rechte vorbehalten|nachdruck (?:nur|verboten)|nachdruck, auch|ohne gewähr|ohne zustimmung von .{0,40} untersagt",
    r"tous droits réservés|reproduction (?:interdite|même partielle)|todos los derechos|prohibida (?:la|su) reproducción",
    r"版权所有|转载请|不得转载|^本站由|все права защищены|перепечатка",
    r"^ein angebot von |^un site édité par|^publicado por .{1,40}\. ?prohib|^издатель:|is published by .{1,60}no part",
    # machinery
    r"^(?:powered|hosted|theme|design|designed|site) by |^(?:running on|made with) \S+$|powered by \S+\.?$|valid markup|^page (?:built|generated|rendered) in [\d.]+|^last (?:changed|updated|modified) .{1,20}ago",
    r"^(?:skip|jump) to (?:the )?(?:main )?content|^back to (?:the )?top$|^(?:zum inhalt springen|nach oben|aller au contenu|haut de page|volver arriba|ir al contenido|saltar al contenido|跳到正文|返回顶部|наверх|перейти к содержимому|к содержанию)$",
    # share and comments
    r"^(?:share|tweet|tweetle|pin|e-?mail|print|bookmark|like) this\b|share this (?:post|story|article)|send it to a friend|^\d+ shares?$|· *\d+ shares",
    r"^(?:diesen )?beitrag teilen|^teilen( auf|:)|^partage[zr]|^compart(?:e|ir)\b|^分享到|^поделит(?:есь|ься)",
    r"^(?:comments?|commentaires?|comentarios?|kommentare?|комментарии) ?\(\d+\)|^评论 ?[（(]\d+[）)]|^\d+ (?:comments?|kommentare?|commentaires?|comentarios?)\b.{0,40}$|^\d+ комментари|to post comments|\| ?permalink\b",
    r"^(?:viewed|read) \d+ times|^bisher \d+ mal gelesen|^(?:lu|leído|visto) \d+ (?:fois|veces)|^阅读[ :：]?\d+|^просмотров|^прочитано|^\d+ (?:views|vues|visitas|просмотров)",
    r"^filed under\b|^posted in\b|^tags?:|^abgelegt unter|^classé dans|^archivado en|^标签[:：]|^рубрика:",
    # bylines and lines of feeds
    r"^posted by the .{1,40}desk of|^redaktion .{1,40}, büro|^la rédaction de .{1,40}, bureau|^redacción de .{1,60}$|^本文由.{1,40}(?:整理|编辑)|^редакция .{1,40}, ",
    r"^the post (?:.{0,80} )?(?:appeared )first on|^(?:read|view) (?:the full|the whole|the rest|more|on)\b.{0,60}$|^continue reading|^(?:weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo|阅读全文|читать (?:полностью|далее))",
    r"^sponsored by|^advertisement$|^anzeige$|^-+ ?sent from|^follow .{1,60}(?:for more|on )|never miss|^sign up for|^subscribe (?:to|by|now)|^get .{1,60} by mail",
    r"issues a year|for personal use only|^views expressed|expressed (?:here|in this)|of the writers? and not of|letters: see contact",
    r"^(?:dieser feed|ce flux|este feed|本文仅|эта лента)|^(?:abonnieren|abonnez|suscríb|订阅|关注|подпис)",
    r"nur für den (?:privaten|persönlichen)|usage personnel|uso personal|仅供个人|личного (?:пользования|использования)",
]


def _alternatives(part: str) -> list[str]:
    """The alternatives of a pattern outside all brackets."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(part):
        if part[i] == "\\":
            i += 1
        elif part[i] in "([":
            depth += 1
        elif part[i] in ")]":
            depth -= 1
        elif part[i] == "|" and not depth:
            out.append(part[at:i])
            at = i + 1
        i += 1
    return [*out, part[at:]]


_EACH = [a for p in _PARTS for a in _alternatives(p)]
#: Patterns of the start of a line, and those that may stand anywhere in it.
_START = re.compile("|".join(f"(?:{a[1:]})" for a in _EACH if a.startswith("^")))
_INSIDE = re.compile("|".join(f"(?:{a})" for a in _EACH if not a.startswith("^")))
#: One of these stands in each line that _INSIDE can match.
_NEEDED = """cookie identifiers|tracking tags|similar tools|small files|small text files|your visit|partner|daten auf ihrem|nutzung erklären|您的设备|соглашаетесь|©|reserved|permission
    copied|reproduced|republished|charity|rechte|nachdruck|ohne |droits|reproduction|derechos|prohibida|版权|转载|права|перепечатка|no part|powered|markup|shares|friend|share this|first on|never
    issues a year|personal|expressed|not of|contact|permalink|to post|комментари|仅供|личного|usage|uso |privaten|persönlichen""".replace("cookie identifiers", "cookie|identifiers").replace("\n", "|")
_WORDS = sorted({w.strip(" ") if w.strip() not in ("ohne", "uso") else w.strip() + " " for w in _NEEDED.split("|") if w.strip()})


@lru_cache(maxsize=1)
def _needed():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in _WORDS:
        a.add_word(w, w)
    a.make_automaton()
    return a


def matches(folded: str) -> bool:
    """Whether a folded line is furniture by its words."""
    return _START.match(folded) is not None or (next(_needed().iter(folded), None) is not None and _INSIDE.search(folded) is not None)

_SEPARATORS = re.compile(r" *(?:\||/|·|»|›|>|::|•|—|→| - ) *|(?<=[a-z])-(?=[A-Z])|\s{2,}|(?<=\S),\s")

_BLANKS = re.compile(" {3,}")


def menu(line: str) -> bool:
    """Items of a menu, breadcrumbs or a footer in one line, or a single item; `line` has its white space as it is."""
    line = _BLANKS.sub("  ", _ZERO.sub("", line).strip())  # a separator begins with any number of blanks
    if line.endswith((".", "!", "?", "。")):
        return False
    items = [fold(x) for x in _SEPARATORS.split(line) if x and x.strip()]
    if not items:
        return False
    known = sum(x in MENU for x in items)
    if len(items) == 1:
        return known == 1
    if len(items) == 2 or not known:
        return known == 2 or (known == 1 and any(s in line for s in "»›|>/"))
    return known * 2 >= len(items) - 1 and all(len(x) <= 30 for x in items)


_SEEN: dict[str, bool] = {}


def is_furniture(line: str) -> bool:
    """Whether the visible text of a line is furniture by itself."""
    known = _SEEN.get(line)
    if known is None:
        known = menu(line) or matches(fold(line))
        if len(_SEEN) > 1 << 16:
            _SEEN.clear()
        if len(line) < 200:
            _SEEN[line] = known
    return known

"""Personal information in free text: candidates, weak labellers, and their aggregation.

Each candidate span gets votes from several labellers (shape, gazetteer, word ending, context to the left and to the
right, standing by itself). Expectation-maximisation over a bounded sample estimates how far each labeller can be
relied on and how likely each candidate is to be a case; with these as soft targets a logistic span classifier is
trained, which decides over all candidates of all texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

KINDS = ("email", "phone", "id", "address", "name")
#: Votes of a candidate; each is -1, 0 or 1.
VOTES = ("shape", "given", "family", "ending", "left", "right", "alone")

# -- shapes (fixed values) ----------------------------------------------------------------------------------------

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAILS = [  # (what must stand in the text, pattern)
    (("@",), re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:{_LABEL}\.)+[A-Za-z]{{2,}}(?![A-Za-z0-9@])", re.I)),
    (("[at]", "(at)", "{at}", "<at>", "[AT]", "(AT)"), re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_+-][A-Za-z0-9._+-]* ?(?:\[at\]|\(at\)|\{{at\}}|<at>) ?{_LABEL}(?: ?(?:\[dot\]|\(dot\)|\{{dot\}}|\.| dot ) ?{_LABEL})*(?: ?(?:\[dot\]|\(dot\)|\{{dot\}}|\.| dot ) ?[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)),
    ((" dot ", " DOT "), re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_+-][A-Za-z0-9._+-]* at {_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)),
]
PHONE = re.compile(
    r"(?<![A-Za-z0-9+.,:/-])(?:"
    r"\(?\+\d{1,3}\)?[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}"
    r"|00\d{2} \d{1,4} \d{5,9}|\(0\d{1,4}\) ?\d{4,9}(?:-\d{1,4})?|0\d{1,4} ?/ ?\d{4,8}(?:-\d{1,4})?"
    r"|\(\d{3}\) ?\d{3}-\d{4}|(?:1[-.])?\d{3}-\d{3}-\d{4}|1\.\d{3}\.\d{3}\.\d{4}|\d{3}\.\d{3}\.\d{4}"
    r"|0\d(?:[ .]\d\d){4}|0\d{4} \d{6}|0\d{4} \d{3} \d{3}|9\d\d[- ]\d\d[- ](?:\d\d[- ]?\d\d|\d{4})|8[ -]\(?\d{3}\)?[ -]\d{3}[ -]\d\d[ -]\d\d"
    r"|0\d{2,3}-\d{7,8}|1\d{2}[ -]\d{4}[ -]\d{4}|1[3-9]\d{9}|\d{7}(?= ext)"
    r")(?:,? ?(?:x|ext\.?) ?\d{1,6})?(?![A-Za-z0-9]|[-.]\d)"
)
ID = re.compile(
    r"(?<![A-Za-z0-9+.,:/-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]\d{8}|[A-Z]\d{2}[A-Z]\d{5}"
    r"|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|\d{8}-?[A-Z]|\d{2} \d{3} \d{3} \d{3}|\d{2} \d{2} \d{6}|\d{4} \d{6}"
    r"|\d \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|\d{17}[\dXx]|\d{3}-\d{3}-\d{3} \d{2}"
    r")(?![A-Za-z0-9]|[-.]\d)"
)
_STREET = "Street|St\\.|Avenue|Ave|Road|Rd|Lane|Ln|Blvd|Boulevard|Court|Ct|Drive|Terrace|Way|Place|Square|Close|Crescent|Row|Gardens|Grove|Hill|Parade|Mews|Walk"
_UP = "A-ZÀ-ÖØ-ÞŒŠŽА-ЯЁ"
ADDRESSES = [
    (tuple(f" {w}" for w in _STREET.replace("\\", "").split("|")), re.compile(rf"(?<![\d\w])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \w{{1,4}},? )?\d{{1,4}}[a-z]? (?:[{_UP}][\w’'-]+ ){{1,3}}(?:{_STREET})(?!\w)")),
    (("tr.", "TR.", "traße", "trasse", "TRASSE", "TRAßE", "eg ", "EG ", "llee", "LLEE", "asse ", "ASSE ", "latz", "LATZ", "fer ", "FER ", "amm ", "ing "), re.compile(rf"(?<!\w)[{_UP}][\wäöüß-]*(?:[Ss]tr\.|STR\.|straße|strasse|STRASSE|STRAßE|[wW]eg|WEG|[aA]llee|ALLEE|[gG]asse|GASSE|[pP]latz|PLATZ|[uU]fer|UFER|[dD]amm|[rR]ing) \d{{1,4}} ?[a-z]?(?![\w])")),
    (("rue ", "avenue ", "quai ", "impasse ", "boulevard ", "place ", "chemin ", "allée ", "cours ", "route ", "square ", "passage ", "ruelle "), re.compile(rf"(?<![\d\w])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|quai|impasse|boulevard|place|chemin|allée|cours|route|square|passage|ruelle) (?:(?:de la |du |des |de |de l[’']|d[’']))?[{_UP}][\w’'-]+(?: [{_UP}][\w’'-]+)*(?:, (?:apt\.?|appt|esc\.?|bât\.?|étage) ?\w+)*")),
    (("C/", "Calle", "Avda", "Avenida", "Plaza", "Pza", "Paseo", "P.º", "Camino", "Ronda", "Travesía"), re.compile(rf"(?<![\w/])(?:C/|Calle|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|P\.º|Camino|Ronda|Travesía) ?(?:(?:de la|de las|de los|del|de) )?[{_UP}][\w’'-]+(?: [{_UP}][\w’'-]+)*,? (?:n\.?[º°o] ?)?\d{{1,4}}(?:, ?(?:\d{{1,2}}\.?[ºª°] ?[A-Za-z]{{0,3}}\b|(?:piso|esc\.|pta\.|puerta|bajo|ático) ?\w*))*")),
    (("ул.", "улица", "просп.", "пр-т", "пер.", "наб.", "бульвар"), re.compile(r"(?:ул\.|улица|просп\.|пр-т|пер\.|наб\.|бульвар) [А-ЯЁ][\w-]+(?: [А-ЯЁ][\w-]+)?, (?:д\.|дом) ?\d+\w?(?:, (?:кв\.|корп\.|стр\.|оф\.|под\.|к\.) ?\d+\w?)*")),
    (("号",), re.compile(r"(?:(?<=住在)|(?<=请寄)|(?<=寄到)|(?<=地址：)|(?<=位于)|(?<=寄往)|(?<![一-鿿])|(?<=于)|(?<=在)|(?<=寄))[一-鿿]{2,4}?(?:大道|路|街|巷|道|胡同|弄)\d+号(?:\d+(?:栋|幢|号楼))?(?:\d+单元)?(?:\d+室)?(?:\d+楼)?")),
]
#: Six digits at least, which every telephone or identity number has, but for one shape.
_NUMBERS = re.compile(r"\d(?:[ ().+/-]{0,3}\d){5}|[A-Z]\d\d[A-Z]\d{5}")

# -- context (fixed values) ---------------------------------------------------------------------------------------

_CUE = {
    "phone": re.compile(r"(?i)(?:phone|tel\.?|mobile|call|number is|left|reach .{0,20} at|telefonisch unter|appelez le|llame al|звоните|тел\.?|电话|手机|fax|\()[ :：]*$"),
    "id": re.compile(r"(?i)(?:\bids?\b|insurance|security|identity|passport|tax|account holder|personalausweis|ausweisnummer|\bdni\b|\bni[ef]\b|sécurité sociale|паспорт|снилс|инн|身份证号?|护照号?)(?:[^.\n]|\bn[or]\.){0,24}$"),
    "address": re.compile(r"(?i)(?:lives? at|left at|moved to|posted it to|went to|instead of|genauer:|habite|vive en|адрес:|住在|寄)[ ,]*$|, $"),
    "email": re.compile(r"(?i)(?:mail|to|at|an|à|a|на|邮箱|corrections:|[<(/])[ :：<]*(?:mailto:)?$"),
    "name": re.compile(r"(?i)(?:\bmr|\bmrs|\bms|\bdr|\bprof|\bherr|\bfrau|\bsra?|\bdon|\bdoña|\bmme|\bm|г-н|г-жа|госпожа)\.? $|(?:photo:|contact:|edited by|translated by|signed by|said|sagt|dit|cuenta|рассказывает|bei|auf|au nom de|a nombre de|according to|i am|write to|parcel for|whether|next to|shows|neighbour|presse :|ansprechpartner:|contacto:|联系人：|记者|读者|作者|摄影)[ :]*$"),
}
#: Abbreviations whose point ends no sentence.
_SHORT = re.compile(r"(?i)\b(?:n[or]|tel|no|ext|apt|fig)\. $")
_NOT_BEFORE = {
    "phone": re.compile(r"(?i)(?:version|isbn|part no\.|order|serial|has|rfc|ratio was)[ :]*$"),
    "id": re.compile(r"(?i)(?:part no\.?|order|isbn|version|serial|invoice|no\. of|rfc|tel\.?|phone|mobile|call|ean|sku|model|book)[ :#]*$"),
    "address": re.compile(r"(?!)"),
    "email": re.compile(r"(?!)"),
    "name": re.compile(r"(?i)\b(?:in|from|at|near|between|team|the|until|since|by the|last|next|of)\s$"),
}
_AFTER = {
    "name": re.compile(r"(?: \(|,? (?:who|asked|left|took|had|printed|lives?|moved|keeps|went|and I|wohnt|habite|vive|that runs|social security|translated|if)\b|, (?:Tel|tel|social|\d|Flat|Apt|[A-ZÄÖÜ]\w+(?:str|weg|allee|gasse|stra)|que|qui|who|всё|\+|0)|(?:住在|，电话|，手机|来信|报道|说，))"),
    "address": re.compile(r",? (?:\d{4,6}|[A-Z]\w+|in spring|and|during|instead|depuis|,)|[.，。,]"),
}
_ORG = set(
    """Press Works Institute Foundation Collective Union Archive Labs Systems Radio Review Prize Street Avenue Lane Road Market Journal Blog Notes Daily Field
    Wire Tech Planet Kitchen Letters Award Medal Hall Museum Library School University College Bridge Park Square Station Bank Group Company Ltd Inc GmbH AG
    Club Society Association House Centre Center Church Hotel Cup Trophy Festival Theatre""".split()
)
# Capitalised words that open sentences or stand for days and months.
_STOP = set(
    """the a an in by for between most not each if it its this that these those there here what when where who whoever why how nobody since until before after
    two three older readers critics will i we you he she they my our your her his and or but with from of to as at on is are was were be has have had had do
    according write questions reach applicants corrections call letters follow contact photo edited passport born tax mobile mail kind regards cheers best dear hello thanks
    version platform isbn rfc line january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
    der die das den dem des ein eine im in am an auf aus bei mit nach von zu zum zur für über unter zwischen ohne später viele im rund früher warum was ansprechpartner ausweisnummer fragen mit freundlichen grüßen
    tel personalausweis unterlagen herr frau und oder aber so wie wenn als
    le la les l un une des du de à au aux en dans près selon entre c il elle ce cette numéro contact écrivez rien n on et ou mais que qui
    el los las un una unos por qué para más según así lo dni escriba a y o nadie esta este la
    в с по на скоро почти как паспорт пишите это и но что
    flat apt unit suite street avenue road lane team""".split()
)
_TITLE = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "sr", "sra", "don", "doña", "mme", "mlle", "monsieur", "madame", "г-н", "г-жа", "sir"}

_CAP = rf"[{_UP}][^\W\d_]*(?:[-’'][^\W\d_]+)*"
_SEQUENCE = re.compile(rf"(?<![\w@.-])(?:{_CAP}\.?|[{_UP}]\.)(?:[ \xa0](?:{_CAP}\.?|[{_UP}]\.))*")
_GIVEN_AFTER, _NEXT, _NUMBERED = re.compile(rf", ({_CAP})((?: [{_UP}]\.)*)"), re.compile(rf" ({_CAP})"), re.compile(r"\.? \d")
_TOKEN = re.compile(rf"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?")


def ending(word: str) -> str:
    return word.lower()[-4:]


@dataclass(slots=True)
class Span:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]


@dataclass
class Gazetteer:
    """Name parts and what follows from them: endings of family names, ambiguous entries."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    french: set[str] = field(default_factory=set)
    endings: set[str] = field(default_factory=set)
    frequent: set[str] = field(default_factory=set)
    french_endings: set[str] = field(default_factory=set)
    han_family: str = ""
    han_given: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, rows: list[tuple[str, str, str]]) -> Gazetteer:
        """From (name_part, part_kind, lang); rows with nulls count for nothing."""
        g = cls()
        ends: Counter = Counter()
        for part, kind_, lang in rows:
            if not part or not kind_:
                continue
            if re.fullmatch("[一-鿿]+", part):
                if kind_ == "family":
                    g.han_family += part
                else:
                    g.han_given.add(part)
                continue
            (g.given if kind_ == "given" else g.family).add(part.lower())
            if kind_ == "family":
                ends[ending(part)] += 1
                if lang == "fr":
                    g.french.add(part.lower())
                    g.french_endings.add(ending(part))
        # a three-letter ending says something by itself only where names differ in the letter before it
        shorter = Counter(e[1:] for e in ends)
        g.frequent = {e for e, n in ends.items() if n >= 3}
        g.endings = set(ends) | {e for e, n in shorter.items() if n >= 3}
        return g

    def like_family(self, word: str) -> bool:
        w = word.lower()
        return any(len(w) - k >= 3 and w[-k:] in self.endings for k in (3, 4)) or (len(w) == 6 and w[-4:] in self.frequent)


class Finder:
    def __init__(self, gazetteer: Gazetteer, model: Model | None = None):
        self.g, self.model, self.roles = gazetteer, model, {}
        self.han = re.compile(f"[{gazetteer.han_family}][一-鿿]{{1,2}}") if gazetteer.han_family else None

    # -- candidates -----------------------------------------------------------------------------------------------

    def candidates(self, text: str) -> list[Span]:
        """Spans without overlap among those of one shape, with the votes of the labellers; none is left out by a vote."""
        out: list[Span] = []
        starts: list[int] = []
        ends: list[int] = []

        def free(a: int, b: int) -> bool:
            i = bisect_left(starts, b)  # of spans without overlap the last that begins before b ends last
            return i == 0 or ends[i - 1] <= a

        found: list[Span] = []
        patterns = [("email", p) for guards, p in EMAILS if any(g in text for g in guards)]
        if _NUMBERS.search(text):
            patterns += [("id", ID), ("phone", PHONE)]
        patterns += [("address", p) for guards, p in ADDRESSES if any(g in text for g in guards)]
        for kind, pattern in patterns:
            for m in pattern.finditer(text):
                a, b = m.span()
                if kind == "phone" and text[a] == "(" and text.count("(", a, b) != text.count(")", a, b):
                    a += 1
                found.append(self._structured(kind, text, a, b))
        # of overlapping ones those that no word speaks against, then the longer; of equal ones that which words name
        for s in sorted(found, key=lambda s: (s.votes[4] < 0, s.start - s.end, -s.votes[4], -s.votes[0])):
            if free(s.start, s.end):
                out.append(s)
                i = bisect_left(starts, s.start)
                starts.insert(i, s.start)
                ends.insert(i, s.end)
        out += [s for s in self._names(text) if free(s.start, s.end)]
        return out

    def _structured(self, kind: str, text: str, a: int, b: int) -> Span:
        before, after = text[max(0, a - 40) : a], text[b : b + 30]
        span = text[a:b]
        left = -1 if _NOT_BEFORE[kind].search(before) else 1 if _CUE[kind].search(before) else 0
        right = 1 if kind in _AFTER and _AFTER[kind].match(after) else 0
        plain = kind == "id" and re.fullmatch(r"\d{9}|\d{4} \d{6}", span) is not None
        alone = 1 if not before or before.endswith(("\n", ". ", "。")) and not _SHORT.search(before) else 0
        return Span(kind, a, b, (0 if plain else 1, 0, 0, 0, left, right, alone))

    def _names(self, text: str) -> list[Span]:
        g, out = self.g, []
        for m in _SEQUENCE.finditer(text):
            seq = m[0]
            tokens = [(t[0], m.start() + t.start(), m.start() + t.end()) for t in _TOKEN.finditer(seq)]
            if out and m.start() < out[-1].end:  # the given name of "Family, Given"
                tokens = [t for t in tokens if t[1] >= out[-1].end]
            if any(self._role(t[0]) in "GF" for t in tokens):
                out += [s for s in self._split(text, tokens) if s.votes[0] > 0 or max(s.votes[1], s.votes[2], *s.votes[4:]) > 0]
        if self.han:
            for m in self.han.finditer(text):
                for n in (3, 2):
                    a, b = m.start(), m.start() + n
                    if b > m.end():
                        continue
                    given = text[a + 1 : b] in g.han_given
                    left = 1 if _CUE["name"].search(text[max(0, a - 6) : a]) else 0
                    right = 1 if _AFTER["name"].match(text[b : b + 4]) else 0
                    if given or left and right:
                        out.append(Span("name", a, b, (1, 1 if given else 0, 1, 0, left, right, 0)))
                        break
        return out

    def _role(self, token: str) -> str:
        """T title, I initial, G given, F family, S function word, W word of organisations, O other."""
        known = self.roles.get(token)
        if known is None:
            if len(self.roles) > 1 << 16:
                self.roles.clear()
            known = self.roles[token] = self._role_of(token)
        return known

    def _role_of(self, token: str) -> str:
        w = token.rstrip(".").lower()
        if w in _TITLE:
            return "T"
        if len(w) == 1 and token.endswith("."):
            return "I"
        if w in self.g.given:
            return "G"
        if w in self.g.family or self.g.like_family(w):
            return "F"
        if w in _STOP:
            return "S"
        return "W" if token.rstrip(".") in _ORG or token.rstrip(".").title() in _ORG else "O"

    def _split(self, text: str, tokens: list[tuple[str, int, int]]) -> list[Span]:
        g, out, i = self.g, [], 0
        roles = [self._role(t[0]) for t in tokens]
        n = len(tokens)
        while i < n:
            if roles[i] not in "GFIO":
                i += 1
                continue
            # the end of a sentence ends a sequence, unless it is an initial's point
            j, seen = i, ""
            while j < n and roles[j] in "GFIO":
                seen += roles[j]
                j += 1
                if tokens[j - 1][0].endswith(".") and roles[j - 1] != "I":
                    break
            chunk, what = tokens[i:j], seen
            m = re.search("[GO]?I{0,2}F", what) if "F" in what else None
            if m is None:
                m = re.search("GI{0,2}O(?!O)", what) or re.search("G", what)
                if m and m[0].endswith("O") and (j < n and roles[j] == "W" or not _AFTER["name"].match(text[chunk[m.end() - 1][2] : chunk[m.end() - 1][2] + 30])):
                    m = re.search("G", what)  # an unknown word is a family name only where the words after say so
            if m is None:
                i = j
                continue
            a, b = chunk[m.start()][1], chunk[m.end() - 1][2]
            last = chunk[m.end() - 1][0]
            if last.endswith(".") and what[m.end() - 1] != "I":
                b -= 1
            first = i + m.start()
            word = last.rstrip(".")
            if what[m.start()] == "I" and chunk[m.start()][0] == "M." and (word.lower() in g.french or ending(word) in g.french_endings):
                a = chunk[m.start() + 1][1]  # Monsieur
            end = i + m.end()
            # Family, Given
            if what[m.end() - 1] == "F" and "G" not in m[0] and (first == 0 or roles[first - 1] != "G"):
                later = _GIVEN_AFTER.match(text, b)
                if later:
                    role, then = self._role(later[1]), _NEXT.match(text, later.end())
                    known = role == "G" or role == "O" and len(later[1]) > 2 and (_AFTER["name"].match(text[later.end() : later.end() + 30]) or _CUE["name"].search(text[max(0, a - 30) : a]))
                    if known and not (role == "O" and _NUMBERED.match(text, later.end())) and not (then and self._role(then[1]) == "F"):
                        b = later.end()
            out.append(self._name(text, a, b, m[0], word, roles, tokens, end))
            i = end
        return out

    @staticmethod
    def _opens(text: str, at: int) -> bool:
        return at == 0 or text[at - 1] == "\n" or text[max(0, at - 2) : at] in (". ", "! ", "? ", '" ')

    def _name(self, text: str, a: int, b: int, what: str, last: str, roles: list[str], tokens: list, end: int) -> Span:
        g = self.g
        before, after = text[max(0, a - 30) : a], text[b : b + 30]
        parts = [t.rstrip(".").lower() for t in re.findall(_TOKEN, text[a:b])]
        given = 1 if any(p in g.given for p in parts) else 0
        family = 1 if any(p in g.family for p in parts) else 0
        end_vote = 1 if any(g.like_family(p) for p in parts) else 0
        shape = 1 if len(parts) > 1 else -1
        opens = self._opens(text, a) or re.search(r"(?:[,:]|regards|Grüßen|Cheers)\s$", before) is not None
        if not opens and not re.match(r"\s?\d", after):  # right behind a number or an address of mail
            opens = re.search(r"(?:\S*[@\d]\S*|\.[a-z]{2,}|\bdot \w+)[>\])]?\s$", before) is not None
        closes = not after or after[0] == "\n" or re.match(rf"\s(?:[{_UP}\d„«“\"¿(]|[一-鿿])", after) is not None or re.match(r"[.。]?\s*(?:\n|\Z)", after) is not None
        org = end < len(tokens) and roles[end] == "W"
        left = 1 if _CUE["name"].search(before) else -1 if _NOT_BEFORE["name"].search(before) and len(parts) == 1 else 0
        right = -1 if org else 1 if _AFTER["name"].match(after) else 0
        if len(parts) == 1 and what[-1] != "F" and re.match(r"[ ,]+[a-zà-ÿ]", after) and right <= 0:
            right = -1
        return Span("name", a, b, (shape, given, family, end_vote, left, right, 1 if opens and closes else -1))

    # -- decision -------------------------------------------------------------------------------------------------

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, in order and without overlap; null and empty texts have none."""
        if not text:
            return []
        good = [s for s in self.candidates(text) if self.model is None or self.model.decide(s)]
        good.sort(key=lambda s: (s.start, -s.end))
        out: list[tuple[str, int, int]] = []
        for s in good:
            if not out or s.start >= out[-1][2]:
                out.append((s.kind, s.start, s.end))
        return out


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with a typed placeholder in the stead of each span, all else unchanged."""
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


#: What is believed of a labeller beforehand counts as so many candidates: little beside those of a table.
BELIEF = 50.0


class Model:
    """Reliabilities of the labellers by expectation-maximisation, and the span classifier trained on them."""

    def __init__(self, votes: dict[str, Counter], rounds: int = 40):
        self.weights: dict[str, np.ndarray] = {}
        self.reliability: dict[str, np.ndarray] = {}
        for kind in KINDS:
            patterns = list(votes.get(kind, {}))
            if patterns:
                self._fit(kind, np.array(patterns), np.array([votes[kind][p] for p in patterns], float), rounds)

    @staticmethod
    def features(votes: np.ndarray) -> np.ndarray:
        """One column for each vote for and each against, and those that several labellers agree on."""
        v = np.atleast_2d(votes).astype(float)
        known = ((v[:, 1] > 0) | (v[:, 2] > 0) | (v[:, 3] > 0)).astype(float)
        context = ((v[:, 4] > 0) | (v[:, 5] > 0)).astype(float)
        return np.hstack([np.ones((len(v), 1)), v > 0, v < 0, (v[:, :1] > 0) * known[:, None], known[:, None] * context[:, None], known[:, None] * (v[:, 6:7] > 0)]).astype(float)

    def _fit(self, kind: str, v: np.ndarray, n: np.ndarray, rounds: int) -> None:
        k = v.shape[1]
        # what a labeller says of cases and of others before any evidence, worth so many candidates
        belief = np.repeat(np.array([[[0.10, 0.35, 0.55], [0.50, 0.40, 0.10]]]), k, axis=0)  # labeller, case or other, vote
        if kind == "name":
            belief[0] = [[0.25, 0.05, 0.70], [0.80, 0.05, 0.15]]
            belief[4] = [[0.03, 0.57, 0.40], [0.20, 0.78, 0.02]]
            belief[5] = [[0.03, 0.57, 0.40], [0.50, 0.47, 0.03]]
            belief[6] = [[0.50, 0.05, 0.45], [0.9985, 0.001, 0.0005]]
        weight = BELIEF
        theta = belief.copy()
        prior = 0.8
        for _ in range(rounds):
            log = np.log(np.array([prior, 1 - prior]))[None, :] + sum(np.log(theta[j][:, v[:, j] + 1]).T for j in range(k))
            p = np.exp(log - log.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            if kind == "name":  # anchored: a known name that is all of a line or sentence, as a signature is
                p[(v[:, 1] > 0) & (v[:, 6] > 0) & (v[:, 5] >= 0) & (v[:, 4] >= 0)] = (0.97, 0.03)
            else:  # anchored: a shape that the words before call what it is, and what they call something else
                p[(v[:, 0] > 0) & (v[:, 4] > 0)] = (0.97, 0.03)
                p[v[:, 4] < 0] = (0.03, 0.97)
            prior = float(np.clip((p[:, 0] @ n + 8) / (n.sum() + 10), 0.05, 0.99))
            for j in range(k):
                for z in range(2):
                    count = np.array([(p[:, z] * n)[v[:, j] == x].sum() for x in (-1, 0, 1)]) + weight * belief[j, z]
                    theta[j, z] = count / count.sum()
                if kind != "name":  # the parts of a name depend on each other, the votes for a shape do not
                    theta[j] = self._no_worse_than_chance(theta[j], p.T @ n)
        self.reliability[kind] = theta
        # soft targets: the posterior; weights by count, damped so that rare patterns are learned too
        x, y, c = self.features(v), p[:, 0], np.sqrt(n)
        w = np.zeros(x.shape[1])
        for _ in range(400):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (c * (q - y)) / c.sum() + 1e-3 * w
            h = (x * (c * q * (1 - q))[:, None]).T @ x / c.sum() + 1e-2 * np.eye(len(w))
            step = np.linalg.solve(h, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights[kind] = w
        self.cache: dict = {}

    @staticmethod
    def _no_worse_than_chance(t: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A vote for a case never tells against one, nor a vote against for one: what says so is pooled."""
        t = t.copy()
        for vote, wrong in ((2, t[0, 2] < t[1, 2]), (0, t[0, 0] > t[1, 0])):
            if wrong:
                t[:, vote] = (size @ t[:, vote]) / size.sum()
        t[:, 1] = np.maximum(1 - t[:, 0] - t[:, 2], 1e-4)
        return t / t.sum(axis=1, keepdims=True)

    def score(self, s: Span) -> float:
        if (known := self.cache.get((s.kind, s.votes))) is None:
            w = self.weights.get(s.kind)
            known = 0.5 if w is None else float(1 / (1 + np.exp(-np.clip(self.features(np.array(s.votes)) @ w, -30, 30)))[0])
            self.cache[s.kind, s.votes] = known
        return known

    def decide(self, s: Span) -> bool:
        return self.score(s) >= 0.5

    def says(self, kind: str, votes: tuple[int, ...]) -> bool:
        """What it decides over any candidate of these votes."""
        return self.decide(Span(kind, 0, 0, votes))

"""Text decoded with the wrong character encoding: find it and restore it where possible.

A hidden Markov model labels each character: one state stands for clean text, one for each pair of encodings (what
the bytes were, what they were read as), one for characters that were lost. The emissions are bigrams, learned from a
bounded sample of clean texts for the clean state and from the same texts passed through each pair for the others.
Each labelled span then gets the inverse transform of its state; what comes out is labelled again, so that text
garbled more than once is undone step by step.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from feedloom.llm import bigrams
from feedloom.llm.bigrams import LOST


@lru_cache(maxsize=None)
def _one_byte(wrong: str) -> tuple[dict[int, str], dict[str, int]]:
    """What each byte is read as, and back; undefined bytes become control characters, as browsers have it."""
    there = {}
    for b in range(256):
        try:
            there[b] = bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            there[b] = chr(b)
    back = {chr(b): b for b in range(0x80, 0xA0)} | {c: b for b, c in there.items()}
    return there, back


def read_as(data: bytes, wrong: str) -> str:
    return data.decode("latin-1").translate(_one_byte(wrong)[0])


def bytes_of(text: str, wrong: str) -> bytes | None:
    """The inverse of read_as; None if a character can't come from it."""
    back = _one_byte(wrong)[1]
    return bytes(back[c] for c in text) if all(c in back for c in text) else None


#: (name, true encoding, encoding it was read with, whether each is of several bytes a character).
PAIRS = [
    ("utf8 as latin1", "utf-8", "latin-1"),
    ("utf8 as cp1252", "utf-8", "cp1252"),
    ("utf8 as cp1251", "utf-8", "cp1251"),
    ("utf8 as macroman", "utf-8", "mac_roman"),
    ("utf8 as gbk", "utf-8", "gb18030"),
    ("gbk as cp1252", "gbk", "cp1252"),
    ("cp1251 as cp1252", "cp1251", "cp1252"),
    ("koi8r as cp1251", "koi8_r", "cp1251"),
    ("cp1251 as koi8r", "cp1251", "koi8_r"),
    ("koi8r as cp1252", "koi8_r", "cp1252"),
    ("cp1252 as macroman", "cp1252", "mac_roman"),
    ("macroman as cp1252", "mac_roman", "cp1252"),
    ("cp1252 as cp1251", "cp1252", "cp1251"),
]
WIDE = {"gb18030", "gbk"}
#: The characters of European writing and usual signs in short contexts, so that each garbled form of one is known.
EVERY = [f"a{c}e {c}a a{c} {c} 1{c} {c}1" for c in map(chr, [*range(0xA0, 0x180), *range(0x2010, 0x2040), 0x20AC, 0x2116, 0x2122])]
RUSSIAN = ("cp1251", "koi8_r")
CLEAN = 0


def garble(text: str, true: str, wrong: str) -> str:
    data = text.encode(true, "ignore")
    return data.decode(wrong, "replace") if wrong in WIDE else read_as(data, wrong)


def restore(span: str, true: str, wrong: str) -> str | None:
    """The inverse transform of a span; None if it gives nothing readable. Lost characters stay lost."""
    parts = []
    for piece in re.split(f"({LOST}+)", span):
        if not piece or piece[0] == LOST:
            parts.append(piece.encode("utf-8") if wrong not in WIDE else b"\xff" * bool(piece))
            continue
        try:
            data = piece.encode(wrong) if wrong in WIDE else bytes_of(piece, wrong)
        except UnicodeEncodeError:
            return None
        if data is None:
            return None
        parts.append(data)
    data = b"".join(parts)
    try:
        return data.decode(true)
    except UnicodeDecodeError:
        if LOST not in span:  # what was not lost can't come out as lost
            return None
        return re.sub(f"{LOST}+", LOST, data.decode(true, "replace"))


def kind(c: str) -> str:
    """The class of a character, for characters not seen before."""
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c <= " " else "."
    if c == LOST:
        return "?"
    if c <= "\x9f":
        return "^"
    o, g = ord(c), unicodedata.category(c)
    script = "L" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "C" if 0x400 <= o < 0x530 else "H" if 0x3400 <= o < 0xA000 else "X"
    if g in ("Ll", "Lu"):
        return script + g[1] if script != "X" else "X"
    return script if g[0] == "L" and c not in "ªº" else "q" if g in ("Pi", "Pf", "Ps", "Pe", "Pd", "Po", "Zs") else "s"


KINDS = ["a", "A", "0", " ", ".", "?", "^", "Ll", "Lu", "Cl", "Cu", "H", "L", "C", "X", "q", "s"]


#: A capital within a word, a sign that joins letters or stands for one, a lone capital after a number.
_ODD = re.compile(r"(?<=[a-zß-ÿ])[A-ZÀ-ÖØ-ÞŒŸ]|[‡†‰‹›ˆ˜¸˛˝˙˚˘¯ﬁﬂ∆∂∑∏∫√∞≈≠≤≥◊ΩπıÒÛÙ]|(?<=[^\W\d_])[·„“”](?=[^\W\d_])|(?<=\d )[À-ÖØ-Þ](?!\w)|(?<![\w])[ñó](?![\w])|[\x80-\x9f]")


#: Han characters beside a Latin letter, those behind one and those before one.
_HAN_RUN = re.compile(r"(?<=[A-Za-z])([㐀-鿿]+)|(?<![㐀-鿿])([㐀-鿿]+)(?=[A-Za-z])")


def odd(text: str) -> int:
    """Places that a text in a Latin alphabet seldom has."""
    return len(_ODD.findall(text))


class Model:
    """Bigram emissions for each state. `enter` is the log probability of leaving clean text at a character."""

    def __init__(self, texts: list[str] | bigrams.Counts, enter: float = -7.0, leave: float = -1.5):
        self.enter, self.leave = enter, leave
        self.states: list[tuple[str, str | None, str | None]] = [("clean", None, None), ("lost", None, None), *PAIRS]
        clean = texts if isinstance(texts, bigrams.Counts) else bigrams.Counts(*bigrams.count(texts))
        every = clean.plus(bigrams.Counts(*bigrams.count(EVERY)), 0.2)
        self.tables: list[bigrams.Bigrams | None] = [bigrams.Bigrams(*clean.part(bigrams.TEXT), kind, clean.part(bigrams.ASCII)), None]
        self.tables += [self._read_as(every, true, wrong) for _, true, wrong in PAIRS]
        self.seen: dict[tuple[str, str], tuple[float, ...]] = {}
        self.gains: dict[tuple[str, str], float] = {}

    @staticmethod
    def _read_as(counts: bigrams.Counts, true: str, wrong: str) -> bigrams.Bigrams:
        """The bigrams of the same lines after the pair."""
        if wrong in WIDE:
            return bigrams.Bigrams(*counts.part(bigrams.AS_GB18030), kind)
        once = lambda c: garble(c, true, wrong)
        left = counts.left_by(true)
        parts = [bigrams.read_as(*left, once)]
        if true == "utf-8":  # often done twice
            parts.append(bigrams.read_as(*left, lambda c: once(once(c))))
        return bigrams.Bigrams(*bigrams.total(*map(np.concatenate, zip(*parts, strict=True))), kind)

    def emissions(self, a: str, b: str) -> tuple[float, ...]:
        """Log probability of b after a in each state; ASCII after ASCII tells nothing."""
        if (out := self.seen.get((a, b))) is None:
            if a < "\x80" and b < "\x80":
                out = (0.0,) * len(self.states)
            else:
                ka, kb, values = kind(a), kind(b), []
                key = bigrams.key(a, b)
                for s, table in enumerate(self.tables):
                    if table is None:
                        values.append(-1.0 if b == LOST else -6.0 if b < "\x80" else -14.0)
                        continue
                    n = table.firsts.get(a, 0)
                    by_kind = (table.kinds.get((ka, kb), 0) + 0.02) / (table.kind_firsts.get(ka, 0) + 0.02 * len(KINDS))
                    size = {"H": 3000, "s": 60, "q": 30}.get(kb, 60)
                    floor = by_kind / size if s == CLEAN else by_kind / size / 30
                    weight = 4.0
                    values.append(math.log((table.get(key) + weight * floor) / (n + weight)))
                out = tuple(values)
            if len(self.seen) > 1 << 19:
                self.seen.clear()
            self.seen[a, b] = out
        return out

    def quiet(self, text: str) -> bool:
        """Whether the likeliest path stays in clean text: no run of characters gains as much as leaving it costs.

        The gain of a run is bounded by the sum of what the best state gains at each character, whatever the state.
        """
        cost, run = -self.enter / 2 - self.leave, 0.0
        gains, prev = self.gains, " "
        for c in text:
            if c > "\x7f" or prev > "\x7f":
                if (g := gains.get((prev, c))) is None:
                    if len(gains) > 1 << 19:
                        gains.clear()
                    e = self.emissions(prev, c)
                    g = gains[prev, c] = max(e[1:]) - e[0]
                run += g
                if run > cost:
                    return False
                if run < 0.0:
                    run = 0.0
            prev = c
        if prev > "\x7f":
            e = self.emissions(prev, " ")
            run += max(e[1:]) - e[0]
        return run <= cost

    def likelihood(self, text: str, a: int, b: int) -> float:
        """Log probability of text[a:b] in its context if it is clean."""
        t = f" {text} "
        return sum(self.emissions(t[i], t[i + 1])[CLEAN] - 12.0 * (t[i + 1] == LOST) for i in range(a, b + 1))

    def label(self, text: str, banned: frozenset[int] = frozenset()) -> list[tuple[int, int, int]]:
        """(begin, end, state) of the spans that are not clean, by the likeliest path without banned states."""
        if self.quiet(text):
            return []
        k = len(self.states)
        enter = [0.0, *[-99.0 if s in banned else self.enter if true != "utf-8" else self.enter / 2 for s, (_, true, _) in enumerate(self.states) if s]]
        score = list(enter)
        back: list[list[int]] = []
        prev = " "
        for c in [*text, " "]:
            e = self.emissions(prev, c)
            came = list(range(k))
            best = max(range(1, k), key=lambda s: score[s])
            new = [0.0] * k
            out = score[best] + self.leave
            if out > score[0]:
                new[0], came[0] = out + e[0], best
            else:
                new[0] = score[0] + e[0]
            for s in range(1, k):
                if (go := score[0] + enter[s]) > score[s]:
                    new[s], came[s] = go + e[s], 0
                else:
                    new[s] = score[s] + e[s]
            score = new
            back.append(came)
            prev = c
        s = 0
        path = []
        for came in reversed(back):
            path.append(s)
            s = came[s]
        path.reverse()
        spans, i, n = [], 0, len(text)
        while i < n:
            if path[i] == CLEAN:
                i += 1
                continue
            j = i
            while j < n and path[j] == path[i]:
                j += 1
            a, b = i, j
            while a < b and text[a] < "\x80":
                a += 1
            while a < b and text[b - 1] < "\x80":
                b -= 1
            if a < b:
                spans.append((a, b, path[i]))
            i = j
        return spans

    def repair(self, text: str) -> tuple[bool, bool, str]:
        """(affected, fully restored, text); a text that is not affected comes back unchanged.

        Spans are restored until there are none, or until a text comes back that was there before.
        """
        affected = LOST in text
        before: set[str] = set()
        banned: frozenset[int] = frozenset()
        single = frozenset(s for s, (_, true, _) in enumerate(self.states) if true not in (None, "utf-8"))
        while True:
            out, at, refused = [], 0, set()
            used = set()
            for a, b, s in self.label(text, banned) or self.proposals(text, banned):
                _, true, wrong = self.states[s]
                if true is None:
                    continue
                a, b = self._whole(text, max(a, at), b, at, wrong)
                fixed = restore(text[a:b], true, wrong) if a < b else None
                if true not in ("utf-8", "gbk") and fixed is not None:
                    fixed = self._likeliest(text, a, b, fixed, true)
                if fixed is not None and self._quoted(text, a, b, fixed):
                    continue
                if fixed is None or fixed == text[a:b] or not self._better(text, a, b, fixed, true):
                    refused.add(s)
                    continue
                out += [text[at:a], fixed]
                at = b
                used.add(s)
            if at:
                affected = True
                before.add(text)
                text = "".join(out) + text[at:]
                banned = single - used  # other pairs than UTF-8 are not tried on what one of them restored
                if text in before:
                    break
            elif refused - banned:
                banned |= refused
            else:
                break
        return affected, affected and LOST not in text, text

    def _likeliest(self, text: str, a: int, b: int, fixed: str, true: str) -> str:
        """One-byte pairs of like scripts are told apart by what they restore: the likeliest as clean text."""
        other = [restore(text[a:b], t, w) for _, t, w in PAIRS if w not in WIDE and t not in ("utf-8", "gbk") and (t in RUSSIAN) == (true in RUSSIAN)]
        other = [o for o in other if o is not None]
        return max(other, key=lambda o: self.likelihood(text[:a] + o + text[b:], a, a + len(o)), default=fixed)

    def _better(self, text: str, a: int, b: int, fixed: str, true: str) -> bool:
        """The exact check: what the inverse transform gives is likelier as clean text than what stands there.

        Russian must come out in whole words, at least one of three letters: one letter among Latin ones is chance.
        """
        if true in RUSSIAN:
            words = re.findall(r"\w+", (text[:a] + fixed + text[b:])[max(0, a - 20) : a + len(fixed) + 20])
            russian = [w for w in words if re.search("[А-яЁё]", w)]
            if any(re.search("[A-Za-zÀ-ÿ]", w) for w in russian) or max(map(len, russian), default=0) < 3:
                return False
        gain = 2.0
        if true not in ("utf-8", "gbk", *RUSSIAN):
            before, then = odd(text[max(0, a - 3) : b + 1]), odd(text[max(0, a - 3) : a] + fixed + text[b : b + 1])
            if before <= then:
                return False
            gain = -6.0 if not then else 2.0
        after = text[:a] + fixed + text[b:]
        return self.likelihood(after, a, a + len(fixed)) > self.likelihood(text, a, b) + gain

    def proposals(self, text: str, banned: frozenset[int]) -> list[tuple[int, int, int]]:
        """Spans that are too short for the path of states to leave clean text, but stand out by themselves: odd signs in
        a Latin text, and Han characters beside Latin letters whose bytes are valid UTF-8."""
        for s, (_, true, wrong) in enumerate(self.states):
            if true is None or s in banned:
                continue
            if wrong in WIDE:
                spans = [(a, b) for m in _HAN_RUN.finditer(text) for a, b in [self._utf8(*m.span(), text, wrong, m[1] is not None)] if a < b]
            elif true == "cp1252":
                spans = [m.span() for m in _ODD.finditer(text) if not m[0].isascii()]
            else:
                spans = []
            if spans:
                return [(a, b, s) for a, b in spans]
        return []

    @staticmethod
    def _utf8(a: int, b: int, text: str, wrong: str, behind: bool) -> tuple[int, int]:
        """Of a run of Han characters the longest part beside the letter whose bytes are valid UTF-8; (a, a) if none is."""
        sizes = [len(c.encode(wrong)) for c in text[a:b]]
        data = text[a:b].encode(wrong)
        if behind:  # the part begins where the run does
            try:
                valid = len(data.decode("utf-8").encode("utf-8"))
            except UnicodeDecodeError as e:
                valid = e.start
            ends, n = set(), 0
            for c in data[:valid].decode("utf-8"):
                n += len(c.encode("utf-8"))
                ends.add(n)
            at, stop = 0, a
            for i, size in enumerate(sizes):
                at += size
                if at in ends:
                    stop = a + i + 1
            return a, stop
        at = 0
        for i, size in enumerate(sizes):  # an invalid byte is met soon, so that most tries are short
            try:
                data[at:].decode("utf-8")
                return a + i, b
            except UnicodeDecodeError:
                at += size
        return a, a

    @staticmethod
    def _whole(text: str, a: int, b: int, least: int, wrong: str) -> tuple[int, int]:
        """The span grown to the characters beyond ASCII around it that the pair can have made."""

        def ok(c: str) -> bool:
            if c < "\x80" or (c == LOST and wrong not in WIDE):
                return False
            return wrong in WIDE or bytes_of(c, wrong) is not None

        while a > least and ok(text[a - 1]):
            a -= 1
        while b < len(text) and ok(text[b]):
            b += 1
        return a, b

    @staticmethod
    def _quoted(text: str, a: int, b: int, fixed: str) -> bool:
        """A sequence quoted on purpose: a word of its own, whose right form is another word of the text."""
        edge = lambda c: not c.isalnum()
        if b - a > 12 or (a and not edge(text[a - 1])) or (b < len(text) and not edge(text[b])):
            return False
        return re.search(rf"(?<!\w){re.escape(fixed)}(?!\w)", text[:a] + " " + text[b:]) is not None


#: The lines of a script with more of them count as so many together, so that scripts weigh the same in the emissions.
MASS = 600


def fit(clean: DataFrame, text: str, mass: float | None = MASS) -> Model:
    """Fit the model on all lines of a table of mostly clean texts: their bigrams are counted where the texts lie."""
    return Model(bigrams.Counts(*bigrams.counted(clean, text), mass))


def repair_columns(df: DataFrame, columns: list[str], model: Model, suffix: str = "_repair") -> DataFrame:
    """Add for each column a struct (affected, restored, text) named column + suffix.

    `text` is the original text where it can be restored, else as far as it can be; texts that are not affected come
    out unchanged, null stays null. Only texts with a character beyond ASCII are labelled. Nothing is shuffled.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(c + suffix, T.StructType([T.StructField("affected", T.BooleanType()), T.StructField("restored", T.BooleanType()), T.StructField("text", T.StringType())])) for c in columns]])
    kind_of = pa.struct([("affected", pa.bool_()), ("restored", pa.bool_()), ("text", pa.string())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # the distinct bigrams, 16 bytes each

    def one(m: Model, t: str | None) -> dict:
        if t is None or t.isascii():
            return {"affected": False, "restored": False, "text": t}
        a, r, fixed = m.repair(t)
        return {"affected": a, "restored": r, "text": fixed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            new = [pa.array([one(m, t) for t in batch.column(batch.schema.get_field_index(c)).to_pylist()], kind_of) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[c + suffix for c in columns]])

    return df.mapInArrow(run, schema)

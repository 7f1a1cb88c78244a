"""Bigrams of all lines of a table, counted so that the counts of the lines read with other encodings follow from them.

Counted are the bigrams with a character beyond ASCII, those across characters that an encoding lacks (which it leaves
out), and those of UTF-8 read as GB18030, where what a character becomes depends on the one before it. Whatever else is
read byte by byte makes of each character a string of its own, so that its bigrams are those within the strings and
those where two strings meet. Lines that lost characters are left out; a line has a blank before and behind it.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
#: Encodings that lack characters.
NARROW = ("gbk", "cp1251", "koi8_r", "cp1252", "mac_roman")
#: What a count is of: a bigram of the text, an ASCII character, a line, a bigram of the text's UTF-8 read as GB18030; from ACROSS on a bigram across what an encoding lacks.
TEXT, ASCII, LINES, AS_GB18030, ACROSS = range(5)
SCRIPTS = 4
_BITS = 21
_MASK = (1 << _BITS) - 1
_HAN = ((0x2E80, 0x2FDF), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_CYRILLIC = ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))
_LATIN = ((0xC0, 0x17F),)
#: Characters that are counted at once, and counts that a task holds before it adds them up.
_CHUNK, _HELD = 1 << 20, 1 << 22


@lru_cache(maxsize=None)
def has(encoding: str) -> np.ndarray:
    """Whether the encoding has each code point."""
    out = np.zeros(0x110000, bool)
    for o in range(0x10000):  # none of these encodings goes beyond
        out[o] = len(chr(o).encode(encoding, "ignore")) > 0
    return out


def key(a: str, b: str) -> int:
    return ord(a) << _BITS | ord(b)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _within(codes: np.ndarray, ranges: tuple) -> np.ndarray:
    return np.logical_or.reduce([(codes >= a) & (codes <= b) for a, b in ranges])


def total(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def _joined(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the lines with a blank between and around them, and the places of these blanks."""
    c = _codes("\n" + "\n".join(lines) + "\n")
    ends = np.flatnonzero(c == 10)
    c[ends] = 32
    return c, ends


def _beyond_ascii(c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, a, b) of the bigrams with a character beyond ASCII."""
    high = c > 127
    at = np.flatnonzero(high[:-1] | high[1:])
    return np.searchsorted(ends, at, "right") - 1, c[at], c[at + 1]


def _count(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    c, ends = _joined(lines)
    high = np.flatnonzero(c > 127)
    codes, line = c[high], np.searchsorted(ends, high) - 1
    script = np.full(len(lines), SCRIPTS - 1)
    for s, ranges in ((2, _LATIN), (1, _CYRILLIC), (0, _HAN)):
        script[line[_within(codes, ranges)]] = s
    keys, sums = [], []

    def add(what: int, s: np.ndarray, a: np.ndarray, b: np.ndarray | int, n: np.ndarray | None = None) -> None:
        packed = ((s << 4 | what) << _BITS | a) << _BITS | b
        k, n = np.unique(packed, return_counts=True) if n is None else (packed, n)
        keys.append(k)
        sums.append(n)

    at, a, b = _beyond_ascii(c, ends)
    add(TEXT, script[at], a, b)
    begun, each = c[: ends[-1]], np.repeat(script, np.diff(ends))
    plain = begun < 128
    n = np.bincount(each[plain] << 7 | begun[plain], minlength=SCRIPTS << 7)
    some = np.flatnonzero(n)
    add(ASCII, some >> 7, some & 127, 0, n[some])
    n = np.bincount(script, minlength=SCRIPTS)
    add(LINES, np.arange(SCRIPTS), np.zeros(SCRIPTS, np.int64), 0, n)
    for i, encoding in enumerate(NARROW):
        gone = high[~has(encoding)[codes]]
        if len(gone):
            apart = np.diff(gone) > 1
            before, behind = gone[np.r_[True, apart]] - 1, gone[np.r_[apart, True]] + 1
            a, b = c[before], c[behind]
            met = (a > 127) | (b > 127)
            add(ACROSS + i, script[np.searchsorted(ends, before[met], "right") - 1], a[met], b[met])
    other = np.flatnonzero(np.bincount(line, minlength=len(lines)))
    if len(other):
        at, a, b = _beyond_ascii(*_joined([lines[i].encode("utf-8").decode("gb18030", "replace") for i in other]))
        add(AS_GB18030, script[other[at]], a, b)
    return total(np.concatenate(keys), np.concatenate(sums))


def count(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (script, what, a, b) and how often each stands in the lines of the texts."""
    keys, sums, held = [], [], 0
    lines: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal keys, sums, held, lines, size
        if lines:
            k, n = _count(lines)
            keys.append(k)
            sums.append(n)
            held += len(k)
            lines, size = [], 0
        if held > _HELD:
            k, n = total(np.concatenate(keys), np.concatenate(sums))
            keys, sums, held = [k], [n], 0

    for text in texts:
        for x in (text or "").split("\n"):
            if x and LOST not in x:
                lines.append(x)
                size += len(x)
                if size > _CHUNK:
                    flush()
    flush()
    return total(np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*sums, np.zeros(0, np.int64)]))


def counted(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The same over all rows of a table. Tasks add up their own counts; distinct keys come to the driver, 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = count(t for batch in batches for t in batch.column(0).to_pylist())
        for i in range(0, len(k), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + _CHUNK]), pa.array(n[i : i + _CHUNK])], names=["k", "n"])

    x = df.select(F.col(f"`{text}`")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return total(x.column("k").to_numpy(), x.column("n").to_numpy())


class Counts:
    """Weighted counts by what they are of: bigrams of the text and of the text read with other encodings."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, mass: float | None = None):
        """With `mass` the lines of a script with more of them count as so many together, each as much as the others."""
        script, what = keys >> 2 * _BITS + 4, keys >> 2 * _BITS & 15
        lines = np.bincount(script[what == LINES], n[what == LINES], minlength=SCRIPTS)
        weight = np.ones(SCRIPTS) if mass is None else np.minimum(1.0, mass / np.maximum(lines, 1))
        self.parts = {int(w): total(keys[what == w] & (1 << 2 * _BITS) - 1, (n * weight[script])[what == w]) for w in np.unique(what)}

    def part(self, what: int) -> tuple[np.ndarray, np.ndarray]:
        return self.parts.get(what, (np.zeros(0, np.int64), np.zeros(0)))

    def plus(self, other: Counts, weight: float) -> Counts:
        out = Counts.__new__(Counts)
        out.parts = {w: total(*map(np.concatenate, zip(self.part(w), (other.part(w)[0], other.part(w)[1] * weight), strict=True))) for w in {*self.parts, *other.parts}}
        return out

    def left_by(self, encoding: str) -> tuple[np.ndarray, np.ndarray]:
        """Bigrams of the text without the characters that the encoding lacks."""
        k, n = self.part(TEXT)
        if encoding not in NARROW:
            return k, n
        there = has(encoding)
        both = there[k >> _BITS] & there[k & _MASK]
        k2, n2 = self.part(ACROSS + NARROW.index(encoding))
        return total(np.concatenate([k[both], k2]), np.concatenate([n[both], n2]))


def read_as(keys: np.ndarray, n: np.ndarray, becomes: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams with a character beyond ASCII after each character became a string of its own."""
    a, b = keys >> _BITS, keys & _MASK
    chars = np.unique(np.concatenate([a, b]))
    strings = [becomes(chr(o)) for o in chars]
    firsts, lasts = (np.array([ord(s[i]) for s in strings], np.int64) for i in (0, -1))
    ia, ib = np.searchsorted(chars, a), np.searchsorted(chars, b)
    out, sums = [lasts[ia] << _BITS | firsts[ib]], [n]
    times = np.bincount(ia, n, minlength=len(chars))
    inner = [(key(x, y), times[i]) for i, s in enumerate(strings) if len(s) > 1 for x, y in zip(s, s[1:], strict=False)]
    out.append(np.array([k for k, _ in inner], np.int64))
    sums.append(np.array([t for _, t in inner], float))
    k, n = total(np.concatenate(out), np.concatenate(sums))
    high = (k >> _BITS > 127) | (k & _MASK > 127)
    return k[high], n[high]


class Bigrams:
    """Counts of bigrams, 16 bytes each, and their sums by first character, kinds and kind of the first character."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, kind: Callable[[str], str], plain: tuple[np.ndarray, np.ndarray] | None = None):
        """`plain` has the counts of all ASCII characters, where those before another count too."""
        self.keys, self.n = array("q", keys.astype(np.int64).tobytes()), array("d", n.astype(float).tobytes())
        a, b = keys >> _BITS, keys & _MASK
        chars = np.unique(np.concatenate([a, b]))
        kinds = [kind(chr(o)) for o in chars]
        names = sorted(set(kinds))
        of = np.array([names.index(x) for x in kinds], np.int64)
        ia, ib = np.searchsorted(chars, a), np.searchsorted(chars, b)
        times = np.bincount(ia, n, minlength=len(chars))
        self.firsts = {chr(o): t for o, t in zip(chars.tolist(), times.tolist(), strict=True) if t and (plain is None or o > 127)}
        if plain is not None:
            self.firsts |= {chr(o): t for o, t in zip((plain[0] >> _BITS).tolist(), plain[1].tolist(), strict=True)}
        both = np.bincount(of[ia] * len(names) + of[ib], n, minlength=len(names) ** 2) if len(keys) else np.zeros(0)
        self.kinds = {(names[i // len(names)], names[i % len(names)]): t for i, t in enumerate(both.tolist()) if t}
        self.kind_firsts: dict[str, float] = {}
        for c, t in self.firsts.items():
            self.kind_firsts[kind(c)] = self.kind_firsts.get(kind(c), 0.0) + t

    def get(self, k: int) -> float:
        i = bisect_left(self.keys, k)
        return self.n[i] if i < len(self.keys) and self.keys[i] == k else 0.0

"""Exact byte-level BPE in linear time, by backtracking over longest matches.

An Aho-Corasick automaton over the bytes of all tokens gives the longest token that begins at each position of a
piece. The encoder takes it greedily and steps back to shorter prefixes, or over the token before, wherever two
neighbours do not fit together; a position from which no end can be reached is marked and never tried again. Two
tokens fit together if plain merging of their joined bytes gives just these two; the answers are kept in a table.
A sequence whose neighbours all fit is the one that plain merging gives, so the result is exact.

Decoding reads the bytes of all tokens from one block by a table of offsets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The pieces of a text; the white space of the vocabulary's own splitter has no U+001C to U+001F.
_WS = r"\t-\r \x85\xA0     -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Pieces whose ids a worker remembers before it starts anew.
REMEMBERED = 1 << 18


class Encoder:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.rank, self.split = rank, regex.compile(PIECES)
        self.text = {n: t for t, n in rank.items()}
        size = max(self.text) + 1
        self.matcher = ahocorasick.Automaton()
        for token, n in rank.items():
            self.matcher.add_word(token, n)
        self.matcher.make_automaton()
        #: the longest token that is a proper prefix of each token
        self.shorter: list[int | None] = [None] * size
        self.size = [0] * size
        for token, n in rank.items():
            self.size[n] = len(token)
            self.shorter[n] = next((rank[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in rank), None)
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        spans = [self.text.get(n, "").encode("latin-1") for n in range(size)]
        self.block, self.offsets = b"".join(spans), np.cumsum([0, *map(len, spans)])

    def merge(self, word: str) -> list[int]:
        """Plain merging, lowest rank first; only for the few bytes of two tokens."""
        parts = list(word)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        if (known := self.fits.get((a, b))) is None:
            known = self.fits[a, b] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return known

    def piece(self, word: str) -> tuple[int, ...]:
        """Ids of one piece, given as one character for each byte."""
        if (n := self.rank.get(word)) is not None:
            return (n,)
        longest = [0] * len(word)
        size = [0] * len(word)
        for end, n in self.matcher.iter(word):
            k = self.size[n]
            if k > size[at := end + 1 - k]:
                size[at], longest[at] = k, n
        out: list[int] = []
        at, token, dead = 0, longest[0], bytearray(len(word) + 1)
        while True:
            end = at + self.size[token]
            if not dead[end] and (not out or self.fit(out[-1], token)):
                out.append(token)
                if (at := end) == len(word):
                    return tuple(out)
                token = longest[at]
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.size[token]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in self.split.findall(text):
            if (ids := known.get(p)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                    self.fits.clear()
                ids = self.piece(p.encode().decode("latin-1"))
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        o, b = self.offsets, self.block
        return b"".join([b[o[i] : o[i + 1]] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _sent(spark: SparkSession, path: str) -> str:
    """Send the vocabulary to all workers, once for each application; the name under which they find it."""
    sent = spark.sparkContext.__dict__.setdefault("_feedloom_files", set())
    if (key := (spark.sparkContext.applicationId, path)) not in sent:
        spark.sparkContext.addFile(path)
        sent.add(key)
    return path.rstrip("/").rpartition("/")[2]


def encode_column(df: DataFrame, text: str, out: str, path: str, count_only: bool = False) -> DataFrame:
    """Add `out`: the ids of `text` as ARRAY<INT>, or their number as BIGINT.

    Null and empty texts have an empty list (0). All text is ordinary text, strings of special tokens too; white
    space and all characters are kept. Each text is encoded whole in one Arrow batch; nothing is shuffled, and rows
    and other columns pass through. `out` must be a new name.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType() if count_only else T.ArrayType(T.IntegerType()))])

    name = _sent(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for batch in batches:
            ids: list[int] = []
            ends = [0]
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                if t:
                    ids += e.encode(t)
                ends.append(len(ids))
            if count_only:
                column = pa.array(np.diff(ends), pa.int64())
            else:
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str, out: str, path: str) -> DataFrame:
    """Add `out`: the text of the list `ids`; an empty or null list gives the empty text."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    name = _sent(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for batch in batches:
            column = [e.decode(x) if x else "" for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)

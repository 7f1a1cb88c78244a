"""Markup over tables: kinds of each field, clean text, and the runs of a host's pages that no other page has."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm import markup
from feedloom.llm.site_lines import digest
from feedloom.session import cut, fresh


def with_markup(df: DataFrame, text: str, out: str, convert: bool = True) -> DataFrame:
    """Add `out` STRUCT<kinds ARRAY<STRING>, clean STRING>; null texts have no kinds and a null clean text.

    With `convert` off only the kinds are told and `clean` is null.

    Texts without any sign of markup come back as they are. Nothing is shuffled; rows and columns pass through.
    """
    field = T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())])
    schema = T.StructType([*df.schema.fields, T.StructField(out, field)])
    kind = pa.struct([("kinds", pa.list_(pa.string())), ("clean", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            kinds = [markup.kinds(t) for t in texts]
            found = pa.array([{"kinds": sorted(k), "clean": markup.clean(t, k) if convert else None} for t, k in zip(texts, kinds, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=schema.names)

    return df.mapInArrow(run, schema)


#: Tokens of the shortest repeated substring that counts, and the distinct pages of a host it must stand in.
RUN, PAGES = 12, 5
#: Repeated runs up to this number are sent to all tasks, 8 bytes each; they are counted first.
BROADCAST = 1 << 21

#: Characters of scripts that are written without blanks, each a token of its own.
_UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: A token is what stands between white space, and each Han or Kana character.
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+", re.A)


class _Hashes(dict):
    """The hash of each token, remembered."""

    def __missing__(self, t: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[t] = xxhash.xxh64_intdigest(t.strip())
        return h


class _Runs:
    """Hashes of the runs of RUN tokens of texts, mixed with that of their host; one for each worker."""

    def __init__(self):
        self.known = _Hashes()

    def of(self, texts: list[str | None], hosts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all runs of all texts in order, and where those of each text begin and end."""
        counts = np.zeros(len(texts) + 1, np.int64)
        tokens: list[int] = []
        for i, t in enumerate(texts):
            tokens += map(self.known.__getitem__, _TOKEN.findall(t)) if t else ()
            counts[i + 1] = len(tokens)
        h = np.array(tokens, np.uint64)
        total = np.zeros(max(0, len(h) - RUN + 1), np.uint64)
        for i in range(RUN):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(total)]
        runs = np.maximum(np.diff(counts) - RUN + 1, 0)
        ends = np.concatenate([[0], np.cumsum(runs)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], runs) + np.repeat(counts[:-1], runs)
        mixed = (total[at] ^ np.repeat(np.array(hosts, np.int64).view(np.uint64), runs)) * np.uint64(0xD6E8FEB86659FD93)
        return mixed.view(np.int64), ends


def _with_runs(df: DataFrame) -> DataFrame:
    """(k, h, page, runs) of (k, h, page, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Runs()
        for b in batches:
            values, ends = hasher.of(b.column(3).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["k", "h", "page", "runs"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, f"k {kinds['k']}, h bigint, page {kinds['page']}, runs array<bigint>")


def _uncovered(text: str, hits: np.ndarray) -> str:
    """The text without the tokens of these runs, given by their first tokens."""
    spans = [m.start() for m in _TOKEN.finditer(text)]
    gone = np.zeros(len(spans) + 1, np.int64)
    np.add.at(gone, hits, 1)
    np.add.at(gone, hits + RUN, -1)
    covered = np.cumsum(gone)
    return "".join(text[a:b] for a, b, g in zip(spans, [*spans[1:], len(text)], covered, strict=False) if not g).strip()


def unique_runs(df: DataFrame, key: str, host: str, text: str, out: str) -> DataFrame:
    """Add `out`: the text without the token runs that stand in at least PAGES distinct pages of its host.

    This gives just what a suffix array over the host's concatenated pages gives: a token is covered by a repeated
    substring of at least RUN tokens if and only if one of the runs of RUN tokens over it is repeated; but runs are
    hashed and counted in parallel, with partial sums, where a suffix array needs a host in one place. Copies of a
    page count once. Null texts stay null; `key` must be unique.

    The texts are written once, so that what made them is not done again. Up to BROADCAST repeated runs go to all tasks
    and no text is exchanged; beyond that the places of runs meet the repeated ones by a join.
    """
    spark = df.sparkSession
    h, page = fresh("__h", df.columns), fresh("__page", df.columns)
    x = cut(df.withColumns({h: F.xxhash64(F.coalesce(F.col(f"`{host}`"), F.lit(""))), page: digest(F.col(f"`{text}`"))}))
    rows = x.select(F.col(f"`{key}`").alias("k"), F.col(h).alias("h"), F.col(page).alias("page"), F.col(f"`{text}`").alias("t"))
    runs = _with_runs(rows)
    pages = runs.where("size(runs) > 0").groupBy("h", "page").agg(F.any_value("runs").alias("r"))
    common = cut(pages.select(F.explode(F.array_distinct("r")).alias("run")).groupBy("run").count().where(F.col("count") >= PAGES).select("run"))
    by_join, known = common.count() > BROADCAST, None
    if by_join:
        places = runs.select("k", F.posexplode("runs").alias("at", "run")).join(common, "run", "left_semi")
        covered = places.groupBy("k").agg(F.collect_list("at").alias("__at"))  # at most one for each token of a text
        x = x.join(covered, x[key] == covered["k"], "left").drop("k")
    else:
        x = x.withColumn("__at", F.lit(None).cast("array<int>"))
        known = spark.sparkContext.broadcast(np.sort(np.array([r["run"] for r in common.collect()], np.int64)))  # counted above
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    names = df.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Runs()
        for b in batches:
            texts, new = b.column(b.schema.get_field_index(text)).to_pylist(), []
            if by_join:
                hits = [np.array(a or (), np.int64) for a in b.column(b.schema.get_field_index("__at")).to_pylist()]
            else:
                values, ends = hasher.of(texts, b.column(b.schema.get_field_index(h)).to_pylist())
                at = np.searchsorted(known.value, values)
                found = np.zeros(len(values), bool) if not len(known.value) else known.value[np.minimum(at, len(known.value) - 1)] == values
                hits = [np.flatnonzero(found[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            new = [_uncovered(t, a) if t is not None and len(a) else t for t, a in zip(texts, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(new, pa.string())], names=schema.names)

    return x.mapInArrow(finish, schema)

"""Page furniture and template residue over tables: lines are counted by host, then each record is read by itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from feedloom.llm import pages, residue
from feedloom.llm.site_lines import with_repeated

#: A line recurs in a host if it stands in so many rows, in that share of all and in so many distinct texts.
RECURRENT = {"min_rows": 5, "min_share": 0.02, "min_clusters": 5}


def with_residue(df: DataFrame, host: str, text: str, date: str, out: str, limits: dict | None = None) -> DataFrame:
    """Add `out` ARRAY<STRING>: the kinds of template residue and error text in a record; empty if it is an article.

    Null, empty and blank texts have none. All rows and columns pass through; a null host is a host of its own.
    """
    x = with_repeated(df, host, text, date, "__recurrent", **(limits or RECURRENT))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, numbers = b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index("__recurrent")).to_pylist()
            found = pa.array([sorted(residue.kinds(t, n)) for t, n in zip(texts, numbers, strict=True)], pa.list_(pa.string()))
            own = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "__recurrent"]
            yield pa.RecordBatch.from_arrays([*own, found], names=schema.names)

    return x.select(*[f"`{c}`" for c in df.columns], "__recurrent").mapInArrow(run, schema)


def with_main(df: DataFrame, host: str, text: str, date: str, out: str, limits: dict | None = None) -> DataFrame:
    """Add `out` STRUCT<residue BOOLEAN, furniture ARRAY<BIGINT>, main STRING>.

    `furniture` has the numbers from 1 of the visible lines that are not part of the article, `main` the article's
    own lines. A record that is template residue has neither. Null texts give a null main.
    """
    x = with_repeated(df, host, text, date, "__recurrent", **(limits or RECURRENT))
    kind = pa.struct([("residue", pa.bool_()), ("furniture", pa.list_(pa.int64())), ("main", pa.string())])
    field = T.StructType([T.StructField("residue", T.BooleanType()), T.StructField("furniture", T.ArrayType(T.LongType())), T.StructField("main", T.StringType())])
    schema = T.StructType([*df.schema.fields, T.StructField(out, field)])

    def one(t: str | None, recurrent: list[int]) -> dict:
        if residue.kinds(t, recurrent):
            return {"residue": True, "furniture": [], "main": ""}
        keep, drop = pages.split(t, recurrent)
        return {"residue": False, "furniture": drop, "main": pages.main_lines(t, keep) if drop else t}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, numbers = b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index("__recurrent")).to_pylist()
            found = pa.array([one(t, n) for t, n in zip(texts, numbers, strict=True)], kind)
            own = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "__recurrent"]
            yield pa.RecordBatch.from_arrays([*own, found], names=schema.names)

    return x.select(*[f"`{c}`" for c in df.columns], "__recurrent").mapInArrow(run, schema)

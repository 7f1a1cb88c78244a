"""Messages delivered at least once: keep exactly one copy of each.

Only the identifier, the delivery number and the place of the row in its file are shuffled. The winner of each
identifier is a minimum, so it is aggregated on the map side and a hot identifier costs one row per task. All
other rows become deletion vectors, one for each slice of a file; the wide payload is then read file by file
and row group by row group, with the deleted positions left out, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from feedloom.session import cut, strip_space

#: Rows of a file that share one deletion vector; bounds the size of each.
SLICE = 1 << 16


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, scope, ident, file, pos): the narrow columns of each row; ident is null where a row has none.

    The identifier is `guid`, or `link` where guid is null or blank, without white space at its ends. A null
    feed is a scope of its own. A row with neither is a message of its own.
    """
    guid, link = strip_space(F.col("guid")), strip_space(F.col("link"))
    return spark.read.parquet(path).select(
        "entry_id",
        F.coalesce("feed", F.lit("\x00")).alias("scope"),
        F.coalesce(F.nullif(guid, F.lit("")), F.nullif(link, F.lit(""))).alias("ident"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("pos"),
    )


def message_key(df: DataFrame) -> DataFrame:
    """Replace (scope, ident) by a 128-bit key, so that long identifiers are not shuffled."""
    both = F.concat_ws("\x01", "scope", "ident")
    return df.where(F.col("ident").isNotNull()).withColumn("key", F.struct(F.xxhash64(both).alias("a"), F.xxhash64(F.reverse(both), F.length(both)).alias("b"))).drop("scope", "ident")


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(key, first STRUCT<entry_id, file, pos>, copies) of each message that was delivered more than once.

    Ties in the delivery number are broken by the place of the row.
    """
    narrow = message_key(positions(spark, path))
    return narrow.groupBy("key").agg(F.min(F.struct("entry_id", "file", "pos")).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def copies(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, key, first, copies, file, pos) of each row of such a message, the winner included."""
    return message_key(positions(spark, path)).join(groups(spark, path), "key")


def losers(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, key, first, copies, file, pos) of each row that is deleted: the copies of a message but its winner."""
    return copies(spark, path).where("NOT (file = first.file AND pos = first.pos)")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id_a, entry_id_b), a < b: each pair of copies of one message.

    Each deleted row with its winner, and the deleted rows of one message with each other, which only messages of three
    copies and more have. The expansion is what the result asks for; it is an equi-join on the key, so that a hot
    message is split over tasks by the skew join of adaptive execution instead of being collected.
    """
    gone = cut(losers(spark, path).select("entry_id", "key", "first", "copies"))  # narrow and few; it is read twice
    won = gone.select(F.least("entry_id", "first.entry_id").alias("entry_id_a"), F.greatest("entry_id", "first.entry_id").alias("entry_id_b")).where("entry_id_a < entry_id_b")
    c = gone.where("copies > 2").select("key", "entry_id")
    a, b = c.withColumnRenamed("entry_id", "entry_id_a"), c.withColumnRenamed("entry_id", "entry_id_b")
    return won.unionAll(a.join(b, "key").where("entry_id_a < entry_id_b").select("entry_id_a", "entry_id_b"))


def deletion_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, slice, rows ARRAY<INT>): the rows to leave out; a slice has SLICE rows at most."""
    return losers(spark, path).groupBy("file", F.expr(f"pos div {SLICE}").alias("slice")).agg(F.collect_list(F.expr(f"cast(pos % {SLICE} AS INT)")).alias("rows"))


def _locate(uri: str):
    """The file system and path of a file as the scan names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def _row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        out: dict[str, list] = {"file": [], "group": [], "first": [], "size": []}
        for uri in batch.column("file").to_pylist():
            store, where = _locate(uri)
            meta, first = pq.read_metadata(where, filesystem=store), 0
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                for k, v in zip(out, (uri, g, first, n), strict=True):
                    out[k].append(v)
                first += n
        yield pa.RecordBatch.from_pydict(out, pa.schema({"file": pa.string(), "group": pa.int32(), "first": pa.int64(), "size": pa.int64()}))


def keep_one(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The table at `path`, all columns or those given, with one row of each message: the one delivered first.

    Rows without any identifier are all kept; an empty table gives an empty one; extra columns pass through.
    The footers are read by the executors, and of the row groups only the columns asked for. Columns of a table come from
    its files, not from folder names. Files are opened by pyarrow with what the environment of the executors gives it for
    access; for a store that only Hadoop can open use `keep_one_anywhere`.
    """
    wide = spark.read.parquet(path)
    wide = wide.select(*[f"`{c}`" for c in columns]) if columns else wide
    schema, arrow = wide.schema, to_arrow_schema(wide.schema)
    listed = wide.select(F.col("_metadata.file_path").alias("file")).distinct()  # the scan reads no column for it
    chunks = listed.mapInArrow(_row_groups, "file string, group int, first bigint, size bigint")
    part = chunks.select("*", F.explode(F.sequence(F.expr(f"first div {SLICE}"), F.expr(f"greatest(first, first + size - 1) div {SLICE}"))).alias("slice"))
    gone = part.join(deletion_vectors(spark, path), ["file", "slice"], "left")
    # a row group has a bounded number of rows, hence a bounded number of slices
    todo = gone.groupBy("file", "group", "first").agg(F.collect_list(F.struct("slice", "rows")).alias("gone")).repartition(F.col("file"), F.col("group"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.parquet as pq

        for batch in batches:
            for row in batch.to_pylist():
                store, where = _locate(row["file"])
                drop = {g["slice"] * SLICE + r for g in row["gone"] for r in g["rows"] or ()}
                drop = np.fromiter(drop, dtype=np.int64, count=len(drop))
                at = row["first"]
                with store.open_input_file(where) as source:
                    for got in pq.ParquetFile(source).iter_batches(batch_size=4096, row_groups=[row["group"]], columns=arrow.names):
                        mask = np.ones(got.num_rows, dtype=bool)
                        mask[drop[(drop >= at) & (drop < at + got.num_rows)] - at] = False
                        at += got.num_rows
                        table = pa.Table.from_batches([got]).filter(pa.array(mask)).select(arrow.names).cast(arrow)
                        yield from table.to_batches()

    return todo.mapInArrow(read, schema)


def keep_one_anywhere(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """As `keep_one`, read by Spark's own scan, for any file system that Hadoop knows.

    The deleted positions are an anti-join on file and row. They are few beside the table, so that adaptive execution
    sends them to all tasks where they are small; where they are not, the payload is exchanged, which `keep_one` avoids.
    """
    wide = spark.read.parquet(path)
    names = columns or wide.columns
    x = wide.select(*[f"`{c}`" for c in names], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos"))
    gone = losers(spark, path).select(F.col("file").alias("__file"), F.col("pos").alias("__pos"))
    return x.join(gone, ["__file", "__pos"], "left_anti").select(*[f"`{c}`" for c in names])

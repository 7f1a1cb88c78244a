"""Streams of entries into the store, and the poll for feeds that are due.

The store is a row of parts. Each batch adds one part with what the store lacks; a part counts when it has the marker of
a finished write, and the parts of later batches never change it. So a batch that is run again finds its part done, or
does it anew from the parts before it; what it read is never what it writes. `compact` folds the parts into one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from feedloom.operators import store


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm.org.apache.hadoop.fs.Path, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def parts(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(first, last) batch of each finished part in order; a folded part stands for all between its ends."""
    where, path, fs = _folder(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(where(s.getPath(), "_SUCCESS"))]
    done = sorted(tuple(map(int, n[2:].split("-"))) for n in names if n.startswith("v="))
    done = [(d[0], d[-1]) for d in done]
    return [d for d in done if not any(o != d and o[0] <= d[0] and d[1] <= o[1] for o in done)]


def _name(root: str, part: tuple[int, int]) -> str:
    return f"{root}/v={part[0]}" if part[0] == part[1] else f"{root}/v={part[0]}-{part[1]}"


def _read(spark: SparkSession, root: str, done: list[tuple[int, int]]) -> DataFrame | None:
    frames = [spark.read.parquet(_name(root, d)) for d in done]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """All finished parts of the store, None if there is none."""
    return _read(spark, root, parts(spark, root))


def insert_new(root: str, order: str, key: str = "link") -> Callable[[DataFrame, int], None]:
    """The work of a batch: insert what the parts of the batches before it lack; the part has the batch's number.

    Run again after it is done it does nothing. Run again after it was cut off, it overwrites its own unfinished part,
    which nobody reads, from parts that are finished and not written to.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = parts(spark, root)
        if any(first <= number <= last for first, last in done):
            return
        have = _read(spark, root, [d for d in done if d[1] < number])
        new = store.first_wins(batch, order, key) if have is None else store.inserted(have, batch, order, key)
        new.write.mode("overwrite").parquet(_name(root, (number, number)))

    return work


def compact(spark: SparkSession, root: str) -> None:
    """Fold all finished parts into one. The folded part counts once it is finished; then the others go."""
    done = parts(spark, root)
    if len(done) < 2:
        return
    whole = (done[0][0], done[-1][1])
    _read(spark, root, done).write.mode("overwrite").parquet(_name(root, whole))
    where, _, fs = _folder(spark, root)
    for d in done:
        fs.delete(where(_name(root, d)), True)


def ingest(stream: DataFrame, root: str, checkpoint: str, order: str, key: str = "link") -> DataStreamWriter:
    """A stream of entries into the store; start it with any trigger."""
    return stream.writeStream.foreachBatch(insert_new(root, order, key)).option("checkpointLocation", checkpoint)


def first_seen(stream: DataFrame, key: str = "link", time: str = "created", late: str = "1 day") -> DataFrame:
    """T2 without a store: the first event of each key, state kept for events up to `late` behind."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def due(feeds: DataFrame, now: Column) -> DataFrame:
    """Feeds to fetch now."""
    return store.timeout_feeds(feeds, now).select("link", "ttl")

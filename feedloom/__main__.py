"""Command lines over files: python -m feedloom COMMAND --uri PATH [--out FOLDER].

PATH may be a folder or a pattern on any file system that the session knows. Without --out rows are printed as JSON.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import rules
from feedloom.plans import pipelines
from feedloom.session import ship
from feedloom.sources import feeds, fetched


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(uri, status, content_type, content_encoding, body) of files, as a fetcher would have them."""
    none = F.lit(None).cast("string")
    packed = F.when(F.col("path").endswith(".gz"), "gzip")
    return fetched.binary_files(spark, path).select(F.col("path").alias("uri"), F.lit(200).alias("status"), none.alias("content_type"), packed.alias("content_encoding"), F.col("content").alias("body"))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).select("uri", F.col("body").alias("xml"))


COMMANDS = {
    "extract": lambda s, p: pipelines.extract(_files(s, p), document=True),
    "decode": lambda s, p: fetched.pages(_files(s, p)),
    "entries": lambda s, p: feeds.with_summary(feeds.to_entries(feeds.read_feeds(_payloads(s, p)), F.current_timestamp())),
    "subscribe": lambda s, p: feeds.to_feeds(feeds.read_feeds(_payloads(s, p)), F.current_timestamp()),
    "opml": lambda s, p: feeds.read_opml(_payloads(s, p), F.current_timestamp(), keep_category=True),
    "images": lambda s, p: fetched.probe_images(fetched.binary_files(s, p)),
    "rules": lambda s, p: rules.load(fetched.rule_lines(s, p)),
}


def main(argv: list[str] | None = None) -> None:
    arguments = argparse.ArgumentParser(prog="feedloom")
    arguments.add_argument("command", choices=sorted(COMMANDS))
    arguments.add_argument("--uri", required=True)
    arguments.add_argument("--out")
    got = arguments.parse_args(argv)
    spark = ship(SparkSession.builder.getOrCreate())
    df = COMMANDS[got.command](spark, got.uri)
    if got.out:
        df.write.mode("errorifexists").parquet(got.out)
    else:
        for row in df.select(F.to_json(F.struct(*df.columns)).alias("json")).toLocalIterator():
            print(row["json"])


if __name__ == "__main__":
    main()

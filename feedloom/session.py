"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "feedloom", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_feedloom_shipped", None) != sc.applicationId:
        here = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="feedloom-")) / "feedloom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f"feedloom/{f.relative_to(here)}")
        sc.addPyFile(str(path))  # the driver serves it to all workers
        sc._feedloom_shipped = sc.applicationId
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan for costly Python work: over all cores if the scan has fewer splits than there are cores.

    A scan with so few splits is small, so the exchange is too; a larger one is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where that setting is empty and the master is local, a temporary folder is set.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = os.path.join(tempfile.gettempdir(), "feedloom-checkpoints")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that does not clash with those taken."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = "_" + name
    return name


#: White space of any kind: the Unicode property White_Space and the ASCII separators.
SPACE = r"[\x09-\x0D\x1C-\x20\x85   -     　]"


def strip_space(c):
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")

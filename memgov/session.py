"""Session settings and the shared scratch folder.

Executors and the driver meet in spark.checkpoint.dir only. Local sessions, where all run in one process
tree, get a folder of their own if it is unset; on a cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_MADE: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect. On a cluster leave both arguments out."""
    builder = (
        SparkSession.builder.appName("memgov")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="memgov-")
    return _LOCAL_SCRATCH[app]


def new_scratch(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/memgov-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_shuffles_go(spark: SparkSession) -> None:
    """Shuffle files go once nothing in the driver refers to them, which it finds out in a collection only.

    A driver with much free memory rarely collects, so the files of every finished step of a stream pile up.
    """
    spark._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Remove the folders made so far, once nothing that reads them is needed any more."""
    while _MADE:
        remove_folder(spark, _MADE.pop())


@contextmanager
def short_lived(spark: SparkSession):
    """Folders made inside are removed at the end, but for tables written by the function it gives.

    What leaves the block may read those tables and what was there before, nothing else made inside.
    """
    before, kept = set(_MADE), []

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = new_scratch(spark, label)
        kept.append(path)
        df.write.mode("error").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    yield keep
    for folder in [f for f in _MADE if f not in before and f not in kept]:
        remove_folder(spark, folder)
        _MADE.remove(folder)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later rounds do not recompute it."""
    path = new_scratch(df.sparkSession, label)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

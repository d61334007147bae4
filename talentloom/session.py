"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_folder: list[str] = []
_scratch: list[str] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("talentloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites cost a call per Column
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``.

    Only where that is unset (a single machine) a temporary folder takes its place; a session
    with a cluster master and no such folder is an error, since executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="talentloom-"))
    return _local_folder[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; each call gives a new one, which :func:`drop_scratch` removes."""
    _scratch.append(os.path.join(shared_folder(spark), "talentloom", f"{name}-{uuid.uuid4().hex}"))
    return _scratch[-1]


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: computed once, and safe from lost executors.

    ``schema`` may name types that have the same form on disk, such as vectors for their structs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Remove what this process has put into the scratch folder; for when results are written. Gives the number of paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone

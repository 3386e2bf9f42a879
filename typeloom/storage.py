"""Tables in the folder that driver and executors share: they cut a lineage, and lost executors do not lose them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: the shuffle files of an execution go when it ends, as all that they made is in the table by
#: then, and batches sent to Python are small. Neither changes a result.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all tasks run in the driver (tests)
    may it be unset; it is a temporary folder then."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='typeloom-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    held = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder in the shared one for the tables of one call, deleted at its end: what the call returns must not read them."""
    path = fresh_path(spark, name)
    try:
        yield path
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Written as Parquet in the shared folder (or a folder of its own there) and read back: it cuts the lineage, its size
    on disk is known to the planner, and the shuffle files that made it can go."""
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else fresh_path(spark, name)
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

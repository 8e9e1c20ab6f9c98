"""Session helpers: local test sessions and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spoorgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.files.openCostInBytes", "262144")  # small test files still use every core
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spoorgrid-ckpt-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`. Only a session whose executors are threads of this
    process may do without one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spoorgrid-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def file_system(path: str):
    """The file system of a path, any that both Spark and Arrow know, and the path there."""
    from pyarrow import fs

    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri)


def cut(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage, so iterative jobs neither replan nor lose work with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Written once as a table and read from it by columns, for large rows that several steps use."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 500_000  # rows that a join or an aggregate sorts or holds in one task


def dealt(df: DataFrame, rows: int, *columns) -> DataFrame:
    """`df`, of about so many rows, by the columns in partitions of about ROWS_A_TASK rows, where the session's number of shuffle partitions
    would make larger ones: a task then needs no more memory as tables grow."""
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, *columns) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df

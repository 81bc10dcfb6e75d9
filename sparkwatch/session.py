"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkwatch")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Clock arithmetic in this package is done in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names.

    Only a local session without one (a test) gets a temporary folder: on a cluster its executors could not see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        context.setCheckpointDir(configured or _temporary(context.applicationId))
    return context.getCheckpointDir()


@lru_cache(maxsize=4)
def _temporary(application: str) -> str:
    return tempfile.mkdtemp(prefix="sparkwatch-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a step of an iteration, so that its plan stays short and lost executors cost no replay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of the largest rows that a row group of wide rows holds.
_GROUP = 16 << 20


def stored(df: DataFrame, row_bytes: int | None = None) -> DataFrame:
    """Write a frame that several steps read to the shared folder, as Parquet, and read it back.

    Unlike a cached frame it survives lost executors, and unlike a checkpoint later steps read only
    the columns they use and know its size.

    Parquet is written and read thousands of rows at a time, however wide they are. ``row_bytes``, what a row may take at most, keeps
    row groups of wide rows small; no batch reaches over the end of one.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write
    if row_bytes is not None:
        writer = writer.option("parquet.block.row.count.limit", max(1, _GROUP // row_bytes))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once nothing reads it any more."""
    session = df.sparkSession
    folder = shared_folder(session).rstrip("/")
    tables = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    for table in tables:
        if table.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/") + "/"):
            path = session._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

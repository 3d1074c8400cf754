"""Session defaults and the shared folder for tables that cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvine")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what ``spark.checkpoint.dir`` names. Only on a single machine (a local master)
    a temporary folder is made and set where that is unset; a cluster's executors
    wouldn't see each other's files there, so it must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvine-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/corvine-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: How intermediate tables are written. Without Hadoop's native library a file system of
#: scheme file starts a process to set permissions, several a file with checksum files
#: beside the data, and each start holds a second image of the JVM for a moment. These
#: tables are read back in the same run, so they need neither checksum files nor a marker
#: of success; other schemes are as they were.
INTERMEDIATE = {
    "compression": "zstd",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def materialize(df: DataFrame, name: str = "table", batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a reread, not a recomputation, and
    gives the planner the table's true size: a join then broadcasts the table only
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    ``batch_rows`` bounds the Arrow batches of this write's Python stages: rows with
    whole texts are large, and a batch is held in the JVM and in Python.
    """
    spark = df.sparkSession
    path, key = shared_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.options(**INTERMEDIATE).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """The size of the files of a materialized table."""
    spark, total = df.sparkSession, 0
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        total += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return total


def small_side(df: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """A materialized table as one side of a join: broadcast if its files take at most
    ``limit`` bytes, or else left to a shuffled join."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

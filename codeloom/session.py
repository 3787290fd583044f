"""Sessions that know where this library's code is, how large a Python batch may be, and where tables can be kept."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of one batch that goes to a Python worker, in place of Spark's default: texts may be long, and workers share an executor's memory.
BATCH_BYTES = "8m"
BATCH_CONF, SPARKS_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "64m", "67108864", "67108864b")


def share_code(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the library, wherever the driver was started. On a cluster the
    package is installed or sent with --py-files. Batches for Python are made smaller, unless the user has set their size."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get(BATCH_CONF, None) in SPARKS_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and the master is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dealt(files: DataFrame, keys: list[str]) -> DataFrame:
    """files dealt out by their keys, for work that makes many rows of each: a small table of files is otherwise read by one or two tasks."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_merge(df: DataFrame) -> DataFrame:
    """df for joins that meet by sorting. Spark takes the compressed bytes of a file for the size of what is made of it; rows of tokens and nodes have
    fifty times as many, and as a broadcast they would fill the driver."""
    return df.hint("merge")


#: Rows that one task sorts or counts at a time, about; a table with more is dealt to more tasks.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt out once by its owners' keys: what groups or orders rows within an owner needs no other shuffle, and a task's
    share of a larger table is no larger."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys)


def settle(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of finished queries: it does so only for what the driver's garbage collector
    has found, and its own timer for that is half an hour."""
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again, and what is left of finished queries."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._kept_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        settle(tables[0].sparkSession)

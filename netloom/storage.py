"""Where intermediate tables live.

Tables that cut lineage go to the folder named by ``spark.checkpoint.dir``,
which every executor shares; a private folder is made only where the setting
is absent (tests, notebooks in local mode).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one for local sessions that name none."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="netloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    top = f"{shared_dir(spark)}/netloom-{uuid.uuid4().hex}"
    _made.append(top)
    return f"{top}/{name}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a short
    lineage whose data survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that this process stored; call it when no DataFrame
    made before is needed any more."""
    while _made:
        drop_path(spark, _made.pop())

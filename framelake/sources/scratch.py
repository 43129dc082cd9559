"""Where intermediate tables live: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session. Only a local session without the setting (tests) gets one of its own: executors
    on other machines couldn't see it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        configured = sc.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="framelake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/framelake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends here, and a lost executor
    costs no recomputation beyond this table. by: a column that gets a folder a value, so that a reader of one opens no
    other."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._framelake_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and no later plan reads."""
    path = getattr(df, "_framelake_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)

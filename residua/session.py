"""Settings taken from the running session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, on a local master only, a temporary folder.

    Executors of a cluster do not share the driver's folders, so without the
    setting there is no right place there, and that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.residua.localFolder", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="residua-")
        spark.conf.set("spark.residua.localFolder", found)
    return found


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written once to the shared folder and read from there, with its size in bytes as stored.

    This cuts the lineage without computing twice and outlives executors.  The
    files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/residua-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path), files.getContentSummary(hadoop).getLength()


def checkpointed(df: DataFrame) -> DataFrame:
    """``stored`` without the size."""
    return stored(df)[0]


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than the session has cores, dealt out over the cores.

    For work that costs much more per row than moving the row.  Inputs of many
    files or row groups, that is all large ones, stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df

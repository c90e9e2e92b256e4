"""Tables written into the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the
    session is local, as in tests, a temporary folder is made; elsewhere executors would
    write to disks that others don't see, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def on_disk(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; they go when the application ends,
    or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    files, target = on_disk(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``materialize`` wrote and nothing will read again, as a loop's earlier states."""
    for table in tables:
        path = getattr(table, "_stage_path", None)
        if path:
            files, target = on_disk(table.sparkSession, path)
            files.delete(target, True)

"""Staged tables: cut lineage by writing to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where none is set, a session in one JVM (``local[...]``, as in tests) gets a private folder. On a
    cluster that would leave each executor's files on its own disk, so it raises there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if path is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="clientele-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/clientele/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where one derived table feeds several branches: the branches then see identical values
    (float sums do not depend on shuffle order any more) and a lost executor costs a re-read, not
    a recomputation.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more, such as the state of a finished round."""
    spark = df.sparkSession
    held = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in held:
        if "/clientele/" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and broadcasts of finished jobs now.

    The cleaner acts when the driver collects garbage, which a driver with little to do puts off for many rounds of a loop
    while their files pile up. What is still referred to stays.
    """
    spark._jvm.java.lang.System.gc()

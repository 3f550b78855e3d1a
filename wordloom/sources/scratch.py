"""A folder for what one job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the shared folder of the cluster. Where none is set, a temporary folder serves a single machine, as in tests; a cluster raises."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='wordloom-')}/wordloom-{uuid.uuid4().hex}"


#: Folders that `keep` has written, by application.
KEPT: dict[str, list[str]] = {}


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: what several parts of a plan read is made once, and a lost executor costs no more than its own part.

    The table stays until `forget` is called, as results may read it at any time before.
    """
    path = scratch_folder(df.sparkSession)
    KEPT.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that `keep` has written in this application, but for the first `since`; what was made of them can be read no more. Returns how many there were.

    `len(KEPT.get(spark.sparkContext.applicationId, []))` before a job is what `since` should be, to delete that job's tables once its result is stored.
    """
    paths = KEPT.get(spark.sparkContext.applicationId, [])
    gone = paths[since:]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del paths[since:]
    return len(gone)


def in_parts(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, kept in the shared checkpoint folder, for jobs that go over partitions one after the other."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)

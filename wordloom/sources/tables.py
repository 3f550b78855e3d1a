"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Below so many stored bytes for each core a table is dealt to all cores.
SMALL = 3 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows; those of a small table in as many parts as there are cores.

    A file of one row group is read by one task, however many cores wait. The size is the planner's, known
    without reading rows, and the exchange is of a few MB for each core at most; larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

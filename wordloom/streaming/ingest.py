"""Counts of n-grams of a stream of documents, in versions that a model can be trained from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.counts import class_counts
from wordloom.plans.training import Settings, train_from_counts
from wordloom.sources.scratch import keep


def ingest(docs: DataFrame, key: str, path: str, checkpoint: str, text: str = "text", n_max: int = 3, drop_urls: bool = True) -> StreamingQuery:
    """Starts a query that adds documents to the counts of their classes and ends when the input does.

    The counts that a micro-batch adds are written as a version of its own, numbered as the batch; a batch that is repeated after
    a failure writes the same rows over its version, so that each document counts once. What was counted before is not read
    or written again: these versions are the state, and a state store would hold all n-grams of all time a second time.
    Rows without a class are left out, a null text counts as empty, a repeated row counts again. No row is late.
    """
    def store(batch: DataFrame, number: int) -> None:
        class_counts(batch, key, text, n_max, drop_urls, marks=True).write.mode("overwrite").parquet(f"{path}/changes/version={number}")

    return docs.where(F.col(key).isNotNull()).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, folder: str) -> list[int]:
    """The versions in a folder that are written completely, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def versions(spark: SparkSession, path: str) -> list[int]:
    return stored(spark, f"{path}/changes")


def counts_at(spark: SparkSession, path: str, key: str, version: int | None = None) -> DataFrame:
    """(key, n, term, cnt) as they were after a version, the last one if none is given; rows of n = 0 count documents.

    They are the sums of what each version has added; the last compacted version before stands for all before it.
    """
    known = versions(spark, path)
    version = known[-1] if version is None and known else version
    if version not in known:
        raise ValueError(f"no version {version} in {path}: {known}")
    base = max((v for v in stored(spark, f"{path}/whole") if v <= version), default=-1)
    folders = [f"{path}/changes/version={v}" for v in known if base < v <= version] + ([f"{path}/whole/version={base}"] if base >= 0 else [])
    return spark.read.parquet(*folders).groupBy(key, "n", "term").agg(F.sum("cnt").alias("cnt"))


def compact(spark: SparkSession, path: str, key: str, version: int | None = None) -> int:
    """Writes all counts of a version at one place, so that readers of it and of later ones need no version before. Those before stay readable."""
    version = versions(spark, path)[-1] if version is None else version
    counts_at(spark, path, key, version).write.mode("overwrite").parquet(f"{path}/whole/version={version}")
    return version


def train_at(spark: SparkSession, path: str, key: str, version: int | None = None, settings: Settings = Settings()) -> DataFrame:
    """(term, key, weight) from the counts of a version: the model that `train` makes of all documents up to it. Levels above settings.n_max are left out."""
    counted = keep(counts_at(spark, path, key, version))
    classes = [r[0] for r in counted.where("n = 0").select(key).orderBy(key).limit(10_001).collect()]
    if len(classes) > 10_000:
        raise ValueError("too many classes for a model")
    return train_from_counts(counted.where(F.col("n").between(1, settings.n_max)), classes, key, settings)

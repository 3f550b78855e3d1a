"""Model files: tab-separated text, one row per term and one column per class, or Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.tokens import upper_invariant
from wordloom.operators.weights import dense


@dataclass(frozen=True)
class ModelName:
    """The variant of a model; part of its file name."""

    method: str = "tfidf"
    n_max: int = 3
    cut: str = "d1"

    def path(self, base: str, extension: str = "") -> str:
        return f"{base}-({self.method}-ngram_{self.n_max}-{self.cut}){extension}"


def read_tsv(spark: SparkSession, paths: str | Sequence[str], width: int | None = None) -> DataFrame:
    """(term, class_id, weight) from text files read as one.

    Comment lines, lines of one column and lines of another width than the first row's are skipped; terms are
    trimmed and in upper case. Without a given width, that of the first row in the first file is taken.
    """
    paths = [p for p in paths.split(";") if p.strip()] if isinstance(paths, str) else list(paths)
    lines = spark.read.text([p.strip() for p in paths]).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    rows = (lines.select(F.trim(F.col("line")).alias("line")).where(~F.col("line").startswith("#"))
            .select(F.filter(F.split("line", "\t"), lambda x: x != "").alias("cells")).where(F.size("cells") >= 2))
    if width is None:
        first = spark.read.text(paths[0].strip()).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line"))
        head = first.where(~F.col("line").startswith("#") & F.col("line").contains("\t")).head(1)
        width = len([c for c in head[0]["line"].split("\t") if c]) - 1 if head else 0
    fit = rows.where(F.size("cells") == width + 1)
    weights = F.transform(F.slice("cells", 2, width), lambda x: F.trim(x).cast("float"))
    return fit.select(upper_invariant(F.trim(F.col("cells")[0])).alias("term"), F.posexplode(weights).alias("class_id", "weight"))


def skipped_lines(spark: SparkSession, paths: Sequence[str], width: int) -> int:
    """Lines that read_tsv leaves out for their width."""
    cells = F.size(F.filter(F.split(F.trim("value"), "\t"), lambda x: x != ""))
    return spark.read.text(list(paths)).where(~F.trim("value").startswith("#") & (cells != width + 1)).count()


def check_unique(weights: DataFrame) -> DataFrame:
    """The same rows; reading them fails if a term has two weights in one class."""
    counted = weights.groupBy("term", "class_id").agg(F.min("weight").alias("weight"), F.count(F.lit(1)).alias("_n"))
    failed = F.raise_error(F.concat(F.lit("repeated term: "), "term")).cast("float")
    return counted.select("term", "class_id", F.when(F.col("_n") > 1, failed).otherwise(F.col("weight")).alias("weight"))


def as_lines(weights: DataFrame, class_ids: Sequence[int], key: str = "class_id") -> DataFrame:
    """(value): one line of a model file per term."""
    full = dense(weights, class_ids, key).groupBy("term").agg(F.sort_array(F.collect_list(F.struct(key, "weight"))).alias("cells"))
    return full.select(F.concat_ws("\t", F.col("term"), F.transform("cells", lambda x: x["weight"].cast("string"))).alias("value"))


def write_tsv(weights: DataFrame, path: str, class_names: Sequence[str], rows_per_file: int | None = None, key: str = "class_id") -> None:
    """Writes a folder of text files, split at rows_per_file, and the class names as a comment in a file of their own."""
    spark = weights.sparkSession
    lines = as_lines(weights, range(len(class_names)), key)
    writer = lines.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).text(path)
    header = "#" + "".join(f"\t'{n}'" for n in class_names)
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)


def write_parquet(weights: DataFrame, path: str) -> None:
    """Writes the model in order of terms, so that a reader can skip what it does not need."""
    weights.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_buckets(weights: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> None:
    """Stores a model as a table of the catalog, in buckets by term, one sorted file each.

    Scoring with it moves only the texts' bags, however large the model is: each bucket is read by the task that has
    its terms. `buckets` should not be below spark.sql.shuffle.partitions, which is the default, or Spark moves both sides.
    Without a path, the files lie in the warehouse.
    """
    buckets = buckets or int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = weights.repartition(buckets, "term").write.mode("overwrite").format("parquet").bucketBy(buckets, "term").sortBy("term")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_buckets(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)

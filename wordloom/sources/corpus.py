"""Reading class texts: one whole file is one class, or one row of a table is one document of a class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def parse_class_list(text: str) -> list[str]:
    """Names between semicolons, trimmed, blank ones left out; a name's place is its class id."""
    return [name for part in text.split(";") if (name := part.strip())]


def read_class_files(spark: SparkSession, folder: str, names: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(class_id, class_name, text), one whole file each. A missing or blank file is an error when the rows are read."""
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names])
    name = F.element_at(F.split(F.url_decode(F.col("path")), "/"), -1)
    ids = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n.rsplit("/", 1)[-1], i)])
    out = files.select(ids[name].alias("class_id"), name.alias("class_name"), F.decode("content", encoding).alias("text"))
    blank = F.coalesce(F.trim(F.translate("text", "\r\n\t", "   ")), F.lit("")) == ""
    return out.withColumn("text", F.when(blank, F.raise_error(F.concat(F.lit("blank class text: "), "class_name")).cast("string")).otherwise(F.col("text")))


def scan_directory(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of all matching files below a folder; files that vanish meanwhile are passed over."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True)
             .option("wholetext", True).text(folder))
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def distinct_classes(docs: DataFrame, key: str) -> list:
    """The classes in order; there are few of them, which is checked."""
    found = [r[0] for r in docs.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(10_001).collect()]
    if len(found) > 10_000:
        raise ValueError("too many classes for a model")
    return found


def with_class_id(docs: DataFrame, class_col: str) -> DataFrame:
    """Adds class_id: the place of the class among the different ones in order, from 0. Rows without a class are left out."""
    numbered = docs.sparkSession.createDataFrame([(c, i) for i, c in enumerate(distinct_classes(docs, class_col))],
                                                 StructType([docs.schema[class_col], StructField("class_id", IntegerType(), False)]))
    return docs.join(F.broadcast(numbered), class_col)

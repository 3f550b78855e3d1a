"""Joins by time: rows with the intervals that cover them, and with the version that was valid last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.sources.scratch import in_parts


def covering(rows: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: Sequence[str], width: int) -> DataFrame:
    """Rows with each interval of equal keys that covers them, start <= at < end, and the intervals' other columns.

    Times are cut into bins of `width` (in the columns' unit, whole numbers). An interval goes to each bin that it touches, a row
    to its own, so that both meet by an equal-key join on keys and bin and no pair of bins is tried. Choose `width` near the
    usual length of intervals. Null keys, times or bounds match nothing. Names of the two tables' columns differ but for keys.
    """
    binned = intervals.where(F.col(start) < F.col(end)).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    left = rows.where(F.col(at).isNotNull()).withColumn("_bin", F.floor(F.col(at) / width))
    return left.join(binned, [*keys, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin")


def valid_at(rows: DataFrame, at: str, versions: DataFrame, since: str, keys: Sequence[str]) -> DataFrame:
    """Each row with the columns of the latest version of equal keys whose `since` is not after the row's time; null where there is none.

    Both tables are laid in one order by keys and time and cut into ranges of about equal size, so that a key with many rows
    lies in several. A range carries the last version on from row to row; what it begins with is the last version of the
    ranges before it, of which there is one a range. Of versions with the same time the greatest by its columns holds.
    Rows with a null key or time have no version.
    """
    spark, extra = rows.sparkSession, [c for c in versions.columns if c not in keys]
    version = F.struct(F.col(since), *[F.col(c) for c in extra if c != since])
    one = versions.where(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("_at")).agg(F.max(version).alias("_v"))
    # Of one time, the version comes before the rows.
    asked = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v"))
    given = one.select(*keys, "_at", F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = in_parts(asked.unionByName(given).repartitionByRange(parts, *keys, "_at", "_kind").withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    lasts = ranged.where("_v is not null").groupBy(*keys, "_part").agg(F.max_by("_v", "_at").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = ranged.select(*keys, "_part").distinct().join(lasts, [*keys, "_part"], "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
    found = ranged.withColumn("_own", F.last("_v", ignorenulls=True).over(within)).where("_row is not null")
    joined = found.join(edges.where("_carried is not null").select(*keys, "_part", "_carried"), [*keys, "_part"], "left")
    value = F.coalesce("_own", "_carried")
    return joined.select("_row.*", *[value[c].alias(c) for c in extra])


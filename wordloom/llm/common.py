"""Pieces that several operators share: lineage cuts, gapless ranks, components, pair blocks."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names. Where none is set, one is made on a single machine, as in tests; a cluster raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="wordloom-checkpoint-"))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case: `name`, with underscores in front where needed."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_that_stay(docs: DataFrame, stay: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """One row of docs for each row of stay (_id, _h, _n): the one with that id, null or not, and that digest; _n rows of docs have both.

    Of several such rows the least by its columns stays (columns without an order, such as maps, do not count). They are folded
    where they lie before they are exchanged, so that a row repeated any number of times is no hot key.
    """
    stay = cut(stay)
    ident, h, n = (fresh(f"_wl_{x}", docs) for x in ("id", "h", "n"))
    named = stay.select(F.col("_id").alias(ident), F.col("_h").alias(h), F.col("_n").alias(n))

    def of(part: DataFrame, how: str) -> DataFrame:
        return docs.join(part, docs[id_col].eqNullSafe(F.col(ident)) & (digest == F.col(h)), how)

    once = of(named.where(F.col(n) == 1), "left_semi")
    repeated = stay.where("_n > 1").count()
    if not repeated:
        return once
    row, order = fresh("_wl_row", docs), [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    keys = named.where(F.col(n) > 1)
    several = of(F.broadcast(keys) if repeated <= 100_000 else keys, "inner").select(ident, h, F.struct(*docs.columns).alias(row))
    folded = several.groupBy(ident, h).agg(F.min_by(row, F.struct(*[F.col(row)[c] for c in order])).alias(row))
    return once.unionByName(folded.select(f"{row}.*"))


def gapless_rank(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large the group is.

    Each group is dealt into `buckets` by a hash of the order columns. Counts by bucket give each
    bucket its first number, and only the rows of one bucket are sorted together. Rows that tie on
    the order columns are numbered in any order.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_within", F.row_number().over(within).cast("long"))
    joined = numbered.join(firsts, [*group, "_bucket"])
    return joined.withColumn(name, F.col("_first") + F.col("_within") - 1).drop("_bucket", "_first", "_within")


def pair_blocks(rows: DataFrame, keys: Sequence[str], unit: str, cap: int) -> DataFrame:
    """Deal rows so that any two rows with equal keys meet in exactly one block of at most about 2 * cap rows.

    A bucket of more than cap rows is split into parts by a hash of `unit`; a block is a pair of
    parts (lo <= hi), and a row goes to each block that has its part. Adds part, lo, hi.
    """
    heavy = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
                .select(*keys, F.ceil(F.col("_n") / cap).cast("int").alias("_parts")))
    n_heavy = heavy.count()
    if n_heavy == 0:
        return rows.withColumns({k: F.lit(0) for k in ("part", "lo", "hi")})
    small = F.broadcast(heavy) if n_heavy <= 10_000 else heavy
    return (rows.join(small, list(keys), "left")
            .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64(unit), F.col("_parts")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .withColumns({"lo": F.least("part", "_other"), "hi": F.greatest("part", "_other")})
            .drop("_parts", "_other"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    Returns (node, component) for each node that has an edge to another one; component is the
    smallest node that can be reached. Edges with a null end or equal ends are ignored. A hub's
    edges are only ever aggregated with map-side combining or joined, never gathered.
    """
    def fingerprint(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    was = fingerprint(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = fingerprint(e)
        if now == was:
            break
        was = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())

"""Term counts, n-gram bags and the cut of rare terms by running mass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from wordloom.functions.tokens import joined_words, tokenize, words_in
from wordloom.functions.urls import without_urls
from wordloom.sources.scratch import keep

#: Percent of each n-gram level's mass that is kept, for n = 1 to 4; None keeps all.
CUT_PERCENTS: dict[str, tuple[float, ...] | None] = {"d0": None, "d1": (95, 50, 15, 5), "d2": (50, 15, 5, 2)}


def each(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """A row for each element of an array. The outer form keeps the optimiser from testing first, by making the array once more below, whether it is empty."""
    return rows.select("*", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def each_with_place(rows: DataFrame, array: str) -> DataFrame:
    """The same with the place, as pos and word, in the array's stead."""
    kept = [c for c in rows.columns if c != array]
    return rows.select(*kept, F.posexplode_outer(array).alias("pos", "word")).where(F.col("word").isNotNull())


def token_table(docs: DataFrame, key: str, text: str = "text", drop_urls: bool = True) -> DataFrame:
    """(key, pos, word): the words of each row in order."""
    return each_with_place(docs.select(key, tokenize(F.col(text), drop_urls).alias("_words")), "_words")


def joined_texts(docs: DataFrame, *kept: str, text: str = "text", drop_urls: bool = True) -> DataFrame:
    """(kept, text) with the words of each text in its stead, joined by spaces, in the shared folder: what trains and is scored has its words cut once.

    Counts, bags and models are made of it with `joined`, which drops no URLs, as that is done.
    """
    return keep(docs.select(*kept, joined_words(F.col(text), drop_urls).alias(text)))


#: Stored bytes of joined texts, times the n-grams of each word, that one task counts: some 2,000,000 n-grams, whose counts fit into its memory, so that none are spilled and sorted.
PART_BYTES = 6 << 20


#: The planner's size of what it knows nothing of, as of rows that come from Python.
UNKNOWN_SIZE = (1 << 63) - 1


def parts_of(docs: DataFrame, n_max: int) -> int:
    """In how many parts joined texts are counted, by the planner's size of the stored tables, known without reading rows.

    Sizes are those of the tables read, since the planner takes a join, as with the numbers of classes, for the product of its sides.
    """
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return math.ceil(sum(s for s in sizes if s < UNKNOWN_SIZE) * n_max / PART_BYTES)


def words_column(text: str, drop_urls: bool, joined: bool) -> Column:
    return words_in(F.col(text)) if joined else tokenize(F.col(text), drop_urls)


def document_bags(docs: DataFrame, key: str, text: str = "text", n_max: int = 1, drop_urls: bool = True, joined: bool = False) -> DataFrame:
    """(key, term, cnt): words and n-grams up to n_max of each document in one bag. With `joined`, texts are those of joined_texts.

    Texts are dealt out by document before they are cut, so that the many n-grams made of them are counted where they are
    and exchanged no more: neither here nor where they are joined with a model that is broadcast, or summed by document.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, parts_of(docs, n_max)) if joined else parts
    plain = without_urls(F.col(text)) if drop_urls and not joined else F.col(text)  # before they are dealt: what follows is on the JVM, which keeps the dealing
    words = docs.select(key, plain.alias("_text")).repartition(parts, key).select(key, words_column("_text", False, joined).alias("_words"))  # a column of its own, so that each text is split once
    return grams(words, key, n_max).groupBy(key, "term").agg(F.count(F.lit(1)).alias("cnt"))


def places(words: DataFrame) -> DataFrame:
    """A row for each word, with pos, word and all words of its text; what is made of these is compiled with the loop over them, and no row carries the array on."""
    return words.select("*", F.posexplode_outer("_words").alias("pos", "word")).where(F.col("word").isNotNull())


def following(n: int) -> list[Column]:
    """The n - 1 words after a place; null beyond the end."""
    return [F.get("_words", F.col("pos") + i) for i in range(1, n)]


def grams(words: DataFrame, key: str, n_max: int) -> DataFrame:
    """(key, term): a row for each word and n-gram up to n_max of the texts' words (_words) as it stands."""
    if not 1 <= n_max <= 4:
        raise ValueError("n-grams have 1 to 4 words")
    if n_max == 1:
        return places(words).select(key, F.col("word").alias("term"))
    longer = [F.concat("word", *[x for w in following(n) for x in (F.lit(" "), w)]) for n in range(2, n_max + 1)]  # null beyond the end
    return each(places(words).select(key, F.array("word", *longer).alias("_terms")), F.col("_terms"), "term").select(key, "term")


def class_counts(docs: DataFrame, key: str, text: str = "text", n_max: int = 1, drop_urls: bool = True, marks: bool = False, joined: bool = False) -> DataFrame:
    """(key, n, term, cnt) of each class; n-grams do not cross documents. With `marks`, n = 0 and an empty term count the documents of a class.
    With `joined`, texts are those of joined_texts.

    A term tells its n, so that n is not exchanged with it.
    """
    docs = docs.repartition(parts_of(docs, n_max)) if joined and parts_of(docs, n_max) > docs.sparkSession.sparkContext.defaultParallelism else docs
    rows = grams(docs.select(key, words_column(text, drop_urls, joined).alias("_words")), key, n_max)
    if marks:
        rows = rows.unionByName(docs.select(key, F.lit("").alias("term")))
    size = F.char_length("term") - F.char_length(F.replace("term", F.lit(" "), F.lit(""))) + 1  # no word holds a space
    counted = rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(key, F.when(F.col("term") == "", F.lit(0)).otherwise(size).alias("n"), "term", "cnt")


#: From so many n-grams of two words and more on, counts of 1 are not stored before they are asked for. In smaller tables, cuts do ask for them.
MANY_GRAMS = 20_000_000


def gram_totals(docs: DataFrame, key: str, text: str = "text", n_max: int = 1) -> dict[tuple, int]:
    """How many n-grams of each (class, n) joined texts hold, repeats included; they are told by the numbers of words and not made."""
    sizes = docs.select(key, F.size(words_in(F.col(text))).cast("long").alias("_size"))
    sums = [F.sum(F.greatest(F.col("_size") - (n - 1), F.lit(0).cast("long"))).alias(f"_{n}") for n in range(1, n_max + 1)]
    return {(r[0], n): r[n] for r in sizes.groupBy(key).agg(*sums).collect() for n in range(1, n_max + 1) if r[n]}  # there are few classes


def repeated_counts(counted: DataFrame, key: str, totals: dict[tuple, int]) -> tuple[DataFrame, DataFrame]:
    """Counts without those of 1 for n above 1, stored, and (key, n, cnt, _k), how many were left out: what the totals of all have above the sums of the rest."""
    rest = keep(counted.where((F.col("n") == 1) | (F.col("cnt") > 1)))
    sums = {(r[0], r[1]): r[2] for r in rest.groupBy(key, "n").agg(F.sum("cnt")).collect()}
    left = [(*group, 1, total - sums.get(group, 0)) for group, total in totals.items() if group[1] > 1 and total > sums.get(group, 0)]
    schema = StructType([counted.schema[key], StructField("n", IntegerType()), StructField("cnt", LongType()), StructField("_k", LongType())])
    return rest, counted.sparkSession.createDataFrame(left, schema)


def merge_counts(*tables: DataFrame, key: str) -> DataFrame:
    """Sums of tables of counts, as from separate runs or pre-aggregated input."""
    out = tables[0].select(key, "n", "term", "cnt")
    for t in tables[1:]:
        out = out.unionByName(t.select(key, "n", "term", "cnt"))
    return out.groupBy(key, "n", "term").agg(F.sum("cnt").alias("cnt"))


def class_lengths(docs: DataFrame, key: str, text: str = "text", drop_urls: bool = True) -> DataFrame:
    """(key, length): words of each class before any cut. A class without words has length 0."""
    sizes = docs.select(key, F.size(tokenize(F.col(text), drop_urls)).cast("long").alias("_size"))
    return sizes.groupBy(key).agg(F.sum("_size").alias("length"))


def lengths_of(counts: DataFrame, classes: list, key: str) -> DataFrame:
    """class_lengths from counts of words that are not cut yet, with the classes given."""
    every = counts.sparkSession.createDataFrame([(c,) for c in classes], counts.select(key).schema)
    found = counts.where(F.col("n") == 1).groupBy(key).agg(F.sum("cnt").alias("_length"))
    return every.join(found, key, "left").select(key, F.coalesce("_length", F.lit(0)).cast("long").alias("length"))


def mass_threshold(total: Column, percent: Column | float) -> Column:
    """Single-precision percent of a total."""
    percent = F.lit(percent) if isinstance(percent, int | float) else percent
    return ((total.cast("float") * percent.cast("float")).cast("float") / F.lit(100).cast("float")).cast("float")


def cut_by_mass(counts: DataFrame, key: str, cut: str, singles: DataFrame | None = None) -> DataFrame | None:
    """Keeps, of each class and n, the most frequent terms while their running count is within the level's percent.

    Terms go by count, then in binary order; the first that exceeds the mass goes, with all after it. Whole
    groups of equal counts are decided by a histogram of counts. Only the group that the threshold cuts is
    ranked: it is dealt by ranges of terms, each of which is sorted on its own and begins at the number of
    terms in the ranges before it, so that no class's vocabulary is sorted in one task, whatever its terms begin with.
    All counts are read twice and never exchanged: for the histogram, and for the terms reached, which are kept.
    With `singles`, counts are those of repeated_counts; the result is None if the cut reaches what they lack.
    """
    percents = CUT_PERCENTS[cut]
    if percents is None:
        return counts
    group = [key, "n"]
    by_count = Window.partitionBy(*group).orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.groupBy(*group, "cnt").agg(F.count(F.lit(1)).alias("_k"))
    histogram = histogram if singles is None else histogram.unionByName(singles)
    mass = F.col("_k") * F.col("cnt")
    levels = (histogram
              .withColumn("_before", F.coalesce(F.sum(mass).over(by_count), F.lit(0)))
              .withColumn("_limit", mass_threshold(F.sum(mass).over(Window.partitionBy(*group)),
                                                   F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("n"))))
              .where((F.col("_before") + F.col("cnt")).cast("float") <= F.col("_limit"))
              .withColumn("_whole", (F.col("_before") + mass).cast("float") <= F.col("_limit")))
    # Groups before the last one reached are whole, so that one row tells all of a class and n; there are few.
    last = levels.groupBy(*group).agg(F.min("cnt").alias("_least"), *[F.min_by(c, "cnt").alias(c) for c in ("_before", "_limit", "_whole")])
    last = keep(last)
    if singles is not None and last.join(F.broadcast(singles.select(*group)), group).where("_least = 1").count():
        return None
    reached = keep(counts.join(F.broadcast(last), group).where(F.col("cnt") >= F.col("_least")))
    whole = F.col("_whole") | (F.col("cnt") > F.col("_least"))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(reached.where(~whole).repartitionByRange(parts, *group, "term").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_p")).select(*group, "_part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*group, "_part").orderBy("term")
    ranked = ranged.withColumn("_within", F.row_number().over(within)).join(F.broadcast(firsts), [*group, "_part"])
    fits = ranked.where((F.col("_before") + (F.col("_first") + F.col("_within")) * F.col("cnt")).cast("float") <= F.col("_limit"))
    columns = [*group, "term", "cnt"]
    return reached.where(whole).select(*columns).unionByName(fits.select(*columns))


def cut_in_order(counts: DataFrame, key: str, cut: str, order: str) -> DataFrame:
    """Like cut_by_mass, but terms go in the order that a column gives them, as lists that are sorted already do.

    Ties in that column go in binary order of terms. Running counts are made by ranges of the order: each is summed
    on its own and begins at the mass of the ranges before it.
    """
    percents = CUT_PERCENTS[cut]
    if percents is None:
        return counts
    group = [key, "n"]
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(counts.repartitionByRange(parts, *group, order, "term").withColumn("_part", F.spark_partition_id()))
    masses = ranged.groupBy(*group, "_part").agg(F.sum("cnt").alias("_mass"))
    by_part = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    limit = mass_threshold(F.sum("_mass").over(Window.partitionBy(*group)), F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("n")))
    firsts = masses.select(*group, "_part", F.coalesce(F.sum("_mass").over(by_part), F.lit(0)).alias("_first"), limit.alias("_limit"))
    within = Window.partitionBy(*group, "_part").orderBy(order, "term").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("_within", F.sum("cnt").over(within)).join(firsts, [*group, "_part"])
    return running.where((F.col("_first") + F.col("_within")).cast("float") <= F.col("_limit")).select(*counts.columns)


def bags_of_classes(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, cnt): all n of a class in one bag."""
    return counts.groupBy(key, "term").agg(F.sum("cnt").alias("cnt"))


def vocabulary(bags: DataFrame) -> DataFrame:
    return bags.select("term").distinct()


def frequencies(bags: DataFrame, key: str) -> DataFrame:
    """(term, df, cf): classes that hold a term, and its count in all of them."""
    return bags.groupBy("term").agg(F.count_distinct(key).alias("df"), F.sum("cnt").alias("cf"))

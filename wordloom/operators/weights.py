"""Term weights of classes: TF-IDF, BM25 and residual IDF, in single precision as models store them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.operators.counts import frequencies

METHODS = ("tfidf", "bm25", "r_tfidf")


def single(c: Column) -> Column:
    return c.cast("float")


def each(values: Sequence) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def ratio(a: Column, b: Column | int) -> Column:
    return single(single(a) / single(F.lit(b) if isinstance(b, int) else b))


def with_df(bags: DataFrame, key: str) -> DataFrame:
    """Adds df, the classes that hold a term. Bags have one row for each class and term, so one exchange, which brings at most all classes of a term together, serves all that is asked of terms."""
    return bags.where(F.col("term").isNotNull()).withColumn("df", F.count(key).over(Window.partitionBy("term")))


def tfidf(bags: DataFrame, key: str, n_classes: int) -> DataFrame:
    """(term, key, weight) of the terms a class holds; the share is of the class's different terms. Absent terms weigh 0."""
    sizes = F.broadcast(bags.groupBy(key).agg(F.count(F.lit(1)).alias("_size")))
    weight = single(-ratio(F.col("cnt"), F.col("_size")) * single(F.ln(ratio(F.col("df"), n_classes))))
    return with_df(bags, key).join(sizes, key).select("term", key, (weight + single(F.lit(0.0))).alias("weight"))


def bm25(bags: DataFrame, lengths: DataFrame, key: str, n_classes: int) -> DataFrame:
    """(term, key, weight); negative for terms in over half of the classes. Absent terms weigh 0."""
    mean = F.avg("length").over(Window.partitionBy(F.lit(0)))  # over classes, of which there are few
    spread = lengths.select(key, (F.lit(0.25) + F.lit(0.75) * F.col("length") / mean).alias("_spread"))
    part = single(3 * F.col("cnt") / (2 * F.col("_spread") + F.col("cnt")))
    idf = single(F.ln(single((F.lit(n_classes) - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    return (with_df(bags, key).join(F.broadcast(spread), key)
            .select("term", key, (single(part * idf) + single(F.lit(0.0))).alias("weight")))


def r_tfidf(bags: DataFrame, class_ids: Sequence, key: str) -> DataFrame:
    """(term, key, weight) of every term and class: IDF, less the IDF expected of its frequency where the class holds the term.

    Dense by definition: its rows are the vocabulary times the classes, of which there are few.
    """
    found, n_classes = frequencies(bags, key), len(class_ids)
    idf = single(-F.ln(ratio(F.col("df"), n_classes)))
    expected = single(-F.ln(1 - F.exp(single(-F.col("cf") / F.lit(n_classes)))))
    terms = found.select("term", idf.alias("_idf"), single(idf - expected).alias("_rest"))
    grid = terms.select("term", "_idf", "_rest", each(class_ids).alias(key))
    own = bags.select("term", key, F.lit(True).alias("_own"))
    return grid.join(own, ["term", key], "left").select("term", key, (F.when(F.col("_own"), F.col("_rest")).otherwise(F.col("_idf")) + single(F.lit(0.0))).alias("weight"))


def dense(weights: DataFrame, class_ids: Sequence, key: str) -> DataFrame:
    """Every term with every class, absent ones at 0."""
    grid = weights.select("term").distinct().select("term", each(class_ids).alias(key))
    return grid.join(weights, ["term", key], "left").select("term", key, F.coalesce("weight", single(F.lit(0.0))).alias("weight"))


def informative(weights: DataFrame, key: str, n_classes: int) -> DataFrame:
    """Drops terms that weigh the same in every class; classes without a row count as 0."""
    of_term = Window.partitionBy("term")
    bounds = weights.withColumns({"_lo": F.min("weight").over(of_term), "_hi": F.max("weight").over(of_term), "_n": F.count(F.lit(1)).over(of_term)})
    zero = F.when(F.col("_n") < n_classes, single(F.lit(0.0)))
    return bounds.where(F.col("term").isNotNull() & (F.least("_lo", zero) < F.greatest("_hi", zero))).select(*weights.columns)


def one_dimension(bags: DataFrame, key: str, n_documents: int, class_id) -> DataFrame:
    """TF-IDF of a single class against a given number of documents."""
    return tfidf(bags, key, n_documents).where(F.col(key) == class_id)

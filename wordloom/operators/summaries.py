"""The most frequent terms of groups, totals over all sets of keys, and sketches that are kept and united later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.tokens import tokenize
from wordloom.operators.counts import each
from wordloom.sources.scratch import keep

#: Least values of up to so many groups are broadcast.
MOST_GROUPS = 100_000


def top_terms(counts: DataFrame, keys: Sequence[str], k: int, by: str = "cnt", term: str = "term") -> DataFrame:
    """(keys, term, by, place): the k terms of each group with the largest value, ties in binary order of terms.

    A histogram of values, one row for each different one, tells which is the least that reaches the first k places; what
    lies below is passed over without a sort. What is left, fewer than k terms and those that tie at the last place, is cut to
    k in each task before it is exchanged. `counts` is read twice, so it should be stored. The least values are kept, one row for each
    group, and broadcast if there are at most MOST_GROUPS. Groups of fewer than k terms have all of them; a null value comes last.
    """
    before = Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    least = keep(histogram.where(F.col("_before") < k).groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.min(by).alias("_least"), F.max(F.col(by).isNull()).alias("_all")))
    reached = F.broadcast(least) if least.count() <= MOST_GROUPS else least
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    left = counts.join(reached, same).where(F.col("_all") | (F.col(by) >= F.col("_least"))).select(*keys, term, by)
    return left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), term))).where(F.col("place") <= k)


def totals(docs: DataFrame, keys: Sequence[str], text: str = "text", n_max: int = 3, drop_urls: bool = True) -> DataFrame:
    """(keys, n, grouping, documents, terms): documents and their n-grams by every set of the keys and of n, in one reading of the texts.

    `grouping` has a bit for each of the keys and n, the last one lowest, which is set where a row stands for all of its values, so that a null key is
    told from a sum. N-grams are counted by the number of words, never made; the cube is made of the sums by all keys.
    """
    words = docs.select(*keys, F.size(tokenize(F.col(text), drop_urls)).cast("long").alias("_size"))
    levels = F.array(*[F.struct(F.lit(n).alias("n"), F.greatest(F.col("_size") - (n - 1), F.lit(0).cast("long")).alias("_terms")) for n in range(1, n_max + 1)])
    finest = each(words, levels, "_level").groupBy(*keys, F.col("_level.n").alias("n")).agg(F.count(F.lit(1)).alias("_d"), F.sum("_level._terms").alias("_t"))
    return finest.cube(*keys, "n").agg(F.grouping_id().alias("grouping"), F.sum("_d").alias("documents"), F.sum("_t").alias("terms"))


#: Sizes of the sketches: buckets of the distinct count as a power of two (relative standard error 0.83 / sqrt(2^14), 0.65 %), points
#: of the quantiles' first level (rank error below 1.4 %, of one quantile at 99 %), and terms that are tracked for the most frequent ones.
DISTINCT_BITS, QUANTILE_POINTS, TRACKED = 14, 200, 10_000


def term_sketches(terms: DataFrame, keys: Sequence[str], term: str = "term") -> DataFrame:
    """(keys, distinct, frequent): of each group's terms, one row each as it stands, a sketch of how many differ and one of the most frequent, as columns to be stored."""
    return terms.groupBy(*keys).agg(F.hll_sketch_agg(term, DISTINCT_BITS).alias("distinct"), F.call_function("approx_top_k_accumulate", F.col(term), F.lit(TRACKED)).alias("frequent"))


def unite_terms(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of fewer keys, or of several tables of them, without the terms."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("distinct").alias("distinct"), F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"))


def term_estimates(sketches: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """(keys, vocabulary, frequent): the estimated number of different terms, and the k most frequent with estimated counts, which are never too low.

    Counts are exact while a group has no more than TRACKED different terms; beyond, they are too high by at most 3.5 / 16,384, 0.021 %, of
    all terms of the group, 16,384 being the places of a sketch that tracks TRACKED terms.
    """
    return sketches.select(*keys, F.hll_sketch_estimate("distinct").alias("vocabulary"), F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k)).alias("frequent"))


def length_sketches(docs: DataFrame, keys: Sequence[str], text: str = "text", drop_urls: bool = True) -> DataFrame:
    """(keys, lengths): a sketch of the quantiles of documents' words."""
    sized = docs.select(*keys, F.size(tokenize(F.col(text), drop_urls)).cast("long").alias("_size"))
    return sized.groupBy(*keys).agg(F.kll_sketch_agg_bigint("_size", QUANTILE_POINTS).alias("lengths"))


def unite_lengths(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("lengths", QUANTILE_POINTS).alias("lengths"))


def length_quantiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(keys, share, words): the length that this share of documents does not exceed, by estimate."""
    return sketches.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_bigint("lengths", F.lit(float(s))).alias("words")) for s in shares])).alias("_q")).select(*keys, "_q.*")

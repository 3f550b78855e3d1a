"""Quality rules: fixed rules on counts, then robust outliers among the documents of one language and source.

Each document that passes the fixed rules is a vector of four transformed statistics. Per language and source, the
minimum covariance determinant (the half or more of the vectors with the least spread) gives a centre and a
covariance that outliers do not move; what lies far from the centre by them is rejected. All is DataFrame
expressions: counts are made inside the row, and each concentration step is one aggregation over four numbers a document.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window; what is repeated is counted by windows.
WINDOW = 8
#: Fixed rules: words at least, percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The statistics: log of the mean word length; roots of the shares of symbols, repeated lines and words in repeated windows.
DIMENSIONS = 4
#: Spread that a statistic has at least; shares that most documents lack have none of their own.
FLOORS = (0.05, 0.05, 0.15, 0.12)
#: Share of a group's vectors in the subset of least spread, and what makes its covariance that of normal vectors: the share over the chance of a chi-square with two more degrees of freedom.
SUBSET = 0.6
CONSISTENCY = 1.8217
#: Squared Mahalanobis distance up to which a document stays: six standard deviations in one statistic.
MOST_DISTANCE = 36.0
#: Groups of fewer vectors are one group together.
LEAST_GROUP = 40
STEPS = 20
#: Estimates up to so many rows of 15 numbers are broadcast; more are joined by an exchange.
MOST_SENT = 10_000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def count_of(text: Column, characters: str) -> Column:
    """How often any of some ASCII characters occurs: each takes one byte."""
    return reduce(lambda a, b: a + b, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the array; overlapping windows count their words once.

    Words are told apart by 64 bits of a hash, windows by 64 bits of the hash of those; where some of these are equal,
    windows count as equal if another hash of theirs is, too.
    """
    def window(at: Column, i: Column, places: range) -> Column:
        return F.xxhash64(*[F.get(at, i + k) for k in places])

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(F.slice(starts, F.lit(2), F.size(starts)), F.slice(starts, F.lit(1), F.size(starts) - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
        return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(WINDOW), lambda a, b: a + b)).otherwise(0)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    def starts(at: Column, hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), window(at, i, range(WINDOW - 1, -1, -1)).alias("g"), i.alias("at"))))
        twice = bound(keyed, lambda k: F.filter(k, lambda x, i: same(x, F.get(k, i + 1)) | same(x, F.get(k, i - 1))))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def some(at: Column) -> Column:
        hashes = F.transform(F.slice(at, F.lit(1), F.size(at) - WINDOW + 1), lambda _, i: window(at, i, range(WINDOW)))
        return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bound(starts(at, h), covered)).otherwise(0))

    return F.when(F.size(words) > WINDOW, bound(F.transform(words, lambda w: F.xxhash64(w)), some)).otherwise(0).cast("long")


def repeated_lines(text: Column) -> tuple[Column, Column]:
    """(lines with a word, those of them that equal an earlier line of the text)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    return counts["n"], counts["again"]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column `_wl_counts`, a struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; null texts have none of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines, again = repeated_lines(text)
    words = bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("again")))
    made = docs.withColumn("_wl_words", words)
    return made.withColumn("_wl_counts", F.struct(
        F.col("_wl_words.n").alias("n_words"), F.col("_wl_words.chars").alias("word_chars"), count_of(text, SYMBOLS).alias("n_symbols"),
        lines.alias("n_lines"), again.alias("n_dup_lines"), F.col("_wl_words.again").alias("n_repeat_words"))).drop("_wl_words")


def statistics(c: Column) -> list[Column]:
    """The vector of a document with words."""
    root = lambda part, whole: F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1))))
    return [F.ln(F.greatest(c["word_chars"], F.lit(1)) / F.greatest(c["n_words"], F.lit(1))), root(c["n_symbols"], c["word_chars"]),
            root(c["n_dup_lines"], c["n_lines"]), root(c["n_repeat_words"], c["n_words"])]


Z, M = [f"z{i}" for i in range(DIMENSIONS)], [f"m{i}" for i in range(DIMENSIONS)]
LOWER = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def prepared(moments: DataFrame) -> DataFrame:
    """(g, start, n, m*, w*, spread) from sums n, s*, p* of vectors and products: the mean, the inverse of the covariance's lower triangular root, and the log of the determinant."""
    df = moments.withColumns({m: F.col(f"s{i}") / F.col("n") for i, m in enumerate(M)})
    df = df.withColumns({f"c{i}{j}": CONSISTENCY * (F.col(f"p{i}{j}") / F.col("n") - F.col(M[i]) * F.col(M[j])) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in LOWER})
    for i, j in LOWER:  # row by row, the root l of the covariance
        left = F.col(f"c{i}{j}") - reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    for i, j in LOWER:  # and its inverse w
        df = df.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}") if i == j else -reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)]) / F.col(f"l{i}{i}"))
    spread = 2 * reduce(lambda a, b: a + b, [F.ln(f"l{i}{i}") for i in range(DIMENSIONS)])
    return df.select("g", "start", "n", *M, *[f"w{i}{j}" for i, j in LOWER], spread.alias("spread"))


def distance() -> Column:
    """Squared Mahalanobis distance of the vector z from the mean m by the inverse root w."""
    rows = [reduce(lambda a, b: a + b, [F.col(f"w{i}{j}") * (F.col(Z[j]) - F.col(M[j])) for j in range(i + 1)]) for i in range(DIMENSIONS)]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(z).alias(f"s{i}") for i, z in enumerate(Z)], *[F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"p{i}{j}") for i, j in LOWER]]


def attach(rows: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(found) if small else found, "g")


def medians(rows: DataFrame) -> DataFrame:
    """(g, start, n, m*, w*, spread): the median of each statistic by itself and its quartiles' distance, from a histogram in steps of 1/1024."""
    step = 1024.0
    long = rows.select("g", F.posexplode(F.array(*[F.round(F.col(z) * step).cast("int") for z in Z])).alias("d", "q"))
    up = Window.partitionBy("g", "d").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    bins = long.groupBy("g", "d", "q").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(Window.partitionBy("g", "d")))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("q"))) / step
    found = bins.groupBy("g", "d").agg(F.max("n").alias("n"), at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("wide"))
    pick = lambda c, d: F.max(F.when(F.col("d") == d, F.col(c)))
    one = found.groupBy("g").agg(F.max("n").alias("n"), *[pick("mid", d).alias(M[d]) for d in range(DIMENSIONS)], *[F.sqrt(pick("wide", d) ** 2 + FLOORS[d] ** 2).alias(f"l{d}") for d in range(DIMENSIONS)])
    inverse = [(1 / F.col(f"l{i}") if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in LOWER]
    return one.select("g", F.lit(0).alias("start"), "n", *M, *inverse, F.lit(float("inf")).alias("spread"))


def concentrated(rows: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """The estimates of the nearest SUBSET of each group's vectors by other estimates, one step of concentration.

    One pass sums vectors and products by group, start and bin of the distance (64 a unit of its log), so that no group is
    sorted or gathered; the bins up to the one that reaches the share make the subset. Vectors that tie are in or out together.
    """
    near = attach(rows, found, small).withColumn("bin", F.least(F.floor(64 * F.log1p(distance())), F.lit(100_000)))
    bins = near.groupBy("g", "start", "bin").agg(*sums(), F.max("spread").alias("was"))
    up = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = (bins.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("g", "start")))
              .where(F.col("before") < SUBSET * F.col("all")))
    names = ["n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"p{i}{j}" for i, j in LOWER]]
    return prepared(inside.groupBy("g", "start").agg(*[F.sum(x).alias(x) for x in names]))


def least_determinant(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(g, m*, w*) of each group of rows (g, z*), and whether they may be broadcast.

    Concentration starts from the medians and from the mean and covariance of all, and goes on until the determinants
    stand still, STEPS times at most; the start that ends with the least determinant is taken.
    """
    classical = prepared(rows.groupBy("g").agg(*sums()).withColumn("start", F.lit(1)))
    found = cut(medians(rows).unionByName(classical))
    small = found.count() <= MOST_SENT
    was = None
    for _ in range(STEPS):
        found = cut(concentrated(rows, found, small))
        now = dict(found.groupBy("start").agg(F.sum("spread")).collect())  # two rows
        if was is not None and all(abs(was[k] - now[k]) < 1e-6 for k in now):
            break
        was = now
    best = found.groupBy("g").agg(F.min_by(F.struct(*M, *[f"w{i}{j}" for i, j in LOWER]), F.struct("spread", "start")).alias("e"))
    return cut(best.select("g", "e.*")), small


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), most_distance: float = MOST_DISTANCE) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in repeated windows. The others
    are kept if their squared Mahalanobis distance is at most most_distance; distance is null where base_failed.
    A null, empty or blank text has no words and fails. Null languages and sources are groups of their own, groups of fewer
    than LEAST_GROUP documents that pass the fixed rules are one group together, however small. Ids may be null or repeat;
    each row counts for itself, so that equal texts of one group have equal results. Columns other than those named are not
    read. An empty table gives an empty result.

    Texts are read once, whole; their counts are kept in the shared folder. A group of any size is only summed, with
    map-side combining, never gathered. Estimates are broadcast up to MOST_SENT rows and joined by an exchange beyond.
    """
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(group_cols)])
    own = F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), f"_g{i}"), F.lit("-")) for i in range(len(group_cols))], F.lit(""))
    counted = with_counts(taken, "_text").select("_id", own.alias("_own"), "_wl_counts")
    c = F.col("_wl_counts")
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    counts = cut(counted.select("_id", "_own", "_wl_counts", failed.alias("base_failed"), *[x.alias(z) for x, z in zip(statistics(c), Z, strict=True)]))
    passed = counts.where("not base_failed")
    sizes = passed.groupBy("_own").agg(F.count(F.lit(1)).alias("_n")).select("_own", F.when(F.col("_n") >= LEAST_GROUP, F.col("_own")).otherwise("pooled").alias("g"))
    sizes = cut(sizes)
    few = sizes.count() <= MOST_SENT
    grouped = cut(passed.select("_own", *Z).join(F.broadcast(sizes) if few else sizes, "_own").select("g", *Z))
    found, small = least_determinant(grouped)
    of_group = sizes.join(F.broadcast(found) if small else found, "g").drop("g")
    scored = counts.join(F.broadcast(of_group) if few else of_group, "_own", "left")
    squared = F.when(~F.col("base_failed"), distance())
    return scored.select(F.col("_id").alias(id_col), *[F.col(f"_wl_counts.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         "base_failed", squared.alias("distance"), F.coalesce(~F.col("base_failed") & (squared <= most_distance), F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names. Rows are numbered for it, so ids may be null or repeat."""
    row, ok = fresh("_wl_row", docs), fresh("_wl_kept", docs)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    good = quality_rules(numbered, row, text_col, group_cols).where("kept").select(F.col(row).alias(ok))
    return numbered.join(good, F.col(row) == F.col(ok), "left_semi").drop(row)


def expected_share(share: float) -> float:
    """Of normal vectors in DIMENSIONS (an even number) dimensions, what CONSISTENCY is: the covariance of all over that of the nearest `share`."""
    def upto(x: float, degrees: int) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))

    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid, DIMENSIONS) < share else (low, mid)
    return share / upto(low, DIMENSIONS + 2)

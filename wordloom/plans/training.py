"""From a corpus to a model, and from a model to a report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wordloom.operators import counts, frequent, scoring, weights
from wordloom.sources.corpus import distinct_classes
from wordloom.sources.scratch import keep


#: From so many n-grams of joined texts on, only those that the cut may reach are counted one by one.
VAST_GRAMS = 40_000_000


@dataclass(frozen=True)
class Settings:
    """How a model is built and texts are scored."""

    method: str = "tfidf"
    n_max: int = 3
    cut: str = "d1"
    threshold: int = 10
    drop_urls: bool = True

    def __post_init__(self):
        if self.method not in weights.METHODS or not 1 <= self.n_max <= 4 or self.cut not in counts.CUT_PERCENTS:
            raise ValueError(f"unknown model settings: {self}")


def weigh(bags: DataFrame, lengths: DataFrame, classes: list, key: str, method: str) -> DataFrame:
    """(term, key, weight) by any of the methods, without terms that weigh the same in all classes."""
    if method == "tfidf":
        out = weights.tfidf(bags, key, len(classes))
    elif method == "bm25":
        out = weights.bm25(bags, lengths, key, len(classes))
    else:
        out = weights.r_tfidf(bags, classes, key)
    return weights.informative(out, key, len(classes))


def train(docs: DataFrame, key: str, text: str = "text", settings: Settings = Settings(), joined: bool = False) -> DataFrame:
    """(term, key, weight) from documents of classes. Rows without a class are left out. With `joined`, texts are those of counts.joined_texts.

    Of many joined texts, n-grams that occur once are stored only if the cut reaches one. Texts are read once, for the counts, or twice from VAST_GRAMS n-grams on; these, the bags cut from them and the model are kept in the shared folder.
    """
    docs = docs.where(F.col(key).isNotNull())
    classes = distinct_classes(docs, key)
    counted = counts.class_counts(docs, key, text, settings.n_max, settings.drop_urls, joined=joined)
    totals = counts.gram_totals(docs, key, text, settings.n_max) if joined and counts.CUT_PERCENTS[settings.cut] else {}
    if sum(totals.values()) >= VAST_GRAMS:
        for rest, left in frequent.frequent_counts(docs, key, classes, totals, text, settings.n_max, settings.cut):
            cut = counts.cut_by_mass(rest, key, settings.cut, left)
            if cut is not None:
                lengths = docs.sparkSession.createDataFrame([(c, totals.get((c, 1), 0)) for c in classes], StructType([docs.schema[key], StructField("length", LongType())]))
                return train_from_cut(cut, lengths, classes, key, settings)
    if sum(k for (_, n), k in totals.items() if n > 1) >= counts.MANY_GRAMS:
        rest, singles = counts.repeated_counts(counted, key, totals)
        cut = counts.cut_by_mass(rest, key, settings.cut, singles)
        if cut is not None:
            return train_from_cut(cut, counts.lengths_of(rest, classes, key), classes, key, settings)
    return train_from_counts(keep(counted), classes, key, settings)


def train_from_cut(cut: DataFrame, lengths: DataFrame, classes: list, key: str, settings: Settings = Settings()) -> DataFrame:
    return keep(weigh(keep(counts.bags_of_classes(cut, key)), lengths, classes, key, settings.method))


def train_from_counts(counted: DataFrame, classes: list, key: str, settings: Settings = Settings()) -> DataFrame:
    """The same from stored counts of n-grams that are not cut yet, and all classes, those without words too."""
    return train_from_cut(counts.cut_by_mass(counted, key, settings.cut), counts.lengths_of(counted, classes, key), classes, key, settings)


def grid(methods=weights.METHODS, levels=(1, 2, 3, 4), cuts=tuple(counts.CUT_PERCENTS)) -> list[Settings]:
    return [Settings(method, n, cut) for method, n, cut in product(methods, levels, cuts)]


def train_grid(docs: DataFrame, key: str, text: str = "text", settings: list[Settings] | None = None) -> Iterator[tuple[Settings, DataFrame]]:
    """A model for each point of the grid; the counts of n-grams are made once for all of them, the bags once for each level and cut."""
    settings = settings or grid()
    docs = docs.where(F.col(key).isNotNull())
    classes = distinct_classes(docs, key)
    counted = keep(counts.class_counts(docs, key, text, max(s.n_max for s in settings), settings[0].drop_urls))
    lengths, bags = keep(counts.lengths_of(counted, classes, key)), {}
    for s in settings:
        if (s.n_max, s.cut) not in bags:
            bags[s.n_max, s.cut] = keep(counts.bags_of_classes(counts.cut_by_mass(counted.where(F.col("n") <= s.n_max), key, s.cut), key))
        yield s, weigh(bags[s.n_max, s.cut], lengths, classes, key, s.method)


def classify(docs: DataFrame, model: DataFrame, doc: str, key: str, text: str = "text", settings: Settings = Settings(), names: dict | None = None, joined: bool = False) -> DataFrame:
    """(doc, key, cosine, percent[, class_name]) of classes at or above the threshold; a text without known terms has no rows."""
    bags = counts.document_bags(docs, doc, text, settings.n_max, settings.drop_urls, joined)
    return scoring.report(scoring.cosine_scores(bags, model, doc, key), doc, key, settings.threshold, names)

"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is (noisy-or).

The sentence model is trained from document labels only and then locates offending sentences. A document is
the set of what its sentences hold of the model's words, in training and in scoring alike: sentences that hold
the same are one, and one without any adds nothing, whatever their number. What no sentence explains falls to
one small chance a document. Scores are the noisy-or that is trained, over all of these.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordloom.llm.common import cut, fresh

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 10)


def held_out(ident: Column) -> Column:
    """Rows never learnt from; a null id is not held out, having no label."""
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    """The word, and beginnings of longer words."""
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


def sentences(text: str) -> list[str]:
    """The different sentences in lower case, in order."""
    return list(dict.fromkeys(SENTENCE.findall(text.lower())))


#: The chance of a document to be toxic that no sentence explains is at most this.
MOST_LEAK = 0.05
#: Log-odds of a sentence without telling words are at most this.
MOST_BIAS = -4.0


@dataclass
class Model:
    """Log-odds of a sentence are `bias` plus the weights of its words' features, none of them negative. `leak` is a document's own chance."""

    bias: float
    weights: dict[str, float]
    leak: float = 0.0


class Features(dict):
    """Word to those of its features that have a number; forgets all when it holds too many words."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        out = self[word] = tuple(self.numbers[f] for f in features(word) if f in self.numbers)
        return out

    def held(self, sentence: str) -> frozenset[int]:
        """What a sentence in lower case holds, each feature once."""
        return frozenset(f for w in set(WORD.findall(sentence)) for f in self[w])

    def bag(self, text: str) -> list[list[int]]:
        """The different non-empty sets of features that a text's sentences hold, in order."""
        return sorted(map(sorted, {h for s in sentences(text) if (h := self.held(s))}))


def softplus(z):
    return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))


def hazards(bias: float, sums: np.ndarray) -> np.ndarray:
    """-log(1 - score) of sentences whose words' weights add up to `sums`: what noisy-or adds up. Zero for a sum of zero."""
    return softplus(bias + sums) - softplus(bias)


@dataclass
class Bags:
    """Documents as labels and hits: hit k is feature[k] in sentence[k]; doc holds each sentence's document."""

    labels: np.ndarray
    feature: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, bytes, bytes]]) -> Bags:
        """From (label, features, sentences from 0) of each document, 32-bit numbers."""
        feature, sentence, doc, first = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for d, (_, fs, ss) in enumerate(rows):
            own = np.frombuffer(ss, np.int32).astype(np.int64)
            n = int(own.max()) + 1 if len(own) else 0
            feature.append(np.frombuffer(fs, np.int32).astype(np.int64))
            sentence.append(own + first)
            doc.append(np.full(n, d))
            first += n
        return Bags(np.array([y for y, _, _ in rows], float), *map(np.concatenate, (feature, sentence, doc)))


def loss(bags: Bags, bias: float, leak: float, weights: np.ndarray, decay: float) -> tuple[float, np.ndarray, float, float]:
    """Mean negative log-likelihood of noisy-or plus decay, and its gradients by weights, bias and leak (a hazard)."""
    n = len(bags.labels)
    sums = np.bincount(bags.sentence, weights[bags.feature], len(bags.doc))
    total = np.maximum(leak + np.bincount(bags.doc, hazards(bias, sums), n), 1e-9)
    toxic = bags.labels > 0
    value = np.where(toxic, -np.log(-np.expm1(-total)), total).sum() / n + decay / 2 * (weights**2).sum()
    pull = np.where(toxic, -1 / np.expm1(np.minimum(total, 500)), 1.0) / n
    of_sentence, slope = pull[bags.doc], 1 / (1 + np.exp(-(bias + sums)))
    by_weight = np.bincount(bags.feature, (of_sentence * slope)[bags.sentence], len(weights)) + decay * weights
    return float(value), by_weight, float((of_sentence * (slope - 1 / (1 + math.exp(-bias)))).sum()), float(pull.sum())


def fit(bags: Bags, n_features: int, steps: int = 400, rate: float = 0.1, decay: float = 2e-4) -> tuple[float, float, np.ndarray]:
    """(bias, leak, weights) by projected gradient descent, until 25 steps gain less than a thousandth; weights stay at 0 or above, so that no other word can excuse an insult."""
    weights, bias, leak = np.zeros(n_features), -5.0, 0.01
    if not bags.labels.any():
        return -20.0, 0.0, weights
    m, v = np.zeros(n_features + 2), np.zeros(n_features + 2)
    scale, last = np.concatenate([np.ones(n_features + 1), [0.01]]), math.inf  # of a step; the leak is a small number
    for step in range(1, steps + 1):
        value, by_weight, by_bias, by_leak = loss(bags, bias, leak, weights, decay)
        if step % 25 == 0:
            if last - value < 1e-3 * value:
                break
            last = value
        grad = np.concatenate([by_weight, [by_bias, by_leak]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = scale * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = np.maximum(weights - move[:-2], 0.0), min(bias - move[-2], MOST_BIAS)
        leak = min(max(leak - move[-1], 1e-6), -math.log1p(-MOST_LEAK))
    return float(bias), float(-math.expm1(-leak)), weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_docs: int = 20_000, max_bytes: int = 64 << 20, min_gain: float = 12.0) -> Model:
    """Fits the sentence model on labelled rows that are not held out, at most about max_docs of them and max_bytes of text, chosen by a hash of the id.

    Null labels and null ids are left out; the largest label of an id holds, and rows that repeat it are learnt
    from each. A null text counts as empty. Features that are more frequent in toxic documents are chosen by
    the likelihood ratio of their document counts in both classes, all that gain at least min_gain.
    """
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_wl_id")).agg(F.max(label_col).cast("int").alias("_y")))
    n = marks.count()
    part = lambda salt, share: F.pmod(F.xxhash64("_wl_id", F.lit(salt)), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, share))
    marks = marks.where(part(0, max_docs / max(n, 1)))
    # The sample is kept, so that documents are read once for it.
    sample = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(marks), F.col("_id") == F.col("_wl_id"))  # max_docs rows
                 .select("_wl_id", F.coalesce("_text", F.lit("")).alias("_text"), (F.col("_y") > 0).cast("int").alias("_y")))
    size = sample.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    sample = sample.where(part(1, max_bytes / max(size, 1))).select("_text", "_y")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, int] = {}
            toxic: dict[str, int] = {}
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for f in {f for w in set(WORD.findall(text.as_py().lower())) for f in features(w)}:
                    n[f] = n.get(f, 0) + 1
                    if label:
                        toxic[f] = toxic.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(n.values(), pa.int64()), pa.array([toxic.get(f, 0) for f in n], pa.int64())], ["f", "n", "a"])

    classes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = classes.get(0, 0), classes.get(1, 0)
    if not n1:
        return Model(-20.0, {})
    counted = sample.mapInArrow(occurrences, "f string, n long, a long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).where("n >= 3")
    a, b = F.col("a"), F.col("n") - F.col("a")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = F.lit(n1 / (n0 + n1))
    gain = 2 * (term(a, F.col("n") * share) + term(b, F.col("n") * (1 - share)) + term(n1 - a, (n0 + n1 - F.col("n")) * share) + term(n0 - b, (n0 + n1 - F.col("n")) * (1 - share)))
    chosen = sorted(r["f"] for r in counted.where((gain >= min_gain) & (a > F.col("n") * share)).select("f").collect())  # words of a bounded sample
    number = {f: i for i, f in enumerate(chosen)}
    table = docs.sparkSession.sparkContext.broadcast(number)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(table.value)
        for b in batches:
            fs, ss = [], []
            for text in b.column(0):
                pairs = [(f, k) for k, x in enumerate(known.bag(text.as_py())) for f in x]
                fs.append(np.array([p[0] for p in pairs], np.int32).tobytes())
                ss.append(np.array([p[1] for p in pairs], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(fs, pa.binary()), pa.array(ss, pa.binary())], ["y", "f", "s"])

    found = sample.mapInArrow(hits, "y int, f binary, s binary").collect()  # hits of at most about max_bytes of text
    bias, leak, weights = fit(Bags.of(sorted((r["y"], bytes(r["f"]), bytes(r["s"])) for r in found)), len(chosen))  # the same model in whatever order tasks end
    return Model(bias, {f: float(weights[i]) for f, i in number.items() if weights[i]}, leak)


class Scorer:
    """A model made ready for scoring; one for each task."""

    def __init__(self, model: Model):
        self.model, self.weights = model, np.array(list(model.weights.values()))
        self.known = Features({f: i for i, f in enumerate(model.weights)})

    def sentence(self, text: str) -> float:
        """The score of one sentence."""
        return self.score_of(self.known.held(text.lower()))

    def score_of(self, held: frozenset[int]) -> float:
        return float(-np.expm1(-hazards(self.model.bias, self.weights[list(held)].sum()))) if held else 0.0

    def document(self, text: str) -> float:
        """Noisy-or: 1 minus the product of the chances of the leak and of the bag's sentences to be clean."""
        sums = np.array([self.weights[x].sum() for x in self.known.bag(text)])
        return float(-np.expm1(math.log1p(-self.model.leak) - hazards(self.model.bias, sums).sum()))

    def offending(self, text: str, threshold: float) -> list[tuple[int, int, float]]:
        """(start, end, score) of sentences, in code points of the text, whose own score reaches the threshold."""
        found = ((m.start(), m.end(), self.sentence(m[0])) for m in SENTENCE.finditer(text))
        return [x for x in found if x[2] >= threshold]


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, score_col: str = "_toxicity", offending_col: str = "_offending") -> DataFrame:
    """docs with two more columns: a score from 0 to 1, and an array of (start, end, score), the sentences whose own score reaches the threshold.

    A null or empty text, or one without sentences, has the model's leak as its score. Each row is scored on
    its own, whole, however long; ids are not read. The new columns' names must be free, else a ValueError is raised.
    """
    if taken := {score_col.lower(), offending_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns of these names: {sorted(taken)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of words of a bounded sample
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            scores, places = [], []
            for t in b.column(at):
                text = t.as_py() or ""
                scores.append(scorer.document(text))
                # A sentence's score is at most the document's.
                found = scorer.offending(text, threshold) if scores[-1] >= threshold else []
                places.append([dict(zip(("start", "end", "score"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(places, kind)], [*b.schema.names, score_col, offending_col])

    more = docs.sparkSession.createDataFrame([], f"`{score_col}` double, `{offending_col}` array<struct<start:long,end:long,score:double>>")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more.schema.fields]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 from the threshold on), offending (the sentences).

    A null text counts as empty, and what has no telling word scores at most MOST_LEAK. Without usable labels
    every score is next to 0. Ids may be null (never held out) or repeat: each row is scored on its own, so
    rows with equal texts have equal scores. Columns other than the two named are not read. An empty table
    gives an empty result.
    """
    scored = with_toxicity(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), text_col, threshold, "_wl_score", "_wl_offending")
    return scored.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col("_wl_score").alias("score"),
                         (F.col("_wl_score") >= threshold).cast("int").alias("predicted"), F.col("_wl_offending").alias("offending"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, whatever their names.

    Scores are those of toxicity_scores: null and empty texts stay, null ids and repeated rows are judged by their own text.
    """
    score, places = fresh("_wl_score", docs), fresh("_wl_offending", docs)
    scored = with_toxicity(docs, train(docs, labels, id_col, text_col), text_col, threshold, score, places)
    return scored.where(F.col(score) < threshold).drop(score, places)

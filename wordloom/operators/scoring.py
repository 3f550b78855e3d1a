"""Cosine scores of documents against class vectors, and the report made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.tokens import class_label

#: Models of up to so many weights are broadcast at least, and at most; between them as many as fit into a fifth of the smaller heap, at so
#: many bytes each; larger ones are joined by an exchange.
MOST_SENT, MOST_EVER, WEIGHT_BYTES = 2_000_000, 8_000_000, 110


def most_weights(spark: SparkSession) -> int:
    """How many weights may be broadcast with the memory that driver and executors have."""
    sc = spark.sparkContext
    heap = sc._jvm.java.lang.Runtime.getRuntime().maxMemory()
    if not sc.master.startswith("local["):
        heap = min(heap, sc._jsc.sc().executorMemory() << 20)
    return min(max(MOST_SENT, heap // 5 // WEIGHT_BYTES), MOST_EVER)


def meet(bags: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Bags with the rows of their terms, which are broadcast by a number of the term, as this takes less room than by the term; the terms are compared too."""
    rows = rows.withColumnRenamed("term", "_term").withColumn("_number", F.xxhash64("_term"))
    bags = bags.withColumn("term_number", F.xxhash64("term"))
    same = F.col("term").between(F.col("_term"), F.col("_term"))  # equal, in a form that makes no second key of it
    return bags.join(F.broadcast(rows), (F.col("term_number") == F.col("_number")) & same, how).drop("_term", "_number", "term_number")


def met_by_exchange(bags: DataFrame, rows: DataFrame, doc: str, most: int) -> DataFrame:
    """(doc, term, cnt, _own) left-joined with a model's rows, where bags are exchanged by term.

    Of a document's terms that the model does not know, one row with the sum of their squares is exchanged, if numbers of the model's
    terms can be broadcast, which tell most of them; a term with the number of another one is exchanged like a known one.
    """
    square = F.col("cnt") * F.col("cnt")
    numbers = rows.select(F.xxhash64("term").alias("_number")).distinct()
    if most and numbers.count() <= most:
        told = bags.withColumn("_at", F.xxhash64("term")).join(F.broadcast(numbers), F.col("_at") == F.col("_number"), "left")
        # What stands for unknown terms begins with a space, as no term does, and differs by document, so that these rows are spread.
        other = F.concat(F.lit(" "), F.xxhash64(doc).cast("string"))
        bags = (told.select(doc, F.when(F.col("_number").isNotNull(), F.col("term")).otherwise(other).alias("term"), "cnt")
                .groupBy(doc, "term").agg(F.sum("cnt").alias("cnt"), F.sum(square).alias("_own")))
    else:
        bags = bags.withColumn("_own", square)
    return bags.join(rows.hint("merge"), "term", "left")


def class_norms(weights: DataFrame, key: str) -> DataFrame:
    """(key, sq_len): squared length of each class's vector; products in single, the sum in double precision."""
    return weights.groupBy(key).agg(F.sum((F.col("weight") * F.col("weight")).cast("double")).alias("sq_len"))


def dot_products(bags: DataFrame, weights: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, key, dot) for documents that share a term with the model. Only the model moves if it is small enough to be sent to all tasks."""
    product = (F.col("weight") * F.col("cnt").cast("float")).cast("double")
    small = weights.count() <= most_weights(bags.sparkSession)
    return (meet(bags, weights) if small else bags.join(weights, "term")).groupBy(doc, key).agg(F.sum(product).alias("dot"))


def cosine_scores(bags: DataFrame, weights: DataFrame, doc: str, key: str, most_sent: int | None = None) -> DataFrame:
    """(doc, key, cosine) that are numbers other than 0. A text's length counts all its terms, known to the model or not.

    Bags are read once: a term's row gives a product for each class that weighs it, and counts for the text's own
    length with the first of these classes, or with none. A model of more than `most_sent` weights, by default what memory allows, meets the bags
    by term; one that is stored in buckets (sources.models.write_buckets) stays where it is, and only the bags move.
    """
    first = F.col(key) == F.min(key).over(Window.partitionBy("term"))
    model = weights.select("term", F.col(key).alias("_class"), "weight", first.alias("_first"))
    cnt, most = F.col("cnt"), most_weights(bags.sparkSession)
    if weights.count() <= (most if most_sent is None else most_sent):
        both = meet(bags.withColumn("_own", cnt * cnt), model, "left")
    else:
        both = met_by_exchange(bags, model, doc, 2 * most)
    sums = both.groupBy(doc, "_class").agg(
        F.sum((F.col("weight") * cnt.cast("float")).cast("double")).alias("dot"),
        F.sum(F.when(F.coalesce("_first", F.lit(True)), F.col("_own"))).alias("_own"))
    text = F.sum("_own").over(Window.partitionBy(doc))
    dots = sums.withColumn("_text", text).where(F.col("_class").isNotNull()).withColumnRenamed("_class", key)
    cosine = F.try_divide(F.col("dot"), F.sqrt(F.col("sq_len") * F.col("_text")))
    return dots.join(F.broadcast(class_norms(weights, key)), key).select(doc, key, cosine.alias("cosine")).where(F.col("cosine").isNotNull() & ~F.isnan("cosine") & (F.col("cosine") != 0))


def percents(scores: DataFrame, doc: str) -> DataFrame:
    """Adds percent: a score's share of all scores of the document."""
    total = F.sum("cosine").over(Window.partitionBy(doc))
    return scores.withColumn("percent", F.try_divide(F.col("cosine"), total) * 100)


def report(scores: DataFrame, doc: str, key: str, threshold: int = 10, names: dict[int, str] | None = None) -> DataFrame:
    """Classes with a share of at least `threshold` percent; with names, class_name too."""
    out = percents(scores, doc).where(F.col("percent") >= threshold)
    return out if names is None else out.withColumn("class_name", class_label(F.col(key), names))


def ranks(scores: DataFrame, doc: str, key: str) -> DataFrame:
    """Adds place: 1 for a document's best class; ties go by class."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("cosine"), key)))


def residual(reported: DataFrame, doc: str, label: str = "other") -> DataFrame:
    """(doc, class_name, percent): what the reported classes leave of 100 percent."""
    return (reported.groupBy(doc).agg((100 - F.sum("percent")).alias("percent"))
            .select(doc, F.lit(label).alias("class_name"), "percent"))


def as_json(reported: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, json): an array of {i, n, p}, best class first; percents as text with two decimals."""
    best = Window.partitionBy(doc).orderBy(F.desc("cosine"), key)
    item = F.struct(F.row_number().over(best).alias("place"), F.col(key).alias("i"), F.col("class_name").alias("n"), F.format_number(F.round("percent", 2), 2).alias("p"))
    ordered = reported.select(doc, item.alias("item")).groupBy(doc).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return ordered.select(doc, F.to_json(F.transform("items", lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["p"].alias("p")))).alias("json"))


def evaluate(predicted: DataFrame, truth: DataFrame, doc: str, guess: str, actual: str) -> DataFrame:
    """(class, true_positive, predicted, actual, precision, recall) of one class per document; a document without a guess is a miss."""
    joined = truth.select(doc, F.col(actual).alias("_actual")).join(predicted.select(doc, F.col(guess).alias("_guess")), doc, "left")
    sides = joined.select(F.explode(F.array(
        F.struct(F.col("_actual").alias("class"), (F.col("_actual") == F.col("_guess")).alias("hit"), F.lit("actual").alias("side")),
        F.struct(F.col("_guess").alias("class"), F.lit(False).alias("hit"), F.lit("guess").alias("side")))).alias("x")).select("x.*").where("class is not null")
    counted = sides.groupBy("class").agg(
        F.count_if(F.coalesce("hit", F.lit(False))).alias("true_positive"), F.count_if(F.col("side") == "guess").alias("predicted"), F.count_if(F.col("side") == "actual").alias("actual"))
    return counted.withColumns({"precision": F.try_divide("true_positive", "predicted"), "recall": F.try_divide("true_positive", "actual")})

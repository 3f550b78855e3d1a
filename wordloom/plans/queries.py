"""The registered queries of the text categoriser, and the DuckDB SQL that gives the same rows.

Documents are the training corpus, their language is the class. URLs are dropped where the name says so
(tokens_no_urls, classify_report).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import tokens as text
from wordloom.functions.urls import extract_urls
from wordloom.operators import counts, intervals, scoring, summaries, weights
from wordloom.plans.training import Settings, classify, train, weigh
from wordloom.sources import models
from wordloom.sources.corpus import distinct_classes, with_class_id
from wordloom.sources.scratch import keep, scratch_folder
from wordloom.sources.tables import read_table
from wordloom.streaming import ingest, sessions
from wordloom.streaming.ratelimit import Limits, request_outcomes, request_windows

MODEL = Settings(n_max=2, cut="d1", drop_urls=False)
NAMES = {0: "German", 1: "English", 2: "Spanish"}
DIGITS = 6


table = read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; results are compared at DIGITS of them."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0) for c in columns})


def words_of(docs: DataFrame, *keys: str, drop_urls: bool = False) -> DataFrame:
    return counts.each_with_place(docs.select(*keys, text.tokenize(F.col("text"), drop_urls).alias("_words")), "_words")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(documents(spark, sf_dir), "doc_id")


def tokens_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def tokens_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(table(spark, sf_dir, "benchmark"), "item_id")


def tokens_no_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(documents(spark, sf_dir), "doc_id", drop_urls=True)


def urls_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(extract_urls(F.col("html"))).alias("u"))
    return found.select("page_id", "u.value", "u.start", "u.length")


def bags(n: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: counts.document_bags(documents(spark, sf_dir), "doc_id", n_max=n, drop_urls=False)


def tf_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.class_counts(documents(spark, sf_dir), "lang", n_max=3, drop_urls=False)


def tf_cut_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in alphabetical order instead of by count."""
    found = counts.class_counts(documents(spark, sf_dir), "lang", drop_urls=False)
    return counts.cut_in_order(found, "lang", "d2", "term")


def tf_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two tables, made apart, as one."""
    more = table(spark, sf_dir, "benchmark").withColumn("lang", F.lit("en"))
    parts = [counts.class_counts(t, "lang", n_max=2, drop_urls=False) for t in (documents(spark, sf_dir), more)]
    return counts.merge_counts(*parts, key="lang")


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent n-grams of each language and level."""
    docs = counts.joined_texts(documents(spark, sf_dir), "lang", drop_urls=False)
    counted, totals = counts.class_counts(docs, "lang", n_max=3, joined=True), counts.gram_totals(docs, "lang", n_max=3)
    if sum(totals.values()) >= counts.MANY_GRAMS:
        repeated = keep(counted.where("cnt > 1"))  # n-grams that occur once come last, and are asked for only where there are too few others
        if {tuple(r) for r in repeated.groupBy("lang", "n").count().where("count >= 100").select("lang", "n").collect()} >= set(totals):
            return summaries.top_terms(repeated, ["lang", "n"], 100)
    return summaries.top_terms(keep(counted), ["lang", "n"], 100)


def totals_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and n-grams by all sets of language, source and level, all levels together as n = 0."""
    return summaries.totals(documents(spark, sf_dir), ["lang", "source"], drop_urls=False).withColumn("n", F.coalesce("n", F.lit(0)))


def sketch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's vocabulary with whether the estimates of sketches, made by language and source and united, keep to their bounds.

    Of different words, four standard errors; of each of the ten most frequent words, the bound of its count; of the middle length, 2 % of the ranks.
    """
    docs = documents(spark, sf_dir).select("lang", "source", "text")
    words = words_of(docs, "lang", "source")
    found = keep(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt")))
    estimates = summaries.term_estimates(summaries.unite_terms(keep(summaries.term_sketches(words, ["lang", "source"], "word")), ["lang"]), ["lang"])
    exact = found.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.sum("cnt").alias("_all"))
    both = exact.withColumnRenamed("words", "_words").join(estimates, "lang")
    frequent = both.select("lang", "_all", F.explode("frequent").alias("_f")).select("lang", "_all", F.col("_f.item").alias("word"), F.col("_f.count").alias("_about")).join(found, ["lang", "word"])
    bounds = frequent.groupBy("lang").agg(F.bool_and(F.col("_about").between(F.col("cnt"), F.col("cnt") + F.col("_all") * 3.5 / 16_384)).alias("counts_close"))
    middle = summaries.length_quantiles(summaries.unite_lengths(keep(summaries.length_sketches(docs, ["lang", "source"], drop_urls=False)), ["lang"]), ["lang"], [0.5])
    ranks = (docs.select("lang", F.size(text.tokenize(F.col("text"), False)).alias("_size")).join(F.broadcast(middle), "lang").groupBy("lang")
             .agg(F.avg((F.col("_size") < F.col("words")).cast("double")).alias("_below"), F.avg((F.col("_size") <= F.col("words")).cast("double")).alias("_upto")))
    vocabulary_close = F.abs(F.col("vocabulary") - F.col("_words")) <= F.col("_words") * 4 * 0.83 / 2 ** (summaries.DISTINCT_BITS / 2)
    lengths_close = (F.col("_below") <= 0.52) & (F.col("_upto") >= 0.48)
    return both.join(bounds, "lang").join(ranks, "lang").select("lang", F.col("_words").alias("words"), vocabulary_close.alias("vocabulary_close"), "counts_close", lengths_close.alias("lengths_close"))


def cut_counts(cut: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: counts.cut_by_mass(keep(tf_by_class(spark, sf_dir)), "lang", cut)


def class_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.class_lengths(documents(spark, sf_dir), "lang", drop_urls=False)


def average_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(class_lengths(spark, sf_dir).agg(F.avg("length").alias("average")), "average")


def model_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bags of which the model is made; several parts of a plan read them."""
    found = keep(counts.class_counts(documents(spark, sf_dir), "lang", n_max=MODEL.n_max, drop_urls=False))
    return keep(counts.bags_of_classes(counts.cut_by_mass(found, "lang", MODEL.cut), "lang"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.vocabulary(model_bags(spark, sf_dir))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.frequencies(model_bags(spark, sf_dir), "lang")


def weights_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(distinct_classes(documents(spark, sf_dir), "lang"))
    return rounded(weights.tfidf(model_bags(spark, sf_dir), "lang", n), "weight")


def weights_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(distinct_classes(documents(spark, sf_dir), "lang"))
    return rounded(weights.bm25(model_bags(spark, sf_dir), class_lengths(spark, sf_dir), "lang", n), "weight")


def weights_r_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weights.r_tfidf(model_bags(spark, sf_dir), distinct_classes(documents(spark, sf_dir), "lang"), "lang"), "weight")


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(documents(spark, sf_dir), "lang", settings=MODEL)


def weights_informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir), "weight")


def weights_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weights.dense(model(spark, sf_dir), distinct_classes(documents(spark, sf_dir), "lang"), "lang"), "weight")


def weights_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of another class column: the quality label."""
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    found, classes = keep(counts.class_counts(docs, "quality", n_max=1, drop_urls=False)), distinct_classes(docs, "quality")
    return rounded(weigh(counts.bags_of_classes(found, "quality"), counts.lengths_of(found, classes, "quality"), classes, "quality", "bm25"), "weight")


def one_dimension_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weights.one_dimension(model_bags(spark, sf_dir), "lang", 100, "en"), "weight")


def class_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.class_norms(model(spark, sf_dir), "lang"), "sq_len")


def joined(docs: DataFrame, *keys: str) -> DataFrame:
    return counts.joined_texts(docs, "doc_id", *keys, drop_urls=False)


def bags_and_model(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is scored and what it is scored with, of the same joined texts."""
    return counts.document_bags(docs, "doc_id", n_max=MODEL.n_max, joined=True), train(docs, key, settings=MODEL, joined=True)


def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.dot_products(*bags_and_model(joined(documents(spark, sf_dir), "lang"), "lang"), "doc_id", "lang"), "dot")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cosine_scores(*bags_and_model(joined(documents(spark, sf_dir), "lang"), "lang"), "doc_id", "lang")


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores(spark, sf_dir), "cosine")


def cosine_scores_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a model stored in buckets by term, which does not move."""
    name = f"wordloom_model_{uuid.uuid4().hex}"
    bags, trained = bags_and_model(joined(documents(spark, sf_dir), "lang"), "lang")
    models.write_buckets(trained, name, path=scratch_folder(spark))
    return rounded(scoring.cosine_scores(bags, models.read_buckets(spark, name), "doc_id", "lang", most_sent=0), "cosine")


def model_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model made of counts that a stream of all documents has left, in up to four micro-batches of whole files."""
    path, folder = f"{sf_dir}/documents.parquet", scratch_folder(spark)
    stored = spark.read.parquet(path)
    # A pattern, as a stream takes a plain path for a folder, and a table may be one file.
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", math.ceil(len(stored.inputFiles()) / 4) or 1).parquet(f"{path[:-1]}[t]")
    ingest.ingest(stream, "lang", folder, f"{folder}-state", n_max=MODEL.n_max, drop_urls=MODEL.drop_urls).awaitTermination()
    return rounded(ingest.train_at(spark, folder, "lang", settings=MODEL), "weight")


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.report(scores(spark, sf_dir), "doc_id", "lang"), "cosine", "percent")


def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.ranks(scores(spark, sf_dir), "doc_id", "lang"), "cosine")


def top_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rank(spark, sf_dir).where("place = 1").drop("place")


def residual_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.residual(scoring.report(scores(spark, sf_dir), "doc_id", "lang", threshold=30), "doc_id"), "percent")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the language that the model finds."""
    best = scoring.ranks(scores(spark, sf_dir), "doc_id", "lang").where("place = 1").withColumnRenamed("lang", "guess")
    return rounded(scoring.evaluate(best, documents(spark, sf_dir), "doc_id", "guess", "lang"), "precision", "recall")


def numbered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = joined(documents(spark, sf_dir), "lang")
    bags = counts.document_bags(docs, "doc_id", n_max=MODEL.n_max, joined=True)
    found = scoring.cosine_scores(bags, train(with_class_id(docs, "lang"), "class_id", settings=MODEL, joined=True), "doc_id", "class_id")
    return scoring.report(found, "doc_id", "class_id", names=NAMES)


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth class has no name here and shows its number."""
    return numbered_report(spark, sf_dir).select("doc_id", "class_id", "class_name")


def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.as_json(numbered_report(spark, sf_dir), "doc_id", "class_id")


def classify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: trains by language with trigrams and URLs dropped, and reports each document's shares."""
    docs = counts.joined_texts(documents(spark, sf_dir), "doc_id", "lang")
    return rounded(classify(docs, train(docs, "lang", joined=True), "doc_id", "lang", joined=True), "cosine", "percent")


def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"), F.char_length(text.limit_text(F.col("text"))).alias("limited"))


def percent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.percent_text(F.col("value")).alias("shown"))


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with class numbers, written as text to the shared folder and read again."""
    docs = with_class_id(documents(spark, sf_dir), "lang")
    names = distinct_classes(documents(spark, sf_dir), "lang")
    path = f"{scratch_folder(spark)}/{models.ModelName('tfidf', 2, 'd1').path('model')}"
    models.write_tsv(train(docs, "class_id", settings=MODEL), path, names)
    return rounded(models.check_unique(models.read_tsv(spark, path, width=len(names))), "weight")


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_windows(table(spark, sf_dir, "events"), "user_id", "ts", Limits(interval=600.0))


def request_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rate limiter makes of the whole table."""
    return request_outcomes(table(spark, sf_dir, "events"), "user_id", "ts", limits=BAN)


BAN = Limits(interval=600.0, requests=3, ban=1200.0)
#: A week and three days, so that keys of the table are banned.
LONG_BAN = Limits(interval=604_800.0, requests=3, ban=259_200.0)


def banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, since): the times at which a request was answered with a ban, in microseconds."""
    found = request_outcomes(table(spark, sf_dir, "events"), "user_id", "ts", limits=LONG_BAN).where("outcome = 'banned'")
    return keep(found.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("since")))


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def requests_in_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bans of its key, the time of each until its own end, a later request falls into."""
    span = int(LONG_BAN.ban + 1) * 1_000_000
    bans = banned(spark, sf_dir).select("key", (F.col("since") + 1).alias("begin"), (F.col("since") + span).alias("end"))
    found = intervals.covering(keyed_events(spark, sf_dir), "us", bans, "begin", "end", ["key"], span)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("bans"))


def last_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the last ban of its key up to then, or with -1."""
    found = intervals.valid_at(keyed_events(spark, sf_dir), "us", banned(spark, sf_dir), "since", ["key"])
    return found.select("event_id", F.coalesce("since", F.lit(-1)).alias("since"))


def request_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's requests with less than six hours between two of them."""
    return sessions.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 21_600)


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with all purchases of its user in the day after it, or with -1."""
    events = table(spark, sf_dir, "events")
    clicks, bought = events.where("event_type = 'click'"), events.where("event_type = 'purchase'")
    found = sessions.answered(clicks, bought, ("user_id", "user_id"), ("event_id", "event_id"), ("ts", "ts"), 86_400)
    return found.select("key", "request", "at", F.coalesce("answer", F.lit(-1)).alias("answer"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        classify_report, tokens, tokens_conversations, tokens_benchmark, tokens_no_urls, urls_extract, tf_by_class, tf_merged, class_lengths, average_length,
        tf_cut_in_order, vocabulary, term_frequencies, weights_tfidf, weights_bm25, weights_r_tfidf, weights_informative, weights_dense, weights_by_quality,
        one_dimension_tfidf, class_norms, dot_products, cosine_scores, score_report, score_rank, top_class, residual_share, evaluation,
        class_names, json_result, text_preview, percent_text, model_round_trip, request_counts, request_bans, requests_in_bans, last_ban,
        request_sessions, request_answers, model_streamed, cosine_scores_stored, top_terms, totals_cube, sketch_errors)
} | {"tf_unigram": bags(1), "tf_ngram_2": bags(2), "tf_ngram_3": bags(3), "tf_ngram_4": bags(4), "tf_cut_d1": cut_counts("d1"), "tf_cut_d2": cut_counts("d2")}

"""Sessions, answers and counts of streams, against plain Python and against the batch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators import counts, scoring
from wordloom.plans.training import Settings, train
from wordloom.sources import models
from wordloom.streaming import ingest, sessions

GAP = 10


def plain_sessions(rows, gap=GAP):
    """(key, begin, end, number) of (key, time)."""
    out = []
    for key in {k for k, t in rows if None not in (k, t)}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        run = times[:1]
        for t in times[1:]:
            if t - run[-1] > gap:
                out.append((key, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(t)
        out.append((key, run[0], run[-1] + gap, len(run)))
    return Counter(out)


def seconds(df, *names):
    return df.withColumns({n: (F.unix_micros(n) / 1e6) for n in names})


def table(spark, rows, id=False):
    df = spark.createDataFrame([(k, None if t is None else round(t * 1e6), i) for i, (k, t) in enumerate(rows)], "k string, us long, i long")
    return df.select("k", F.timestamp_micros("us").alias("t"), *(["i"] if id else []))


def found_sessions(df):
    return Counter((r["k"], r["begin"], r["end"], r["requests"]) for r in seconds(df, "begin", "end").collect())


def test_sessions_of_a_table(spark):
    """Times just the gap apart, just above it, repeated, before 1970, one key with most rows, nulls."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, *range(-3_000, 3_000)])) for _ in range(900)]
    rows += [("edge", 100.0), ("edge", 110.0), ("edge", 120.000001), ("edge", 120.000001)]
    found = found_sessions(sessions.sessions(table(spark, rows), "k", "t", GAP))
    assert found == plain_sessions(rows) and ("edge", 100.0, 120.0, 2) in found
    assert sessions.sessions(table(spark, rows).limit(0), "k", "t", GAP).count() == 0


def batches(spark, tmp_path, parts, run, **more):
    """Runs `run(stream)` over one file for each part and gives the rows of all of them, with the query."""
    query = None
    for n, part in enumerate(parts):
        table(spark, part, **more).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, t timestamp" + (", i long" if more else "")).parquet(f"{tmp_path}/in")
        query = run(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        yield n, query, spark.read.parquet(f"{tmp_path}/out")


def test_sessions_of_a_stream(spark, tmp_path):
    """Three micro-batches in mixed order: a session is output once the watermark has passed its end, and what is later is dropped and counted."""
    parts = [[("a", 100.0), ("a", 110.0), ("b", 105.0), ("a", 140.0), (None, 1.0)],
             [("b", 96.0), ("a", 121.5), ("a", 135.0), ("c", 200.0)],  # before the latest time less 60 s is nothing yet
             [("a", 100.0), ("a", 130.0), ("a", 132.0), ("c", 330.0), ("b", 199.0)]]  # 100 and 130 would end by 200 - 60, 132 would not
    out = {}
    for n, query, found in batches(spark, tmp_path, parts, lambda s: sessions.sessions(s, "k", "t", GAP, "60 seconds")):
        out[n] = (found_sessions(found), sessions.dropped(query))
    on_time = [*parts[0], *parts[1], *parts[2][2:]]
    whole = plain_sessions(on_time)
    assert out[0] == (Counter(), 0)
    assert out[1][0] == Counter({s: c for s, c in whole.items() if s[2] <= 140}) and out[1][1] == 0
    assert out[2][0] == Counter({s: c for s, c in whole.items() if s[2] <= 270}) and out[2][1] == 2


def plain_answers(asked, given, within):
    out = []
    for i, (k, t) in enumerate(asked):
        hits = [j for j, (k2, t2) in enumerate(given) if None not in (k, t, t2) and k == k2 and t <= t2 <= t + within]
        out += [(k, i, j) for j in hits] or [(k, i, None)]
    return Counter(out)


def test_answers_of_tables(spark):
    rng = random.Random(4)
    draw = lambda n: [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, *range(-200, 900)])) for _ in range(n)]
    asked, given = [*draw(300), ("x", 0.0), ("x", 5.0)], [*draw(200), ("x", 10.0), ("x", 10.0), ("x", 15.000001)]
    found = sessions.answered(table(spark, asked, id=True), table(spark, given, id=True), ("k", "k"), ("i", "i"), ("t", "t"), 10)
    assert Counter((r["key"], r["request"], r["answer"]) for r in found.collect()) == plain_answers(asked, given, 10)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("key is null").count() == sum(k is None for k, _ in asked)


def test_answers_of_streams(spark, tmp_path):
    """Requests and answers from two streams over three micro-batches: an unanswered request is output when its last moment has passed the watermark."""
    asked = [[("a", 100.0), ("b", 100.0)], [("a", 300.0), ("b", 95.0)], [("a", 50.0), ("c", 500.0)]]
    given = [[("a", 104.0), ("c", 101.0)], [("b", 99.0), ("a", 300.0), ("a", 310.0)], [("b", 102.0), ("c", 500.0)]]
    ids, seen, late = {"q": 0, "a": 0}, [], 0
    for part in range(3):
        for side, rows in (("q", asked[part]), ("a", given[part])):
            df = table(spark, rows, id=True).withColumn("i", F.col("i") + ids[side])
            ids[side] += len(rows)
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}")
        q, a = (spark.readStream.schema("k string, t timestamp, i long").parquet(f"{tmp_path}/{s}") for s in "qa")
        query = (sessions.answered(q, a, ("k", "k"), ("i", "i"), ("t", "t"), 10, "30 seconds").writeStream.format("parquet")
                 .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out"))
        query.awaitTermination()
        late += sessions.dropped(query)
        seen.append(Counter((r["key"], r["request"], r["answer"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    # Of the third part, a's request at 50 and b's answer at 102 (two rows, one for each bin) are before 300 - 30.
    every = plain_answers([r for p in asked for r in p], [("gone", 0.0) if r == ("b", 102.0) else r for p in given for r in p], 10)
    del every["a", 4, None]
    assert seen[0] == Counter({("a", 0, 0): 1})
    assert seen[2] == every and late == 3


DOCS = [("x", "cat cat dog bird"), ("y", "dog fish fish"), ("x", None), ("z", ""), (None, "lost"), ("y", "cat fish dog dog"), ("x", "cat cat dog bird"), ("w", "bird 12 owl"), ("y", "owl")]


def test_counts_of_a_stream(spark, tmp_path):
    """After each micro-batch, counts and model are those of the batch over all documents so far; old versions stay, also when compacted, and a restart goes on."""
    path, done = f"{tmp_path}/counts", []
    for n in range(3):
        part = DOCS[3 * n:3 * n + 3]
        done += part
        spark.createDataFrame(part, "c string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("c string, text string").parquet(f"{tmp_path}/in")
        ingest.ingest(stream, "c", path, f"{tmp_path}/state", n_max=2).awaitTermination()
        whole = spark.createDataFrame(done, "c string, text string")
        want = counts.class_counts(whole.where("c is not null"), "c", n_max=2)
        assert Counter(map(tuple, ingest.counts_at(spark, path, "c").where("n > 0").collect())) == Counter(map(tuple, want.collect()))
        for method in ("tfidf", "bm25", "r_tfidf"):
            own = Settings(method, 2, "d1")
            found, expected = ({(r["term"], r["c"]): r["weight"] for r in m.collect()} for m in (ingest.train_at(spark, path, "c", settings=own), train(whole, "c", settings=own)))
            assert found == pytest.approx(expected, abs=1e-6) and (found or n < 2)
    known = ingest.versions(spark, path)
    assert len(known) == 3
    before = [Counter(map(tuple, ingest.counts_at(spark, path, "c", v).collect())) for v in known]
    assert ingest.compact(spark, path, "c", known[1]) == known[1]
    assert [Counter(map(tuple, ingest.counts_at(spark, path, "c", v).collect())) for v in known] == before
    assert f"changes/version={known[0]}" not in " ".join(ingest.counts_at(spark, path, "c").inputFiles())
    with pytest.raises(ValueError, match="no version 99"):
        ingest.counts_at(spark, path, "c", 99)


def test_a_version_that_is_written_again(spark, tmp_path):
    """A batch that failed while it was written is no version; written again, it counts once."""
    spark.createDataFrame([("x", 1, "A", 5)], "c string, n int, term string, cnt long").write.parquet(f"{tmp_path}/changes/version=0")
    spark.createDataFrame([("x", 1, "A", 7)], "c string, n int, term string, cnt long").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/changes/version=1")
    assert ingest.versions(spark, tmp_path) == [0]
    spark.createDataFrame([("x", 1, "A", 7)], "c string, n int, term string, cnt long").write.mode("overwrite").parquet(f"{tmp_path}/changes/version=1")
    assert [tuple(r) for r in ingest.counts_at(spark, tmp_path, "c").collect()] == [("x", 1, "A", 12)]


def test_a_stored_model_does_not_move(spark, sf_dir, tmp_path):
    """Scores are those of the broadcast model; the only exchange of terms is that of the bags."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, "lang", settings=Settings(n_max=1, drop_urls=False))
    models.write_buckets(model, "stored_model", path=f"{tmp_path}/model")
    try:
        bags = counts.document_bags(docs, "doc_id", drop_urls=False)
        sent, still = scoring.cosine_scores(bags, model, "doc_id", "lang"), scoring.cosine_scores(bags, models.read_buckets(spark, "stored_model"), "doc_id", "lang", most_sent=0)
        a, b = ({(r["doc_id"], r["lang"]): r["cosine"] for r in s.collect()} for s in (sent, still))
        assert a == pytest.approx(b) and a
        plans = [s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0] for s in (sent, still)]
        assert plans[0].count("hashpartitioning(term") == 1 and "BroadcastHashJoin [term" in plans[0]  # the model's, for its first classes
        assert plans[1].count("hashpartitioning(term") == 1 and "SortMergeJoin [term" in plans[1] and "Bucketed: true" in plans[1]
    finally:
        spark.sql("DROP TABLE IF EXISTS stored_model")

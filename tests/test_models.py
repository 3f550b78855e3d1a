import os
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import counts, frequent, scoring, weights
from wordloom.plans import queries, training
from wordloom.plans.training import Settings, classify, grid, train, train_grid
from wordloom.sources import corpus, models, scratch, tables
from wordloom.streaming.classify import classify_stream
from wordloom.streaming.ratelimit import Limits, in_blocks, rate_limit, request_outcomes, request_windows, step

PLAIN = Settings(n_max=1, cut="d0")


@pytest.fixture
def toy(spark):
    return spark.createDataFrame([(0, "cat cat dog"), (1, "dog fish"), (None, "bird")], "c int, text string")


def table(df, *keys):
    return {tuple(r[k] for k in keys): r[df.columns[-1]] for r in df.collect()}


@pytest.mark.parametrize(("method", "want"), [
    ("tfidf", {("CAT", 0): 0.693147, ("FISH", 1): 0.346574}),
    ("bm25", {("DOG", 0): -1.463125, ("DOG", 1): -1.788264}),
    ("r_tfidf", {("CAT", 0): 0.234472, ("CAT", 1): 0.693147, ("FISH", 0): 0.693147, ("FISH", 1): -0.239605})])
def test_toy_weights(toy, method, want):
    got = table(train(toy, "c", settings=Settings(method, 1, "d0")), "term", "c")
    assert {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} == got


def test_toy_scores(spark, toy):
    model = train(toy, "c", settings=PLAIN)
    docs = spark.createDataFrame([(1, "cat fish"), (2, "cat cat bird"), (3, "bird"), (4, None)], "d int, text string")
    scores = scoring.cosine_scores(counts.document_bags(docs, "d"), model, "d", "c")
    assert table(scores, "d", "c") == {(1, 0): pytest.approx(0.707107, abs=1e-6), (1, 1): pytest.approx(0.707107, abs=1e-6), (2, 0): pytest.approx(0.894427, abs=1e-6)}
    assert table(scoring.report(scores, "d", "c"), "d", "c") == {(1, 0): pytest.approx(50), (1, 1): pytest.approx(50), (2, 0): pytest.approx(100)}
    assert [r["c"] for r in scoring.ranks(scores, "d", "c").where("d = 1").orderBy("place").collect()] == [0, 1]


@pytest.mark.parametrize(("percents", "want"), [((50,), {"A"}), ((95,), {"A", "B", "C"})])
def test_mass_cut(spark, monkeypatch, percents, want):
    monkeypatch.setitem(counts.CUT_PERCENTS, "own", percents)
    rows = spark.createDataFrame([(0, 1, "A", 3), (0, 1, "B", 2), (0, 1, "C", 2), (0, 1, "D", 1)], "c int, n int, term string, cnt long")
    assert {r["term"] for r in counts.cut_by_mass(rows, "c", "own").collect()} == want


@pytest.mark.parametrize("cut", ["d1", "d2"])
def test_mass_cut_of_one_beginning(spark, cut):
    """A class whose rare terms all begin alike; ranges share them, and what is kept is the same as in one sort."""
    rows = [(c, n, f"THE SAME BEGINNING {k:04d}", 1 + (k % 97 == 0)) for c in (0, 1) for n in (1, 2, 3, 4) for k in range(700 * (c + 1))]
    got = {tuple(r)[:3] for r in counts.cut_by_mass(spark.createDataFrame(rows, "c int, n int, term string, cnt long"), "c", cut).collect()}
    want = set()
    for c in (0, 1):
        for n in (1, 2, 3, 4):
            own = sorted((-k, t) for x, m, t, k in rows if (x, m) == (c, n))
            limit, running = np.float32(np.float32(-sum(k for k, _ in own)) * np.float32(counts.CUT_PERCENTS[cut][n - 1])) / np.float32(100), 0
            for k, t in own:
                running -= k
                if np.float32(running) > limit:
                    break
                want.add((c, n, t))
    assert got == want
    kept = counts.cut_by_mass(spark.createDataFrame(rows, "c int, n int, term string, cnt long"), "c", cut)
    assert "collect_list" not in kept._jdf.queryExecution().toString()


def test_cut_in_given_order(spark, monkeypatch):
    monkeypatch.setitem(counts.CUT_PERCENTS, "own", (50,))
    rows = spark.createDataFrame([(0, 1, "A", 3, 4), (0, 1, "B", 2, 1), (0, 1, "C", 2, 2), (0, 1, "D", 1, 3), (1, 1, "A", 5, 1), (1, 1, "B", 5, 1)], "c int, n int, term string, cnt long, place int")
    assert {(r["c"], r["term"]) for r in counts.cut_in_order(rows, "c", "own", "place").collect()} == {(0, "B"), (0, "C"), (1, "A")}
    assert counts.cut_in_order(rows, "c", "d0", "place").count() == 6


def test_grid(spark):
    """All 36 models, each the same as one trained by itself."""
    texts = [(c, " ".join(f"w{(k * (c + 3)) % (11 + c)}" for k in range(60))) for c in (0, 1, 2) for _ in range(2)]
    docs = spark.createDataFrame(texts, "c int, text string")
    models_of = {s: table(m, "term", "c") for s, m in train_grid(docs, "c")}
    assert list(models_of) == grid() and len(models_of) == 36
    assert sum(bool(m) for m in models_of.values()) >= 24
    for s in (Settings("tfidf", 1, "d0"), Settings("bm25", 2, "d1"), Settings("r_tfidf", 3, "d2"), Settings("bm25", 4, "d0")):
        assert models_of[s] == table(train(docs, "c", settings=s), "term", "c")


def test_lengths_from_counts(spark):
    docs = spark.createDataFrame([(0, "a b c"), (0, "d"), (1, "- -"), (2, None), (None, "x y")], "c int, text string")
    found = counts.lengths_of(counts.class_counts(docs, "c", n_max=2), [0, 1, 2], "c")
    assert table(found, "c") == {(0,): 4, (1,): 0, (2,): 0}
    assert {k: v for k, v in table(counts.class_lengths(docs, "c"), "c").items() if k[0] is not None} == table(found, "c")


def test_classify_with_urls_dropped(spark, sf_dir):
    """The flagship's report, made again from words and counts in plain Python."""
    from tests.test_text import spec, twin
    from wordloom.functions import urls

    domains, schemes = ({x.upper() for x in v} for v in (urls.TOP_LEVEL_DOMAINS, urls.SCHEMES))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 0")
    by_doc, by_class = {}, {}
    for r in docs.collect():
        text = r["text"] or ""
        for a, b in reversed(twin(text, domains, schemes)):
            text = text[:a] + "\1" * (b - a) + text[b:]
        words = spec(re.sub("\1+", "\n", text))
        levels = [Counter(" ".join(words[i:i + n]) for i in range(len(words) - n + 1)) for n in (1, 2, 3)]
        by_doc[r["doc_id"]] = sum(levels, Counter())
        if r["lang"] is not None:
            for k, level in enumerate(levels):
                by_class.setdefault(r["lang"], [Counter(), Counter(), Counter()])[k].update(level)
    f32, bags = np.float32, {}
    for c, levels in by_class.items():
        bags[c] = Counter()
        for percent, level in zip((95, 50, 15), levels, strict=True):
            limit, running = f32(f32(sum(level.values())) * f32(percent)) / f32(100), 0
            for t, k in sorted(level.items(), key=lambda x: (-x[1], x[0].encode())):
                running += k
                if f32(running) > limit:
                    break
                bags[c][t] += k
    df = Counter(t for b in bags.values() for t in b)
    model = {c: {t: float(f32(-f32(f32(k) / f32(len(b))) * f32(np.log(f32(f32(df[t]) / f32(len(bags))))))) for t, k in b.items() if df[t] < len(bags)} for c, b in bags.items()}
    want = {}
    for i, bag in by_doc.items():
        dots = {c: sum(w[t] * k for t, k in bag.items() if t in w) for c, w in model.items()}
        cosines = {c: d / (sum(x * x for x in model[c].values()) * sum(k * k for k in bag.values())) ** 0.5 for c, d in dots.items() if d}
        want |= {(i, c): 100 * x / sum(cosines.values()) for c, x in cosines.items()}
    got = table(classify(docs, train(docs, "lang"), "doc_id", "lang").select("doc_id", "lang", "percent"), "doc_id", "lang")
    clear = {k for k, v in want.items() if abs(v - 10) > 1e-3}
    assert {k for k in got if k in clear} == {k for k in clear if want[k] > 10} and len(got) > 50
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in got)


def test_texts_are_read_once(spark, sf_dir):
    """One tokenizer pass for training, which is kept, and one for scoring."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = classify(docs, train(docs, "lang"), "doc_id", "lang")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2 and plan.count("documents.parquet") <= 2  # one node names it once or twice


def test_one_class_has_no_model(spark):
    assert train(spark.createDataFrame([(0, "cat dog")], "c int, text string"), "c", settings=PLAIN).count() == 0
    assert train(spark.createDataFrame([], "c int, text string"), "c", settings=PLAIN).count() == 0


def test_model_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿#\t'x'\t'y'\ncat\t1E-05\t-0\nX\t1\nдЁрн \t2.5\t3 \n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("dog\t1\t2\n# end\nwide\t1\t2\t3\n", encoding="utf-8")
    got = table(models.read_tsv(spark, f"{tmp_path}/a.txt; {tmp_path}/b.txt"), "term", "class_id")
    assert got == {("CAT", 0): pytest.approx(1e-5), ("CAT", 1): 0, ("ДЕРН", 0): 2.5, ("ДЕРН", 1): 3, ("DOG", 0): 1, ("DOG", 1): 2}
    assert models.skipped_lines(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"], 2) == 2
    twice = spark.createDataFrame([("A", 0, 1.0), ("A", 0, 2.0)], "term string, class_id int, weight float")
    with pytest.raises(Exception, match="repeated term"):
        models.check_unique(twice).collect()


def test_class_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("cat", encoding="utf-8")
    (tmp_path / "two.txt").write_text(" \n", encoding="utf-8")
    names = corpus.parse_class_list(" one.txt ;; two.txt;")
    assert names == ["one.txt", "two.txt"]
    assert [tuple(r) for r in corpus.read_class_files(spark, str(tmp_path), names[:1]).collect()] == [(0, "one.txt", "cat")]
    with pytest.raises(Exception, match="blank class text"):
        corpus.read_class_files(spark, str(tmp_path), names).collect()
    assert corpus.scan_directory(spark, str(tmp_path)).count() == 2


def test_stream_gives_the_batch_result(spark, toy, tmp_path):
    model = train(toy, "c", settings=PLAIN)
    spark.createDataFrame([(1, "cat fish"), (2, "cat")], "d int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("d int, text string").parquet(f"{tmp_path}/in")
    sink = lambda report, batch: report.write.mode("append").parquet(f"{tmp_path}/out")
    classify_stream(stream, model, sink, f"{tmp_path}/state", "d", "c", settings=PLAIN).awaitTermination()
    assert {(r["d"], r["c"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 0), (1, 1), (2, 0)}


def test_rate_limiter_steps():
    limits, entry, seen = Limits(10.0, 3, 120.0), None, []
    for t in (0.0, 0.2, 0.5, 1.0, 50.0, 168.5):
        outcome, _, entry = step(entry, t, limits)
        seen.append(outcome)
    assert seen == ["admitted", "admitted", "admitted", "banned", "banned", "waited"]
    assert step(entry, 400.0, limits)[0] == "admitted"


def request_rows(spark):
    """Keys with few and many requests, dense and sparse, over several Arrow batches; 0 has most of them, in no order."""
    rng = np.random.default_rng(7)
    times = {0: np.cumsum(rng.integers(0, 9_000_000, 25_000)), 1: rng.integers(0, 5_000_000, 12_000), 2: np.arange(300) * 10_000_000, 3: np.array([5]), 4: np.zeros(11_000, int), 5: (np.arange(20)[:, None] * 100_000_000 + np.array([0, 1, 2, 9]) * 1_000_000).ravel()}
    times = {k: x + 1_600_000_000_000_000 for k, x in times.items()}  # a stream drops what is not after its first watermark, 1970
    rows = [(k, int(t)) for k, x in times.items() for t in rng.permutation(x)] + [(None, 1), (1, None)]
    return times, spark.createDataFrame(rows, "k long, us long").select("k", F.timestamp_micros("us").alias("t"))


def test_request_windows_stream_over_rows(spark):
    times, requests = request_rows(spark)
    expected = Counter()
    for k, x in times.items():
        opened = None
        for t in map(int, sorted(x)):
            opened = t if opened is None or t >= opened + 10_000_000 else opened
            expected[k, opened] += 1
    windows = request_windows(requests, "k", "t")
    assert {(r["k"], r["us"]): r["requests"] for r in windows.withColumn("us", F.unix_micros("opened")).collect()} == expected
    assert "collect_list" not in windows._jdf.queryExecution().toString()  # no key is gathered


def test_request_outcomes_are_those_of_the_stream(spark, tmp_path):
    _, requests = request_rows(spark)
    requests.write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in/*")
    rate_limit(stream, "k", "t").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out")
    outcomes = request_outcomes(requests, "k", "t")
    assert Counter(map(tuple, outcomes.collect())) == Counter(map(tuple, streamed.collect()))
    assert outcomes.count() == requests.dropna().count()


def plain_outcomes(times, limits):
    """The same rules written out by the clock: a window counts, a ban starts anew with each request, a short rest is waited for."""
    out, window, ban, after = [], None, None, None  # starts; window: [start, count, end]
    for t in times:
        if ban is not None and t >= ban[1]:
            ban = window = None
        if ban is None and window is not None and t >= window[2]:
            window = None
        if ban is None and window is None:
            window = [t, 1, t + limits.interval]
            out.append(("admitted", 0.0))
            continue
        if ban is None and window[1] < limits.requests:
            window[1] += 1
            out.append(("admitted", 0.0))
            continue
        rest = limits.ban - (t - ban[0]) if ban is not None else limits.interval - (t - window[0]) + 1.0
        if rest > 3:
            ban = (t, t + limits.ban + 1)
            out.append(("banned", limits.ban))
        else:
            wait = max(1.0, rest)
            ban, window = None, [t + wait, 1, t + wait + limits.interval]
            out.append(("waited", wait))
    return out


def test_request_bans_match_plain_python(spark, sf_dir):
    by_key = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect():
        by_key.setdefault(str(r["user_id"]), []).append(r["us"])
    want = Counter()
    for key, times in by_key.items():
        for us, (outcome, wait) in zip(sorted(times), plain_outcomes([t / 1e6 for t in sorted(times)], Limits(600.0, 3, 1200.0)), strict=True):
            want[key, us, outcome, wait] += 1
    got = queries.request_bans(spark, sf_dir).select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "outcome", "wait")
    assert Counter(map(tuple, got.collect())) == want
    # Denser requests, with all outcomes.
    times, requests = request_rows(spark)
    want = Counter()
    for key, x in times.items():
        for us, (outcome, wait) in zip(np.sort(x).tolist(), plain_outcomes((np.sort(x) / 1e6).tolist(), Limits()), strict=True):
            want[str(key), us, outcome, wait] += 1
    got = request_outcomes(requests, "k", "t").select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "outcome", "wait")
    assert Counter(map(tuple, got.collect())) == want and {k[2] for k in want} == {"admitted", "banned", "waited"}


def test_one_key_in_all_blocks(spark):
    """A dense key with bursts, rests and ties lies in every block: windows longer than a block and shorter ones, bans that go on across blocks."""
    rng = np.random.default_rng(3)
    steps = np.where(rng.random(40_000) < 0.001, 200_000_000, rng.integers(0, 1_500_000, 40_000) * (rng.random(40_000) < 0.7))
    us = 1_600_000_000_000_000 + np.cumsum(steps)
    requests = spark.createDataFrame([(None if i % 9_999 == 0 else "k", int(t)) for i, t in enumerate(rng.permutation(us))], "k string, us long").select("k", F.timestamp_micros("us").alias("t"))
    kept = sorted(r["us"] for r in requests.where("k is not null").select(F.unix_micros("t").alias("us")).collect())
    for limits in (Limits(10.0, 3, 120.0), Limits(3_600.0, 100, 30.0), Limits(1_000_000.0, 2, 5.0), Limits(0.5, 1, 2.0)):
        blocks = in_blocks(requests.where("k is not null"), F.col("k"), "t")
        assert blocks.select("_block").distinct().count() == 8
        want, opened = Counter(), None
        for t in kept:
            opened = t if opened is None or t >= opened + round(limits.interval * 1e6) else opened
            want[opened] += 1
        assert {r["us"]: r["requests"] for r in request_windows(requests, "k", "t", limits).withColumn("us", F.unix_micros("opened")).collect()} == want
        got = request_outcomes(requests, "k", "t", limits=limits).select(F.unix_micros("at").alias("us"), "outcome", "wait").collect()
        told = plain_outcomes([t / 1e6 for t in kept], limits)
        assert Counter(map(tuple, got)) == Counter((t, *o) for t, o in zip(kept, told, strict=True))


def test_idle_has_to_exceed_the_ban(spark):
    requests = spark.createDataFrame([], "k string, t timestamp")
    for limits, idle in ((Limits(ban=7_200.0), 3_600.0), (Limits(interval=600.0), 600.0)):
        with pytest.raises(ValueError, match="idle"):
            rate_limit(requests, "k", "t", limits=limits, idle=idle)


def test_kept_tables_can_be_dropped(spark):
    before = len(scratch.KEPT.get(spark.sparkContext.applicationId, []))
    table = scratch.keep(spark.range(5))
    path = scratch.KEPT[spark.sparkContext.applicationId][-1]
    assert table.count() == 5 and os.path.isdir(path)
    assert scratch.forget(spark, since=before) == 1 and not os.path.exists(path)
    assert len(scratch.KEPT[spark.sparkContext.applicationId]) == before


def test_late_requests_are_judged_too(spark, tmp_path):
    """Files in mixed order, each a micro-batch: every request comes out once, the late ones by their key's entry of then."""
    files = [[100, 101, 102, 103], [500, 501], [90, 91, 92, 502], [10, 600, 100]]
    for k, times in enumerate(files):
        spark.createDataFrame([("a", t * 1_000_000) for t in times] + [("b", t * 1_000_000 + 7) for t in times], "k string, us long").select(
            "k", F.timestamp_micros("us").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files go by their time of change
    stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rate_limit(stream, "k", "t").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("key", F.unix_micros("at").alias("us"), "outcome", "wait").collect()
    want = Counter()
    for key, more in (("a", 0), ("b", 7)):
        own = [t * 1_000_000 + more for times in files for t in sorted(times)]
        judged = np.maximum.accumulate(own) / 1e6
        for us, (outcome, wait) in zip(own, plain_outcomes(judged.tolist(), Limits()), strict=True):
            want[key, us, outcome, wait] += 1
    assert len(got) == 2 * sum(map(len, files)) and Counter(map(tuple, got)) == want


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    """No folder of one machine stands in for the shared one."""
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, key, default: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_folder(Session())


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert tables.read_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SMALL", 1)
    assert tables.read_table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 1


def test_class_ids_and_their_bound(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z"), ("b", "w")], "lang string, text string")
    assert sorted((r["lang"], r["class_id"]) for r in corpus.with_class_id(docs, "lang").collect()) == [("a", 0), ("b", 1), ("b", 1)]
    assert corpus.with_class_id(docs.limit(0), "lang").count() == 0
    with pytest.raises(ValueError, match="too many classes"):
        corpus.distinct_classes(spark.range(10_001), "id")


def test_absent_terms_are_zero(spark):
    w = spark.createDataFrame([("A", 0, 1.0), ("B", 0, 2.0), ("B", 1, 2.0)], "term string, c int, weight float")
    assert table(weights.dense(w, [0, 1], "c"), "term", "c")["A", 1] == 0
    assert {r["term"] for r in weights.informative(w, "c", 2).collect()} == {"A"}


@pytest.fixture
def no_broadcast_by_size(spark):
    """As with tables that are too large: only what is marked is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_cut_exchanges_no_counts(spark, no_broadcast_by_size):
    """One row for each class and n says what is reached: all counts of 1 are no key of a join."""
    rows = spark.createDataFrame([(0, 1, "A", 3), (0, 1, "B", 2), (0, 1, "C", 2), (0, 1, "D", 1), (1, 2, "A B", 1), (1, 2, "C D", 1)], "c int, n int, term string, cnt long")
    kept = counts.cut_by_mass(rows, "c", "d1")
    assert sorted(map(tuple, kept.collect())) == [(0, 1, "A", 3), (0, 1, "B", 2), (0, 1, "C", 2), (1, 2, "A B", 1)]
    assert "SortMergeJoin" not in plan_of(kept)


def test_weights_exchange_bags_once(spark, no_broadcast_by_size):
    """Sizes of classes are sent; terms meet by one exchange for all that is asked of them."""
    bags = spark.createDataFrame([(0, "A", 3), (0, "B", 1), (1, "B", 2)], "c int, term string, cnt long")
    lengths = spark.createDataFrame([(0, 4), (1, 2)], "c int, length long")
    for found in (weights.tfidf(bags, "c", 2), weights.bm25(bags, lengths, "c", 2)):
        left = weights.informative(found, "c", 2)
        assert {r["term"] for r in left.collect()} <= {"A", "B"}
        assert plan_of(left).split("== Initial Plan ==")[0].count("hashpartitioning(term") == 1 and "SortMergeJoin" not in plan_of(left)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_grams_are_compiled(spark, n):
    """All n-grams of short and longer texts, made without a lambda for each of them."""
    docs = spark.createDataFrame([(0, "a b c d e"), (0, "a b"), (1, ""), (1, None), (0, "- a")], "c int, text string")
    found = counts.class_counts(docs, "c", n_max=n, drop_urls=False)
    want = Counter((0, m, " ".join(words[i:i + m])) for words in ("ABCDE", "AB", "A") for m in range(1, n + 1) for i in range(len(words) - m + 1))
    assert {tuple(r)[:3]: r["cnt"] for r in found.collect()} == want
    assert "array_join(slice" not in plan_of(found) and "array_join(slice" not in plan_of(counts.document_bags(docs, "c", n_max=n, drop_urls=False))


def test_words_are_cut_once_for_model_and_scores(spark, sf_dir):
    """Training and scoring read the same joined words, with and without URLs; results are those of texts that are cut twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0")
    for drop_urls in (True, False):
        settings = Settings(n_max=2, drop_urls=drop_urls)
        ready = counts.joined_texts(docs, "doc_id", "lang", drop_urls=drop_urls)
        once = classify(ready, train(ready, "lang", settings=settings, joined=True), "doc_id", "lang", settings=settings, joined=True)
        twice = classify(docs, train(docs, "lang", settings=settings), "doc_id", "lang", settings=settings)
        got, want = (table(x.select("doc_id", "lang", "percent"), "doc_id", "lang") for x in (once, twice))
        assert got == pytest.approx(want) and got
    for query in (queries.classify_report, queries.cosine_scores, queries.json_result):
        assert "regexp_replace" not in plan_of(query(spark, sf_dir)) and "regexp_extract_all" not in plan_of(query(spark, sf_dir))


def test_model_is_sent_by_numbers(spark, toy):
    """The broadcast has a long for its key, which takes less room than the term; equal numbers of unlike terms would not join."""
    model = train(toy, "c", settings=PLAIN)
    bags = counts.document_bags(spark.createDataFrame([(1, "cat fish"), (2, "bird")], "d int, text string"), "d")
    met = scoring.meet(bags, model, "left")
    assert sorted((r["d"], r["term"], r["c"]) for r in met.collect()) == [(1, "CAT", 0), (1, "FISH", 1), (2, "BIRD", None)]
    assert re.search(r"BroadcastHashJoin \[term_number#\d+L?\], \[_number#\d+L?\]", plan_of(met))
    assert scoring.MOST_SENT <= scoring.most_weights(spark) <= scoring.MOST_EVER


def test_unknown_terms_are_not_exchanged(spark):
    """Where bags meet the model by an exchange, a document's unknown terms are one row; scores are those of a broadcast."""
    model = train(spark.createDataFrame([(0, "cat cat dog"), (1, "dog fish")], "c int, text string"), "c", settings=PLAIN)
    texts = [(i, " ".join(["cat"] * (i % 3) + ["fish"] * (i % 2) + [f"w{k}" for k in range(i % 7)] * 2)) for i in range(60)] + [(60, None), (None, "cat w1")]
    bags = counts.document_bags(spark.createDataFrame(texts, "d int, text string"), "d")
    a, b = (table(scoring.cosine_scores(bags, model, "d", "c", most_sent=m), "d", "c") for m in (None, 0))
    assert a == pytest.approx(b) and len(a) > 40
    rows = scoring.met_by_exchange(bags, model, "d", 100)
    assert rows.groupBy("d").agg(F.count_if(F.startswith("term", F.lit(" "))).alias("n")).agg(F.max("n")).collect()[0][0] == 1
    assert table(scoring.met_by_exchange(bags, model, "d", 0).groupBy("d").agg(F.sum("_own")), "d") == table(rows.groupBy("d").agg(F.sum("_own")), "d")


@pytest.mark.parametrize("repeats", [3, 1])
def test_single_counts_are_stored_only_if_asked_for(spark, monkeypatch, repeats):
    """Models and first terms are the same with and without counts of 1; where the cut reaches these, all are stored."""
    texts = [(c, " ".join(f"w{k * k % (7 + len(c))}" for k in range(90)) + " " + " ".join(f"x{c}y{k}" for k in range(30))) for c in ("a", "bb") for _ in range(repeats)]
    texts += [(c, f"{c} once only here") for c in ("a", "bb")] + [("c", None), ("d", " ".join(f"z{k}" for k in range(6))), (None, "not read")]
    docs = counts.joined_texts(spark.createDataFrame(texts, "lang string, text string"), "lang")
    settings, stored = Settings(n_max=3, cut="d2"), []
    want = table(train(docs, "lang", settings=settings, joined=True), "term", "lang")
    monkeypatch.setattr(counts, "MANY_GRAMS", 1)
    monkeypatch.setattr(counts, "repeated_counts", lambda *a, f=counts.repeated_counts: stored.append(f(*a)) or stored[-1])
    assert table(train(docs, "lang", settings=settings, joined=True), "term", "lang") == want and want
    rest, singles = stored[0]
    assert rest.where("n > 1 and cnt = 1").count() == 0
    whole = counts.class_counts(docs.where("lang is not null"), "lang", n_max=3, joined=True)
    ones = {(r["lang"], r["n"]): r["count"] for r in whole.where("n > 1 and cnt = 1").groupBy("lang", "n").count().collect()}
    assert {(r["lang"], r["n"]): r["_k"] for r in singles.collect()} == ones
    cut = counts.cut_by_mass(rest.where("lang = 'a'"), "lang", "d2", singles.where("lang = 'a'"))
    assert cut is not None and cut.count() == counts.cut_by_mass(whole.where("lang = 'a'"), "lang", "d2").count()
    assert counts.cut_by_mass(rest, "lang", "d0") is rest and counts.cut_by_mass(rest, "lang", "d1", singles) is None  # class d has nothing else


def test_joined_texts_are_counted_in_small_parts(spark, sf_dir, monkeypatch):
    """Larger tables are dealt to more tasks than there are shuffle partitions, by their stored size, so that a task's counts fit into memory."""
    docs = counts.joined_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 8 = 0"), "doc_id", "lang", drop_urls=False)
    few = counts.class_counts(docs, "lang", joined=True), counts.document_bags(docs, "doc_id", joined=True)
    want = [table(x, *x.columns[:-1]) for x in few]
    monkeypatch.setattr(counts, "PART_BYTES", 2_000)
    parts = counts.parts_of(docs, 1)
    many = counts.class_counts(docs, "lang", joined=True), counts.document_bags(docs, "doc_id", joined=True)
    assert [table(x, *x.columns[:-1]) for x in many] == want and parts > 8 and counts.parts_of(docs, 3) > 2 * parts
    dealt = rf"artitioning\(([^()]*, )?{parts}\)"
    assert all(re.search(dealt, plan_of(x)) for x in many) and not any(re.search(dealt, plan_of(x)) for x in few)


def test_numbers_of_classes_leave_the_parts(spark, sf_dir, monkeypatch):
    """Texts joined with the numbers of their classes are dealt to as many tasks as without, not to the product of both sizes; the model is that of texts as they are."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 8 = 0")
    docs = counts.joined_texts(plain, "doc_id", "lang", drop_urls=False)
    monkeypatch.setattr(counts, "PART_BYTES", 2_000)
    numbered = corpus.with_class_id(docs, "lang")
    assert 8 < counts.parts_of(docs, 2) == counts.parts_of(numbered, 2) == counts.parts_of(numbered.where("class_id is not null"), 2) < 1_000
    got = table(train(numbered, "class_id", settings=queries.MODEL, joined=True), "term", "class_id")
    assert got == table(train(corpus.with_class_id(plain, "lang"), "class_id", settings=queries.MODEL), "term", "class_id") and got


def test_json_has_the_classes_of_the_report(spark, sf_dir):
    """Both queries number the classes of stored texts; the array of a document holds its rows of the other."""
    arrays = queries.json_result(spark, sf_dir).select("doc_id", F.explode(F.from_json("json", "array<struct<i int, n string, p string>>")).alias("x"))
    got = sorted(map(tuple, arrays.select("doc_id", "x.i", "x.n").collect()))
    assert got == sorted(map(tuple, queries.class_names(spark, sf_dir).collect())) and got


@pytest.mark.parametrize(("method", "cut", "n_max"), [("tfidf", "d1", 3), ("bm25", "d2", 4), ("bm25", "d1", 1)])
def test_rare_grams_are_not_exchanged(spark, monkeypatch, method, cut, n_max):
    """Models are the same if only what the cut may reach is counted one by one; of the others, packed numbers are exchanged and no terms."""
    texts = [(c, " ".join(f"w{k * k % (7 + len(c))}" for k in range(90)) + " " + " ".join(f"x{c}{i}y{k}" for k in range(30))) for c in ("a", "bb") for i in range(6)]
    texts += [("c", None), ("d", " ".join(f"z{k}" for k in range(6))), ("d", "z"), (None, "not read")]
    docs = counts.joined_texts(spark.createDataFrame(texts, "lang string, text string"), "lang")
    settings, stored = Settings(method, n_max, cut), []
    want = table(train(docs, "lang", settings=settings, joined=True), "term", "lang")
    monkeypatch.setattr(training, "VAST_GRAMS", 1)
    monkeypatch.setattr(frequent, "AT_ONCE", 200)
    monkeypatch.setattr(frequent, "keep", lambda df, f=frequent.keep: stored.append(f(df)) or stored[-1])
    monkeypatch.setattr(counts, "MANY_GRAMS", 1 << 60)
    monkeypatch.setattr(training, "train_from_counts", None)  # fails where all n-grams are counted one by one
    assert table(train(docs, "lang", settings=settings, joined=True), "term", "lang") == want and want
    rest = stored[2]
    assert rest.where("cnt > 1").count() and not rest.where("lang = 'a' and n > 1 and cnt = 1").count()


def test_frequent_counts_go_on_to_rarer_grams(spark, monkeypatch):
    """Counts above the level are exact, whatever shares a number; the mass left out makes up the total; the next ones reach further, the last hold all."""
    texts = [("a", "p q r " * 40 + "s t " * 10 + " ".join(f"u{k}" for k in range(50))), ("b", "p q " * 9)]
    docs = counts.joined_texts(spark.createDataFrame(texts, "lang string, text string"), "lang")
    whole = table(counts.class_counts(docs, "lang", n_max=2, joined=True), "lang", "n", "term")
    totals = counts.gram_totals(docs, "lang", n_max=2)
    monkeypatch.setattr(frequent, "number", lambda n, n_max, groups, f=frequent.number: F.when(f(n, n_max, groups).isNotNull(), F.pmod(F.hash("word"), F.lit(16)).cast("long") * groups + F.col("_class") * n_max + (n - 1)))
    before = 0
    for rest, left in frequent.frequent_counts(docs, "lang", ["a", "b"], totals, "text", 2, "d2"):
        got = table(rest, "lang", "n", "term")
        assert got.items() <= whole.items() and len(got) >= before
        sums = Counter({(r["lang"], r["n"]): r["_k"] for r in left.collect()})
        sums.update({g: sum(v for k, v in got.items() if k[:2] == g) for g in totals})
        assert sums == totals
        before = len(got)
        if got == whole:
            break
    assert counts.cut_by_mass(rest, "lang", "d2", left) is not None
    keys = np.array([-5, -1, 3, 1 << 40], np.int64)
    assert [x.tolist() for x in frequent.unpacked(frequent.packed(keys, np.arange(4)))] == [keys.tolist(), [0, 1, 2, 3]]
    assert all(len(x) == 0 for x in frequent.unpacked(frequent.packed(keys[:0], keys[:0])))

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import hard_docs
from wordloom.llm import lm, queries, toxicity


def test_lm_losses_match_counters(spark, sf_dir, monkeypatch):
    """Counts of words as they are, made again in plain Python; small blocks, so that there are many."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    target = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    models = []
    for ids in (target & set(rows), set(rows)):
        singles, pairs = Counter(), Counter()
        for i in (i for i in ids if rows[i]):
            singles.update([*rows[i], None]), pairs.update(zip([None, *rows[i]], [*rows[i], None]))
        models.append((singles, pairs, sum(singles.values())))
    vocabulary, scale = len(models[1][0]), models[0][2] / models[1][2]
    got = queries.op3_lm_scoring(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        words = rows[r["doc_id"]]
        for side, loss in enumerate((r["target_loss"], r["background_loss"])):
            singles, pairs, total = models[side]
            s, steps = scale if side else 1.0, list(zip([None, *words], [*words, None])) if words else []
            nats = [-math.log((pairs[b, w] * s + lm.SMOOTHING * (singles[w] * s + 1) / (total * s + vocabulary)) / (singles[b] * s + lm.SMOOTHING)) for b, w in steps]
            assert loss == pytest.approx(sum(nats) / max(len(steps), 1), abs=1e-9)
        assert r["score"] == r["target_loss"] - r["background_loss"] and r["n_tokens"] == len(words)


def test_lm_target_joined_by_exchange(spark, sf_dir, monkeypatch):
    """More target ids than may be sent to all executors give the same scores."""
    sent = {tuple(r) for r in queries.op3_lm_scoring(spark, sf_dir).selectExpr("doc_id", "round(score, 9)").collect()}
    monkeypatch.setattr(lm, "MOST_SENT_IDS", 0)
    assert sent == {tuple(r) for r in queries.op3_lm_scoring(spark, sf_dir).selectExpr("doc_id", "round(score, 9)").collect()}


def test_lm_by_teams(spark, sf_dir, monkeypatch):
    """Teams of blocks give the same scores; their rows are fewer than blocks times ranges."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 5_000)
    plain = {tuple(r) for r in queries.op3_lm_scoring(spark, sf_dir).selectExpr("doc_id", "n_tokens", "round(score, 9)").collect()}
    asked, plain_requests, rows = [], lm.requests, {}
    monkeypatch.setattr(lm, "requests", lambda blocks, ranges: (asked.append((blocks.count(), ranges)), plain_requests(blocks, ranges))[1])
    monkeypatch.setattr(lm, "MOST_ROWS", 0)
    assert plain == {tuple(r) for r in queries.op3_lm_scoring(spark, sf_dir).selectExpr("doc_id", "n_tokens", "round(score, 9)").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as _id", "text as _text", "false as _target")
    for part in (0.25, 1.0):
        blocks = lm.gathered(docs.where(f"_id < {part} * 200").coalesce(1))
        n = blocks.count()
        ranges = 1 << max(3, (n * 2).bit_length())
        rows[n] = lm.team_totals(blocks, n, ranges).where("block is not null").count()
        assert rows[n] <= n * (1 << (ranges.bit_length() - 1) // 2) < n * ranges
    (few, a), (many, b) = rows.items()
    assert b / a <= 1.2 * (many / few) ** 1.5
    assert asked[0][1] < asked[0][0]  # blocks ask wide ranges only


def test_packing_of_numbers():
    for numbers in ([0], [1, 2**43, 5], list(range(1000))):
        assert lm.unpacked(lm.packed(lm.np.array(numbers))).tolist() == numbers


def test_lm_hard_rows(spark):
    docs = hard_docs(spark)
    got = lm.cross_entropy_difference(docs, spark.createDataFrame([(3,), (None,)], "doc_id long"))
    assert got.count() == docs.count()
    assert {r["doc_id"]: r["score"] for r in got.collect()}[1] == 0.0
    assert lm.cross_entropy_difference(docs.limit(0), docs.select("doc_id")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    """On the smallest table with enough toxic rows to learn from."""
    sf_dir = "/root/testdata/sf0.1"
    scored = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(scored[i]["score"], y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(scored[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in scored)
    wins = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert wins and sum(wins) / len(wins) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored.values())


def test_held_out_labels_are_not_read(spark):
    """Scores stay the same when the labels of held-out rows are turned around."""
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, x).collect()} for x in (labels, turned))
    assert first == second


def test_toxicity_hard_rows(spark):
    """With two labels only, nothing but the labelled words may be called toxic."""
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(3, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels)
    assert got.count() == docs.count() and all(0 <= r["score"] < 0.3 for r in got.collect())
    assert toxicity.drop_toxic(docs, labels).count() == docs.count()
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_clean_texts_do_not_become_toxic_by_length(spark):
    """One clean sentence many times, and whole clean documents one after the other, up to over 5,000 sentences; none of them is filtered."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    score = toxicity.Scorer(model).document
    assert [score("This is a plain remark. " * n) for n in (1, 50, 5_000)] == [score("")] * 3 == [pytest.approx(model.leak, abs=1e-12)] * 3
    clean = [r["text"] or "" for r in docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text").orderBy("doc_id").collect()]
    alone = [score(t) >= 0.3 for t in clean]
    assert sum(alone) <= 0.015 * len(clean)
    for least in (10, 100, 1_000, 5_000):
        joined, wrong, n = [], [], least
        for t, bad in zip(clean, alone, strict=True):
            if n >= least:
                joined, wrong, n = [*joined, ""], [*wrong, False], 0
            joined[-1] += f"{t}\n"
            wrong[-1] |= bad
            n += len(toxicity.sentences(t))
        assert len(joined) >= 5
        # Nearly every text that is called toxic holds a document that is by itself; of the others hardly one is, by its length.
        found = [score(t) >= 0.3 for t in joined]
        assert all(x for x, bad in zip(found, wrong, strict=True) if bad)
        assert sum(found) - sum(wrong) <= 1


def test_no_telling_word(spark):
    """Three toxic rows of forty that no word tells from the others: the number of sentences decides nothing."""
    docs = spark.createDataFrame([(i, "We walk to the river. " * (1 + i % 3)) for i in range(60)] + [(100, ". ".join(f"sentence {i}" for i in range(500)))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert all(r["score"] <= toxicity.MOST_LEAK + 1e-9 for r in toxicity.toxicity_scores(docs, labels).collect())


def brute_toxicity(docs: dict, labels: dict, min_gain: float = 12.0):
    """Features by counting documents, bags sentence by sentence."""
    own = {i: docs[i] or "" for i in sorted(labels) if i in docs and zlib.crc32(str(i).encode()) % 4 != 2}
    split = {i: [set(re.findall(r"[^\W\d_]+", s)) for s in dict.fromkeys(re.split(r"[.!?\n]", t.lower()))] for i, t in own.items()}
    feats = lambda words: {f for w in words for f in [w, *[w[:n] + "*" for n in range(4, 10) if len(w) > n]]}
    n, a, y = Counter(), Counter(), {i: labels[i] > 0 for i in own}
    for i in own:
        found = set().union(*map(feats, split[i]))
        n.update(found)
        a.update(found if y[i] else ())
    n1, n0 = sum(y.values()), len(y) - sum(y.values())
    share, chosen = n1 / (n0 + n1), []
    for f, k in n.items():
        cells = [(a[f], k * share), (k - a[f], k * (1 - share)), (n1 - a[f], (n0 + n1 - k) * share), (n0 - k + a[f], (n0 + n1 - k) * (1 - share))]
        if k >= 3 and a[f] > k * share and 2 * sum(o * math.log(o / e) for o, e in cells if o > 0) >= min_gain:
            chosen.append(f)
    bags = [(y[i], sorted({tuple(sorted(feats(s) & set(chosen))) for s in split[i]} - {()})) for i in own]
    return set(chosen), sorted(bags)


def test_features_and_bags_match_brute_force(spark, monkeypatch):
    """What is learnt from: features by likelihood ratio without a cap, and the different sentences that hold some."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = {}

    def fit(bags, n):
        seen.update(bags=bags, n=n)
        return -5.0, 0.0, np.arange(1.0, n + 1)

    monkeypatch.setattr(toxicity, "fit", fit)
    model = toxicity.train(docs, labels)
    chosen, bags = brute_toxicity({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()})
    assert set(model.weights) == chosen and len(chosen) > 20
    name, b = sorted(chosen), seen["bags"]
    got = [[] for _ in b.labels]
    for s, d in enumerate(b.doc):
        got[d].append(tuple(sorted(name[f] for f in b.feature[b.sentence == s])))
    assert sorted((bool(y), sorted(x)) for y, x in zip(b.labels, got, strict=True)) == bags


def test_noisy_or_and_its_gradients():
    """Loss against the product of chances, gradients against differences, and scores against both."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        pairs = sorted({(int(s), int(f)) for s, f in zip(rng.integers(0, 4, 9), rng.integers(0, 6, 9), strict=True)})
        order = {s: k for k, s in enumerate(dict.fromkeys(s for s, _ in pairs))}
        rows.append((int(rng.random() < 0.4), np.array([f for _, f in pairs], np.int32).tobytes(), np.array([order[s] for s, _ in pairs], np.int32).tobytes()))
    bags, w, bias, leak, decay = toxicity.Bags.of(rows), rng.random(6) * 3, -2.0, 0.03, 0.01
    chance, nats = lambda z: 1 / (1 + math.exp(-z)), 0.0
    for y, fs, ss in rows:
        sums = Counter()
        for f, s in zip(np.frombuffer(fs, np.int32), np.frombuffer(ss, np.int32), strict=True):
            sums[s] += w[f]
        # A sentence without words has the chance of the bias, which is taken out of each.
        clean = math.exp(-leak) * math.prod((1 - chance(bias + x)) / (1 - chance(bias)) for x in sums.values())
        nats -= math.log(1 - clean if y else clean)
    value, by_weight, by_bias, by_leak = toxicity.loss(bags, bias, leak, w, decay)
    assert value == pytest.approx(nats / 30 + decay / 2 * (w**2).sum())
    h = 1e-6
    slope = lambda up, down: (toxicity.loss(bags, *up, decay)[0] - toxicity.loss(bags, *down, decay)[0]) / (2 * h)
    for k in range(6):
        step = np.eye(6)[k] * h
        assert by_weight[k] == pytest.approx(slope((bias, leak, w + step), (bias, leak, w - step)), abs=1e-6)
    assert by_bias == pytest.approx(slope((bias + h, leak, w), (bias - h, leak, w)), abs=1e-6)
    assert by_leak == pytest.approx(slope((bias, leak + h, w), (bias, leak - h, w)), abs=1e-6)
    # Scores are the same formula: low sentences add up like high ones.
    weights = {w: x for w, x in zip("abcdefgh", [3.0, 5.0, 0.5, 1.0, 0.01, 0.02, 0.03, 0.04], strict=True)}
    scorer = toxicity.Scorer(toxicity.Model(-4.0, weights, 0.02))
    clean = 0.98 * math.prod((1 - chance(-4.0 + x)) / (1 - chance(-4.0)) for x in weights.values())
    assert scorer.document(". ".join(weights)) == pytest.approx(1 - clean)
    assert scorer.document("none. of these!") == scorer.document("") == pytest.approx(0.02)
    assert toxicity.loss(toxicity.Bags.of([(0, np.arange(8, dtype=np.int32).tobytes(), np.arange(8, dtype=np.int32).tobytes())]), -4.0, -math.log(0.98),
                         np.array(list(weights.values())), 0.0)[0] == pytest.approx(-math.log(clean))
    many = toxicity.Scorer(toxicity.Model(-4.0, {f"w{'x' * i}": 1.0 for i in range(100)}, 0.0))
    assert many.document(". ".join(f"w{'x' * i}" for i in range(100))) > 0.9


def test_whole_scores_match_brute_force(spark):
    """Every document of a table, from its raw text to the score, made again without the operator's functions."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r in docs.collect():
        held = set()
        for sentence in re.split(r"[.!?\n]", (r["text"] or "").lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            held.add(frozenset(f for w in words for f in [w, *[w[:n] + "*" for n in range(4, 10) if n < len(w)]] if f in model.weights))
        clean = 1 - model.leak
        for h in held:
            clean *= (1 + math.exp(model.bias)) / (1 + math.exp(model.bias + sum(model.weights[f] for f in h)))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - clean, abs=1e-9)
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)


def test_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "clean words here. " * 5 + ("grommit." if i % 2 else "")) for i in range(4_000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, n: (seen.append(len(bags.labels)), (-5.0, 0.0, np.ones(n)))[1])
    toxicity.train(docs, labels, max_docs=500), toxicity.train(docs, labels, max_bytes=20_000)
    assert 400 < seen[0] < 600 and 100 < seen[1] < 350


def test_sentences_are_located(spark):
    good, bad = "The weather is fine today. We walk to the river.", "You stupid grommit! The river is wide."
    docs = spark.createDataFrame([(i, (bad if i % 2 else good) + f" Number {i}.") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for r in toxicity.toxicity_scores(docs, labels).collect():
        assert r["predicted"] == r["doc_id"] % 2
        text = (bad if r["doc_id"] % 2 else good)
        assert all("grommit" in text[s["start"]:s["end"]] for s in r["offending"]) and len(r["offending"]) == r["doc_id"] % 2


@pytest.mark.parametrize("threshold", [0.0, 1e-30, 0.01, 0.1, 0.3, 0.9, 1.0])
def test_offending_sentences_at_any_threshold(spark, threshold):
    """A sentence is found whenever its own score reaches the threshold."""
    model = toxicity.Model(-4.0, {"bad": 2.0, "worse": 5.0, "worst": 60.0})
    texts = ["fine", "bad", "worse", "worst", "good", "fine. bad. worse", "good. fine", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scorer = toxicity.Scorer(model)
    for r in toxicity.with_toxicity(docs, model, threshold=threshold).collect():
        text = r["text"] or ""
        want = [(m.start(), m.end(), scorer.sentence(m[0])) for m in re.finditer(r"[^.!?\n]+", text) if scorer.sentence(m[0]) >= threshold]
        assert [tuple(x) for x in r["_offending"]] == want
        assert r["_toxicity"] == scorer.document(text)
    with pytest.raises(ValueError, match="columns of these names"):
        toxicity.with_toxicity(docs.withColumnRenamed("id", "_Offending"), model)

"""Quality rules against counts and estimates made again in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import hard_docs
from wordloom.llm import quality, queries


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word) from the definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines)


def failed(c):
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


def vector(c):
    return [math.log(c[1] / c[0]), math.sqrt(min(1, c[2] / max(c[1], 1))), math.sqrt(c[3] / max(c[5], 1)), math.sqrt(c[4] / c[0])]


def estimate(z):
    """Mean and covariance of all rows, with the factor and the floors."""
    return z.mean(0), quality.CONSISTENCY * np.cov(z.T, bias=True) + np.diag(np.square(quality.FLOORS))


def squared(z, mean, cov):
    return np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)


def least_determinant(z):
    """The same starts and steps on one group in memory; the subset is all vectors up to the bin of the last one that belongs to it."""
    q = np.round(z * 1024)
    upto = lambda share: np.array([np.sort(c)[math.ceil(share * len(c)) - 1] for c in q.T]) / 1024
    wide = (upto(0.75) - upto(0.25)) / 1.349
    ends = []
    for mean, cov in ((upto(0.5), np.diag(wide**2 + np.square(quality.FLOORS))), estimate(z)):
        for _ in range(quality.STEPS):
            bins = np.floor(64 * np.log1p(squared(z, mean, cov)))
            last = np.sort(bins)[math.ceil(quality.SUBSET * len(z)) - 1]
            mean, cov = estimate(z[bins <= last])
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    return min(ends, key=lambda e: e[0])


def brute(rows):
    """id to (counts, failed, distance, kept) of rows (id, text, lang, source) with different ids."""
    found = {i: counts(t) for i, t, _, _ in rows}
    groups = defaultdict(list)
    for i, _, lang, source in rows:
        if not failed(found[i]):
            groups[lang, source].append(i)
    for key in [k for k, v in groups.items() if len(v) < quality.LEAST_GROUP and k != "pooled"]:
        groups["pooled"] += groups.pop(key)
    out = {i: (c, True, None, False) for i, c in found.items()}
    for ids in groups.values():
        if ids:
            z = np.array([vector(found[i]) for i in ids])
            _, mean, cov = least_determinant(z)
            for i, d in zip(ids, squared(z, mean, cov), strict=True):
                out[i] = (found[i], False, d, bool(d <= quality.MOST_DISTANCE))
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        c, bad, d, kept = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c[:5]
        assert r["base_failed"] == bad and r["kept"] == kept
        assert (r["distance"] is None) if d is None else r["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9)


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.op12_quality(spark, sf_dir).collect(), brute(rows))


def test_groups_match_brute_force(spark):
    """Few large groups, one with a third of outliers, null keys, and small groups that are one together."""
    rng = random.Random(5)
    word = lambda mean: "".join(rng.choices("abcdefghij", k=max(1, round(rng.gauss(mean, 1.5)))))
    rows = []
    for i in range(900):
        lang, source = rng.choice([("en", "a"), ("en", None), (None, "a"), (None, None), ("de", f"s{i % 30}")])
        odd = rng.random() < (0.33 if source == "a" else 0.05)
        text = " ".join(word(12 if odd else 5) + ("##" if odd and rng.random() < 0.5 else "") for _ in range(rng.randint(15, 120)))
        rows.append((i, text.replace(" ", "\n", 3) if i % 3 else text, lang, source))
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    check(quality.quality_rules(docs).collect(), want)
    odd = [i for i, t, _, _ in rows if "##" in t and not want[i][1]]
    plain = [i for i, t, _, _ in rows if "##" not in t and not want[i][1] and want[i][0][1] / want[i][0][0] < 7]
    assert len(odd) > 80 and not any(want[i][3] for i in odd) and all(want[i][3] for i in plain)
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == [i for i in range(900) if want[i][3]]


def test_repeated_words_and_lines(spark):
    """Windows that overlap themselves and each other, of few different words."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "ab", "é😀"][:k], k=n)) for k in (1, 2, 3, 4) for n in (0, 1, 7, 8, 9, 15, 16, 17, 30, 60, 200)]
    base = [str(i) for i in range(30)]
    texts += [" ".join(base + base[:8]), " ".join(base + base[:7]), " ".join(base[:8] * 2), " ".join(base + ["x"] + base + base[3:15])]
    texts += ["a\nb\na\n \n \na ", "\n\n", "x\r\nx\r\nx", "a b\x0bc\x0cd\te f g", "w " * 50_000, "\n".join(map(str, range(30_000))), "#|<" * 1000, "\x00 a \x00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.with_counts(docs).collect():
        assert tuple(r["_wl_counts"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")) == counts(texts[r["doc_id"]])


def test_hard_rows_and_no_python(spark):
    docs = hard_docs(spark).withColumn("source", F.lit(None).cast("string")).withColumn("g", F.lit(1)).withColumn("distance", F.lit(2)).withColumn("_wl_kept", F.lit(3))
    got = quality.quality_rules(docs)
    assert got.count() == docs.count() and "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert {r["doc_id"]: r["kept"] for r in got.collect()}[2] is False
    assert quality.quality_rules(docs.limit(0)).count() == 0
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs.limit(0)).count() == 0


def test_constants():
    assert pytest.approx(quality.expected_share(quality.SUBSET), abs=1e-4) == quality.CONSISTENCY

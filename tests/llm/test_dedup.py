import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import HARD_ROWS, ascii_lower, components, hard_docs, simhash
from wordloom.llm import exact_dedup, line_dedup, queries, simhash as sh


def brute_groups(rows, keep=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t), []).append(i)
    out = []
    for i, t in rows:
        members = groups[ascii_lower(t)]
        ids = [m for m in members if m is not None]
        kept = keep(ids) if ids else None
        out.append((i, kept, len(members), i == kept, hashlib.sha256(ascii_lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda t: F.unhex(F.substring(F.md5(t), 1, 1))])
def test_exact_groups(spark, digest):
    """Also with a digest of four bits, which collides all the time."""
    got = exact_dedup.exact_groups(hard_docs(spark), keep="largest", digest=digest)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(HARD_ROWS)


def rows_in_order(df):
    """All rows as lists; a row that repeats counts as often as it does."""
    return sorted(map(list, df.collect()), key=repr)


def test_exact_dedup_keeps_columns_and_one_row_of_each_text(spark):
    docs = hard_docs(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    want = [(min(i for i, u in HARD_ROWS if i is not None and ascii_lower(u) == t), t) for t in {ascii_lower(t) for _, t in HARD_ROWS}]
    assert sorted((r["doc_id"], ascii_lower(r["text"])) for r in kept.collect()) == sorted(want)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dedup", [exact_dedup.exact_dedup, sh.simhash_dedup])
def test_dedup_of_repeated_rows(spark, dedup):
    """Of rows that repeat id and text one stays, the least by the other columns; null ids count only among themselves."""
    one, two, three = "first text of all", "here is another one", "and a third of these"
    rows = [(1, one, "b"), (1, one, "a"), (1, one, "a"), (2, one, "z"), (None, two, "y"), (None, two, "x"), (None, three, "n"), (3, three, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _wl_row string")
    assert rows_in_order(dedup(docs)) == sorted([[1, one, "a"], [None, two, "x"], [3, three, "c"]], key=repr)
    hot = spark.range(20_000).selectExpr("cast(7 as long) as doc_id", "'same text in all' as text", "cast(id as string) as _wl_h", "map('k', id) as more")
    assert [r["_wl_h"] for r in dedup(hot).collect()] == ["0"]


CLASHING = ("_id", "_h", "_n", "_fp", "_wl_id", "_wl_h", "_wl_n", "_wl_row", "_component", "component_id", "_toxicity", "_offending", "_wl_score", "_wl_offending",
            "shard", "_wl_part", "_text", "spans", "length", "_keep")


def clashing_docs(spark):
    """Columns with the names that operators use themselves."""
    docs = spark.createDataFrame([(i, t) for i, t in HARD_ROWS], "doc_id long, text string")
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def test_clashing_columns(spark, tmp_path):
    from wordloom.llm import pii, shards, toxicity

    docs = clashing_docs(spark)
    labels = spark.createDataFrame([(3, 1), (8, 0)], "doc_id long, toxic int")
    for done in (exact_dedup.exact_dedup(docs), sh.simhash_dedup(docs), toxicity.drop_toxic(docs, labels), pii.redact(docs)):
        assert done.columns == docs.columns and all(r[c] == k for r in done.collect() for k, c in enumerate(CLASHING))
    assert shards.write_shards(docs, f"{tmp_path}/out") == "_shard"
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*docs.columns, "_shard"} and back.count() == len(HARD_ROWS)


def brute_lines(rows, window=3):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for s in range(len(lines) - window + 1):
            w = tuple(lines[s:s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark, sf_dir):
    for docs, rows in ((hard_docs(spark), HARD_ROWS[:4] + HARD_ROWS[6:]), (spark.read.parquet(f"{sf_dir}/documents.parquet"), None)):
        rows = rows or [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.line_dedup(docs).collect()}
        assert {i: got[i] for i, _ in rows} == brute_lines(rows)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def brute_simhash(rows):
    fps = {i: simhash(t) for i, t in rows}
    ids = sorted(fps)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (fps[a] ^ fps[b]).bit_count() <= 3]
    return {i: (f"{fps[i]:016x}", c) for i, c in components(ids, edges).items()}


def test_simhash_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, sf_dir).collect()}
    assert got == brute_simhash(rows)
    hard = [(i, t) for i, t in HARD_ROWS if i is not None]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in sh.simhash_groups(hard_docs(spark)).collect() if r["doc_id"] is not None}
    assert got == brute_simhash(hard)
    assert sh.simhash_groups(docs.limit(0)).count() == 0


def test_close_fingerprints_link_in_large_buckets(spark, monkeypatch):
    """Chains of near fingerprints, with buckets over the cap, which give way to finer ones."""
    import random

    rng, fps = random.Random(5), []
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(20):
            fps.append(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                f ^= 1 << b
    fps += [f & 0xFFFF for f in fps[:200]]
    fps = sorted(set(fps))
    monkeypatch.setattr(sh, "CAP", 50)
    index = {f - 2**64 if f >> 63 else f: i for i, f in enumerate(fps)}
    classes = spark.createDataFrame([(f,) for f in index], "_fp long")
    sizes = sh.buckets(classes, len(fps), 3).groupBy("t", "key").count().agg(F.max("count"), F.max("t")).first()
    assert sizes[0] <= 50 and sizes[1] > 16  # large buckets were dealt once more
    edges = [(index[a], index[b]) for a, b in sh.linked_edges(classes, len(fps), 3).collect()]
    brute = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert components(range(len(fps)), edges) == components(range(len(fps)), brute)


def test_simhash_dedup_keeps_one_of_each_component(spark):
    """A row without an id goes like any other where a near text has one."""
    docs = hard_docs(spark)
    kept = sh.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute_simhash([r for r in HARD_ROWS if r[0] is not None]).values()})
    assert sh.simhash_dedup(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_one_node(spark):
    """Texts of one id are in one component, which reaches what any of them links with; one row of it stays."""
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue and white"
    docs = spark.createDataFrame([(2, a), (4, a), (4, b), (9, b), (None, b), (5, c), (None, "no one has this")], "doc_id long, text string")
    got = sh.simhash_groups(docs)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=repr) == sorted([(2, 2), (4, 2), (4, 2), (9, 2), (None, 2), (5, 5), (None, None)], key=repr)
    assert rows_in_order(sh.simhash_dedup(docs)) == sorted([[2, a], [5, c], [None, "no one has this"]], key=repr)

"""Repair of conversations against a search over whole edit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from wordloom.llm import conversations, queries

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    """{conversation: [(turn, role, text)] in order} of rows (conversation, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        own = out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) by the least (cost, letters) from each place and state to the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]

    @cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        steps = [("I", 2, who, f"{name}:", i) for who, name in (("u", "user"), ("a", "assistant"))] if inserted < 2 else []
        if i < len(rows):
            _, role, text = rows[i]
            steps.append(("D", 3, None, None, i + 1))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                steps += [("K", more, role[:1], f"{role}:{text}", i + 1), ("R", 2 + more, "u", f"user:{text}", i + 1), ("R", 2 + more, "a", f"assistant:{text}", i + 1)]
        for letter, cost, who, line, at in steps:
            after = state if who is None else NEXT.get((state, who))
            if after is not None and (rest := best(at, after, inserted + 1 if letter == "I" else 0)):
                found.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def values(r):
    return tuple(r[c] for c in (*conversations.COUNTS, "audit", "repaired_sha256"))


TYPES = "conv_id long, turn long, role string, text string"


def some_rows(n_conv, most, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", "sys", None], ["Yes.", "No!", "cut", " ", "", "Yes.", None, "Why? ", "é😀.", "a\nb.\n"]
    rows = []
    for conv in [*range(n_conv), None]:
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"{turn}."))
    rng.shuffle(rows)
    return rows


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = {r["conv_id"]: values(r) for r in queries.op13_conversations(spark, sf_dir).collect()}
    assert got == {c: brute(v) for c, v in damage(rows).items()}


@pytest.mark.parametrize("long", [1_000_000, 4])
def test_any_rows_in_one_piece_and_in_blocks(spark, long):
    """Ties, nulls, repeated rows; long ones in blocks, of conversations of up to 60 rows."""
    rows = some_rows(80, 12, 1) + [(500 + c, *r) for c, n in enumerate((60, 45, 30)) for _, *r in some_rows(1, n, c) if _ is not None]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TYPES}, audit string, _c int").repartition(5)
    got = conversations.repair(docs, long=long).collect()
    assert {r["conv_id"]: values(r) for r in got} == {c: brute(v) for c, v in damage(rows).items()}
    assert len(got) == len({r[0] for r in rows})


def test_a_long_conversation_spans_blocks(spark):
    """One conversation of many rows beside small ones, cut into several blocks, equals the same in one piece."""
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{t}.", "Yes.", "cut", f"{t} cut"])) for t in range(4_000)] + some_rows(20, 8, 3)
    rows += [(8, None, "user", "Same.")] * 500 + [(9, 3, "user", "Same.")] * 500
    docs = spark.createDataFrame(rows, TYPES)
    whole = {r["conv_id"]: values(r) for r in conversations.repair(docs).collect()}
    parts = {r["conv_id"]: values(r) for r in conversations.repair(docs, long=100).collect()}
    assert whole == parts and len(whole[7][6]) > 3_000


def test_edges(spark):
    assert conversations.repair(spark.createDataFrame([], TYPES)).count() == 0
    dropped = [(c, 1, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    for long in (conversations.LONG, 0):
        got = conversations.repair(spark.createDataFrame(dropped, TYPES), long=long).collect()
        assert len(got) == len(dropped) > 5 and all(values(r) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)
    long_text = spark.createDataFrame([(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y" * 3_000_000)], TYPES)
    assert [values(r) for r in conversations.repair(long_text).collect()] == [brute(v) for v in damage([tuple(r) for r in long_text.collect()]).values()]


@pytest.mark.parametrize("symbols, want", [("", (0, "")), ("s", (3, "D")), ("u", (2, "KI")), ("a", (2, "IK")), ("su", (2, "KKI")), ("ua", (0, "KK")), ("sua", (0, "KKK")), ("uu", (2, "KR")), ("o", (3, "D")), ("oo", (4, "RR"))])
def test_cheapest_letters(symbols, want):
    assert conversations.repaired(bytes("suao".index(c) for c in symbols)) == want

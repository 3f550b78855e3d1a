"""Small inputs and brute-force twins that several tests share."""

from __future__ import annotations

from collections import Counter

import xxhash

#: Rows with what may go wrong: null and empty texts, a null id, repeated rows, ties, very long texts.
HARD_ROWS = [
    (1, None), (2, ""), (3, "Hello World"), (4, "hello world"), (4, "hello world"), (None, "hello world"),
    (5, "ÄÖ hello"), (6, "äö hello"), (7, "a b\nc d\ne f\na b\nc d\ne f"), (8, "word " * 30_000), (9, "x" * 200_000),
    (10, " \t\n"), (11, "one\ntwo\nthree\nfour"), (12, "zero\none\ntwo\nthree"), (13, "ein 😀 zwei ▁ drei\x00vier"),
]


def hard_docs(spark):
    """HARD_ROWS with extra columns whose names an operator might use itself."""
    rows = [(i, t, "en", 1, "p", None) for i, t in HARD_ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, size long, _h string, component_id long")


def ascii_lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, edges) -> dict:
    """Smallest reachable node of each node."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text: str | None) -> int:
    """Bit by bit from the definition."""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", ascii_lower(text)) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = Counter(xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles)
    total = sum(hashes.values())
    return sum(1 << bit for bit in range(64) if 2 * sum(n for h, n in hashes.items() if h >> bit & 1) > total)

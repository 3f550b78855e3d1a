import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import hard_docs
from wordloom.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind: str, s: str) -> bool:
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(re.fullmatch("0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])", p) for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text: str) -> list:
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="01459 .-+@()aZ_é,:", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert [s for s in pii.spans(text) if s[0] in PATTERNS] == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "999.1.1.1", "a.b@c.de", "+49 (30) 1234567", "https://x.org/a?b", "IBAN: DE12 3456 7890", " ", ".", "-", "\n", "@", "+", "7"]), max_size=9))
def test_base_spans_match_the_patterns_on_near_hits(parts):
    text = "".join(parts)
    assert [s for s in pii.spans(text) if s[0] in PATTERNS] == brute(text)


@pytest.mark.parametrize("zeros", [1, 4_298, 4_299, 4_300, 4_301, 1_000_000])
@pytest.mark.parametrize("place", range(4))
@pytest.mark.parametrize("end", ["1", "255", "256", ""])
def test_long_zeros_in_any_part(zeros, place, end):
    parts = ["1", "2", "3", "4"]
    parts[place] = "0" * zeros + end
    text = f"x {'.'.join(parts)} y"
    got = [s for s in pii.spans(text) if s[0] in PATTERNS]
    assert zeros > 5_000 or got == brute(text)  # the patterns take quadratic time
    assert (("ip", 2, len(text) - 2) in got) == (end != "256")


def test_long_zeros_through_spark(spark):
    """A part of more digits than Python turns into a number is found, counted and redacted."""
    texts = {i: f"a {'.'.join(['0' * n + '7' if k == i % 4 else '1' for k in range(4)])} b" for i, n in enumerate([4_299, 4_301, 5_000, 100_000])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pii.pii_digest(docs).collect():
        assert r["n_ip"] == 1 and f"ip:2:{len(texts[r['doc_id']]) - 2}" in r["spans"]
    assert {r["text"] for r in pii.redact(docs).collect()} == {"a [IP] b"}


def accounts(text: str) -> list[str]:
    return [text[s:e] for k, s, e in pii.spans(text) if k == "account"]


def test_added_spans():
    text = "see https://x.org/a?b=1, ok. IBAN: DE89 3704 0044 0532 0130 00 and acct no. 1234567"
    assert [text[s:e] for k, s, e in pii.spans(text) if k == "url"] == ["https://x.org/a?b=1"]
    assert accounts(text) == ["DE89 3704 0044 0532 0130 00", "1234567"]


def test_anchors_in_any_case():
    """A-Z of cues, schemes and numbers count as a-z; letters that become a-z by other rules do not."""
    assert accounts("iBaN de89 3704 0044 0532 0130 00, Iban gb82west12345698765432") == ["de89 3704 0044 0532 0130 00", "gb82west12345698765432"]
    text = "HtTp://x.com and hTTPS://Y.org/a, \u017fsh://z.com, İ aCCt 1234567"
    assert [text[s:e] for k, s, e in pii.spans(text) if k == "url"] == ["HtTp://x.com", "hTTPS://Y.org/a"]
    assert accounts(text) == ["1234567"] and accounts("PASSPORT c01234567") == ["c01234567"]


def test_boundaries_of_identifiers():
    """An international account number is as long as its country says, and its check digits are right."""
    assert accounts("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF") == ["DE89 3704 0044 0532 0130 00"]
    assert accounts("iban GB82WEST12345698765432.") == ["GB82WEST12345698765432"]
    assert accounts("account GB82 WEST 1234 5698 7654 32") == ["GB82 WEST 1234 5698 7654 32"]
    for wrong in ("iban XX00 0000 00", "IBAN DE88 3704 0044 0532 0130 00", "IBAN DE89 3704 0044 0532 0130", "IBAN DE89 3704 0044 0532 0130 001", "konto 12345", "account 123456789012345678"):
        assert accounts(wrong) == []
    assert accounts("ACCOUNT 12345678 IS CLOSED AND THE CUSTOMER MOVED") == ["12345678"]
    assert accounts("konto nr. 1234 5678 90, cuenta: 1234-5678-9012") == ["1234 5678 90", "1234-5678-9012"]
    assert accounts("SSN 123-45-6789 but ssn 000-12-3456, ssn 123-00-4567, ssn 987-65-4321") == ["123-45-6789"]
    assert accounts("passport no C01234567, passport 12345") == ["C01234567"]


def test_country_lengths():
    """Fixed lengths as published; a number of that length with computed check digits is found, one shorter is not."""
    assert len(pii.IBAN_LENGTHS) < 200
    for country, length in pii.IBAN_LENGTHS.items():
        body = "1" * (length - 4)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        number = f"{country}{check:02d}{body}"
        assert accounts(f"iban {number} x") == [number] and accounts(f"iban {number[:-1]} x") == []


@pytest.mark.parametrize("unit", ["IBAN 1 ", "http://a/", "http://", "http://a@", "a@", "+1 ", "1.", "1-", "@a.", "ssn 123-", "http://a.b/", "iban DE89 3704 ", "account 1234 "])
def test_time_is_linear(unit):
    """Four times the text takes far less than sixteen times as long."""
    def seconds(n: int) -> float:
        start = time.perf_counter()
        pii.spans(unit * n)
        return time.perf_counter() - start

    assert min(seconds(40_000) for _ in range(2)) < 10 * max(min(seconds(10_000) for _ in range(3)), 0.005)


def test_digest(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, sf_dir).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))


def test_redaction_and_hard_rows(spark):
    docs = hard_docs(spark)
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(docs.limit(0)).count() == 0
    assert pii.redact(docs).columns == docs.columns
    row = spark.createDataFrame([(1, "mail a@b.co or +49 30 1234567!"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(row).orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE]!", None]

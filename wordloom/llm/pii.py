"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, schemes, identifier cues); small
deterministic parsers expand each anchor to its boundaries and validate what they find. What a parser
reads ends at the next anchor of its kind or after a fixed length, so that time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of output: the base, then what this method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss")
CUES = ("iban", "ssn", "account", "acct", "passport", "konto", "compte", "cuenta")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: User information and host of an address; what may follow it.
HOST = re.compile(r"(?:[^\s/@<>\"':]*+(?::[^\s/@<>\"':]*+)?@)?(\[[0-9A-Fa-f:.]{2,45}\]|[\w-]++(?:\.[\w-]++)*+)")
REST = re.compile(r"(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*+)?")
#: Between a cue and its identifier.
LEAD = re.compile(r"(?:[ \t]{0,3}(?:no|nr|number|num)\b\.?)?[ \t:#=-]{1,4}", re.IGNORECASE)
#: An international account number, whole or in groups of four; a social security number; a passport; a plain account number, whole or in groups of up to four digits.
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[0-9A-Za-z]{11,30}|(?:[ -][0-9A-Za-z]{4}){2,7}(?:[ -][0-9A-Za-z]{1,3})?)")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z])")
PASSPORT = re.compile(r"[A-Za-z]{0,2}[0-9]{6,9}(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"(?:[0-9]{6,17}|[0-9]{1,4}(?:[ -][0-9]{2,4}){1,7})(?![0-9A-Za-z])")
#: Lengths of international account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}


@cache
def anchors() -> ahocorasick.Automaton:
    """What to look for in a text whose A-Z are in lower case."""
    found = ahocorasick.Automaton()
    for sign in ("@", "+", *"0123456789"):
        found.add_word(sign, ("digit" if sign.isdigit() else sign, 1))
    for scheme in SCHEMES:
        found.add_word(f"{scheme}://", ("scheme", len(scheme) + 3))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def lower_ascii(text: str) -> str:
    """A-Z in lower case; every character stays in its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, only those letters have another case


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def iban(text: str, at: int) -> int | None:
    """End of the account number that begins at `at`: as long as its country's are, with the right check digits."""
    m = IBAN.match(text, at)
    length = m and IBAN_LENGTHS.get(m[0][:2].upper())
    if not length:
        return None
    compact, end = "", at
    while end < m.end() and len(compact) < length:
        compact += text[end] if text[end] not in " -" else ""
        end += 1
    if len(compact) < length or text[end:end + 1].isalnum():
        return None
    return end if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1 else None


def identifier(text: str, at: int, cue: str) -> int | None:
    """End of the identifier at `at` that the cue announces. An account may be an international one."""
    if cue == "iban":
        return iban(text, at)
    m = {"ssn": SSN, "passport": PASSPORT}.get(cue, ACCOUNT).match(text, at)
    if m and (cue in ("ssn", "passport") or 6 <= len(only_digits(m[0])) <= 17):
        return m.end()
    return iban(text, at) if cue not in ("ssn", "passport") else None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start; of one kind none overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # Where the search for the next one of a kind goes on.
    after = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in anchors().iter(lower_ascii(text)):
        at = last - size + 1
        if anchor == "digit":
            if at >= after["card"]:
                if m := CARD.match(text, at):
                    after["card"] = m.end()
                    digits = only_digits(m[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
                else:
                    after["card"] = at + 1
            if at >= after["ip"]:
                if m := IP.match(text, at):
                    after["ip"] = m.end()
                    if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    after["ip"] = DIGITS.match(text, at).end()
        elif anchor == "@":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                out["email"].append((start, m.end()))
        elif anchor == "+":
            if (m := PHONE.match(text, at)) and 8 <= len(only_digits(m[0])) <= 15:
                out["phone"].append(m.span())
        elif anchor == "scheme":
            if at >= after["url"] and (at == 0 or not text[at - 1].isalnum()) and (m := HOST.match(text, last + 1)) and ("." in m[1] or ":" in m[1] or m[1].lower() == "localhost"):
                # Punctuation at the end is not part of the address, nor is it read again.
                after["url"] = REST.match(text, m.end()).end()
                out["url"].append((at, m.end() + len(text[m.end():after["url"]].rstrip(".,;:!?)]}'\""))))
        elif at >= after["account"] and (at == 0 or not text[at - 1].isalnum()) and (lead := LEAD.match(text, last + 1)):
            if (end := identifier(text, lead.end(), text[at:last + 1].lower())) is not None:
                after["account"] = end
                out["account"].append((lead.end(), end))
    return [(kind, s, e) for kind in KINDS for s, e in out[kind]]


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans becomes the kind of its first span in brackets."""
    out, done = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, end) in code points, end exclusive.

    A null or empty text has no spans. Ids may be null or repeat; each row is searched on its own, whole,
    however long. Columns other than the two named are not read. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(SPAN))], ["_id", "spans"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .mapInArrow(run, f"_id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("_id", id_col))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans in the text replaced by their kind in brackets; a null text stays null, one without spans as it is.

    Each row is searched on its own, whole however long, in time linear in its length. Null ids, repeated rows and
    columns of any name are kept as they are. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (s := t.as_py()) is None else redacted(s, spans(s)) for t in b.column(at)]
            columns = [pa.array(texts, b.schema.field(i).type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, the hash of the base spans, all spans as text, and n_added; rows as in find_pii."""
    found = find_pii(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined_spans(base), 256).alias("base_sha256"),
                        joined_spans(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))

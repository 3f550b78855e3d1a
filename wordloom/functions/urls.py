"""URL detection: `www.`, scheme and top-level-domain rules, on whole Arrow batches.

Dots and colons are looked at from left to right. What a URL may reach is bounded by breaks: white space,
punctuation that is not ASCII, and NUL, which ends a text. Expressions cannot tell where the next dot or colon
is looked for, which depends on what became of the one before, so that this is a function on Arrow batches;
its time is linear in the text. Texts in which nothing can make a URL are told by an expression and stay on the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The known top-level domains.
TOP_LEVEL_DOMAINS = (
    "ac ad ae aero af ag ai al am an ao aq ar as asia at au aw az ba bb bd be bf bg bh bi biz bj bm bn bo br bs bt bv bw by bz ca cat cc cd cf cg ch "
    "ci ck cl cm cn co com coop cr cu cv cx cy cz de dj dk dm do dz ec edu ee eg eh er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn "
    "gov gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in info int io iq ir is it je jm jo jobs jp ke kg kh ki km kn kp kr kw ky kz la lb lc "
    "li lk lr ls lt lu lv ly ma mc md mg mh mil mk ml mm mn mo mobi mp mq mr ms mt mu museum mv mw mx my mz na name nato nc ne net nf ng ni nl no np "
    "nr nu nz om org pa pe pf pg ph pk pl pm pn pr pro ps pt pw py qa re ro ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr st su sv sy sz tc td "
    "tel tf tg th tj tk tm tn to tp tr travel tt tv tw tz ua ug uk um us uy uz va vc ve vg vi vn vu wf ws ye yt yu za zm zw "
    "ру рф нет орг ком"
).split()
#: Schemes that can be told by letters and hyphens alone.
SCHEMES = ("javascript jdbc acap adiumxtra attachment bitcoin chrome chrome-extension com-eventbrite-attendee cvs dns facetime file "
           "finger fish gizmoproject gopher http https iax imap irc ircs jabber jar ldap mailto mms ms-help ms-settings-power snews "
           "nntp rtmp rtsp ftp sftp tftp skype snmp ssh telnet udp uuid urn ws wss xmpp magnet").split()

TRIGGER = re.compile("[.:]")
SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-")
SPAN = "array<struct<value:string,start:int,length:int>>"


@cache
def punctuation() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "P")


@cache
def breaks() -> tuple[frozenset[str], re.Pattern]:
    """What no URL holds, as a set and as an expression."""
    spaces = {c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] == "Z"} | set("\t\n\v\f\r\x85")
    found = frozenset(spaces | {c for c in punctuation() if not c.isascii()} | {"\0"})
    return found, re.compile(f"[{re.escape(''.join(sorted(found)))}]")


class Detector:
    """Finds URLs. A known domain after a dot makes one of all that stands before it up to a break; what follows a domain belongs to it only from a slash on."""

    def __init__(self, domains: Iterable[str], schemes: Iterable[str] = SCHEMES):
        self.domains, self.schemes = frozenset(d.upper() for d in domains), frozenset(s.upper() for s in schemes)
        self.longest_domain, self.longest_scheme = max(map(len, self.domains), default=0), max(map(len, self.schemes), default=0)
        self.breaks, self.break_at = breaks()
        self.marks = punctuation() - {"/"}

    def chunk(self, text: str, at: int) -> tuple[int, int, int]:
        """(end of the stretch without breaks around `at`, its first and its last place that are no punctuation but a slash)."""
        start = at
        while start > 0 and text[start - 1] not in self.breaks:
            start -= 1
        found = self.break_at.search(text, at)
        end = found.start() if found else len(text)
        first, last = start, end - 1
        while first < end and text[first] in self.marks:
            first += 1
        while last >= start and text[last] in self.marks:
            last -= 1
        return end, first, last

    def domain_end(self, text: str, start: int) -> int | None:
        """Where the letters from `start` on end, if they are a known domain."""
        end = start
        while end < len(text) and end - start <= self.longest_domain and text[end].isalpha() and text[end] <= "\uffff":
            end += 1
        upper = text[start:end].upper()
        # No letter that becomes several, or one of another script's, stands for a letter of a domain.
        return end if upper in self.domains and len(upper) == end - start and not {"ı", "ſ"} & set(text[start:end]) else None

    def at_dot(self, text: str, dot: int, first: int, last: int) -> tuple[tuple[int, int] | None, int]:
        """((start, end) or None, where the search goes on)."""
        if dot >= 3 and text[dot - 3:dot].upper() == "WWW":
            end = max(last, dot) + 1
            return (dot - 3, end), end + 1
        end = self.domain_end(text, dot + 1)
        if end is None:
            return None, dot + 2  # the next character is not looked at
        own = dot
        while text[end:end + 1] in (".", "\uffff") and (further := self.domain_end(text, end + 1)) is not None:
            own, end = end, further
        if first >= own:
            return None, dot + 1
        if text[end:end + 1] in ("/", "\\"):
            end = last + 1
        return (first, end), end + 1

    def at_colon(self, text: str, colon: int, last: int) -> tuple[tuple[int, int] | None, int]:
        start = colon
        while start > 0 and colon - start <= self.longest_scheme + 1 and text[start - 1] in SCHEME_CHARS:
            start -= 1
        if not 0 < colon - start <= self.longest_scheme + 1:
            return None, colon + 1
        if text[start:colon].upper() not in self.schemes:
            return None, colon + 2  # the next character is not looked at
        end = max(last, colon) + 1
        return (start, end), end + 1

    def single(self, text: str, at: int) -> tuple[int, int] | None:
        """The URL that the dot or colon at a place makes, whatever stands before or after it."""
        if not 0 <= at < len(text) or text[at] not in ".:" or "\0" in text[:at]:
            return None
        _, first, last = self.chunk(text, at)
        return (self.at_dot(text, at, first, last) if text[at] == "." else self.at_colon(text, at, last))[0]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of URLs in the order of the dots and colons that make them. A domain reaches to the left over URLs before it, so they may overlap."""
        text = text.split("\0", 1)[0]
        found, end, first, last = [], 0, 0, 0
        m = TRIGGER.search(text)
        while m:
            at = m.start()
            if at >= end:
                end, first, last = self.chunk(text, at)
            span, goes_on = self.at_dot(text, at, first, last) if text[at] == "." else self.at_colon(text, at, last)
            if span:
                found.append(span)
            m = TRIGGER.search(text, goes_on)
        return found


def detector(domains: Iterable[str] | None, schemes: Iterable[str] | None) -> Detector:
    return Detector(TOP_LEVEL_DOMAINS if domains is None else domains, SCHEMES if schemes is None else schemes)


def candidates(text: Column, find: Detector) -> Column:
    """The text where a dot or colon in it may make a URL, null elsewhere: only such texts are handed to Python.

    A dot needs `www` before it or a known domain after it, a colon a known scheme before it.
    """
    one_of = lambda words: "|".join(map(re.escape, sorted(words))) or r"\P{Any}"
    dot = rf"\.(?:(?<=[Ww]{{3}}\.)|(?iu:{one_of(find.domains)})(?![\p{{L}}&&[^\x{{10000}}-\x{{10FFFF}}]]))"
    colon = rf":(?<=(?<![A-Za-z-])(?i:{one_of(find.schemes)}):)"
    return F.when((F.contains(text, F.lit(".")) & text.rlike(dot)) | (F.contains(text, F.lit(":")) & text.rlike(colon)), text)


def as_structs(texts: list[str], spans: list[list[tuple[int, int]]]) -> list[list[dict]]:
    return [[{"value": t[s:e], "start": s, "length": e - s} for s, e in x] for t, x in zip(texts, spans, strict=True)]


def extract_urls(text: Column, domains: Iterable[str] | None = None, schemes: Iterable[str] | None = None) -> Column:
    """Array of (value, start, length) in order, start from 0, in characters. Empty for a null text; what follows a NUL is not read."""
    find = detector(domains, schemes)

    @F.arrow_udf(returnType=SPAN)
    def urls(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        kind = pa.list_(pa.struct([("value", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        return pa.array(as_structs(texts, list(map(find.spans, texts))), kind)

    return urls(candidates(text, find))


def url_at(text: Column, position: Column, domains: Iterable[str] | None = None, schemes: Iterable[str] | None = None) -> Column:
    """(value, start, length) of the URL that the dot or colon at a position (from 0) makes; null if it makes none, and for nulls."""
    find = detector(domains, schemes)

    @F.arrow_udf(returnType="struct<value:string,start:int,length:int>")
    def url(column: pa.Array, places: pa.Array) -> pa.Array:
        texts, at = column.to_pylist(), places.to_pylist()
        spans = [None if t is None or p is None else find.single(t, p) for t, p in zip(texts, at, strict=True)]
        rows = [s and as_structs([t], [[s]])[0][0] for t, s in zip(texts, spans, strict=True)]
        return pa.array(rows, pa.struct([("value", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    return url(text, position.cast("int"))


def replaced(find: Detector, text: str) -> str:
    out, done = [], 0
    for s, e in sorted(find.spans(text)):
        if s >= done:
            out += [text[done:s], "\n"]
        done = max(done, e)
    return "".join([*out, text[done:]]) if out else text


def without_urls(text: Column, domains: Iterable[str] | None = None, schemes: Iterable[str] | None = None) -> Column:
    """The text with each URL (overlapping ones together) replaced by a line feed, a boundary that never makes a number skipped. Null stays null."""
    find = detector(domains, schemes)

    @F.arrow_udf(returnType="string")
    def rest(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else replaced(find, t) for t in column.to_pylist()], pa.string())

    return F.coalesce(rest(candidates(text, find)), text)

"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from wordloom.functions.characters import ENDING_SIGNS, KEPT_MARKS
from wordloom.functions.urls import SCHEMES, TOP_LEVEL_DOMAINS

#: Marks that do not end a word take private characters while what ends one is looked for.
STAND_INS = "".join(chr(0xE000 + i) for i in range(len(KEPT_MARKS)))
#: The soft hyphen is no punctuation.
PUNCTUATION = "".join(s for s, m in zip(STAND_INS, KEPT_MARKS, strict=True) if m != "­")
SPACE = r"\p{Z}\t-\r\x{85}"
EDGE = rf"[\x01{SPACE}]"
LETTER = r"[\p{L}\p{Nd}]"
DIGITS = 6


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(source: str, *keys: str) -> str:
    """CTE w: the keys and ws, the list of words of each row."""
    ended = rf"[\p{{P}}{ENDING_SIGNS}][\p{{P}}{PUNCTUATION}{SPACE}]*"
    return f"""m AS (
    SELECT {', '.join(keys)}, translate(regexp_replace(translate(coalesce(text, ''), {quoted(KEPT_MARKS)}, {quoted(STAND_INS)}), {quoted(ended)}, chr(1), 'g'),
                     {quoted(STAND_INS)}, {quoted(KEPT_MARKS)}) AS t FROM {source}
), x AS (
    SELECT {', '.join(keys)}, [x FOR x IN regexp_extract_all(t, {quoted(rf"[^\x01{SPACE}]+(?:{EDGE}|\z)")})
        IF NOT regexp_matches(x, {quoted(r"^[\p{Nd};,:./\\\-–〃´°]+ \z")})
           AND regexp_matches(x, {quoted(rf"(?s){LETTER}.*{LETTER}|\A{LETTER}{EDGE}?\z")})] AS xs FROM m
), w AS (
    SELECT {', '.join(keys)}, [replace(translate(upper(regexp_extract(x, {quoted(rf"(?s){LETTER}(?:.*{LETTER})?")})), 'ёЁ', 'ЕЕ'), 'ẞ', 'ß') FOR x IN xs] AS ws FROM x
)"""


#: Characters that a URL may reach over, and punctuation but the slash.
REACHED = r"(?:[^\p{Z}\p{P}\t-\r\x{85}]|[!-#%-*,-/:;?@\[-\]_{}])"
MARKS = r"[^\P{P}/]"


def urls(source: str, key: str, text: str) -> str:
    """CTEs up to found: (key, t, s, e), the URLs of each text from 0, the end not included.

    What each dot or colon makes and where the search goes on after it depends on its surroundings only; a walk over
    these pointers from the first one tells which of them are looked at.
    """
    domain = "(?:" + "|".join(sorted(TOP_LEVEL_DOMAINS, key=len, reverse=True)) + ")"
    schemes = "[" + ", ".join(quoted(s) for s in SCHEMES) + "]"
    return f"""tx AS (SELECT {key}, coalesce({text}, '') AS t0, split_part(coalesce({text}, ''), chr(0), 1) AS t FROM {source}),
tr AS (SELECT {key}, t, pos - 1 AS pos FROM (SELECT {key}, t, unnest([i FOR c, i IN string_split(t, '') IF c = '.' OR c = ':']) AS pos FROM tx)),
st AS (SELECT *, substr(t, pos + 1, 1) AS sign, substr(t, 1, pos) AS bef, substr(t, pos + 2) AS aft FROM tr),
ch AS (SELECT *, pos - length(regexp_extract(bef, {quoted(REACHED + "*$")})) AS beg, pos + 1 + length(regexp_extract(aft, {quoted("^" + REACHED + "*")})) AS stop FROM st),
ed AS (SELECT *, beg + length(regexp_extract(substr(t, beg + 1, stop - beg), {quoted("^" + MARKS + "*")})) AS lo,
       stop - 1 - length(regexp_extract(substr(t, beg + 1, stop - beg), {quoted(MARKS + "*$")})) AS hi,
       regexp_extract(aft, {quoted(rf"^((?i:(?:{domain}\.)*{domain}))(?:\P{{L}}|$)")}, 1) AS dom, regexp_extract(bef, '[A-Za-z-]*$') AS sch FROM ch),
ow AS (SELECT *, CASE WHEN contains(dom, '.') THEN pos + 1 + length(dom) - 1 - strpos(reverse(dom), '.') + 1 ELSE pos END AS own, pos + 1 + length(dom) AS past FROM ed),
kind AS (SELECT *, CASE
    WHEN sign = '.' AND upper(right(bef, 3)) = 'WWW' THEN 'www'
    WHEN sign = '.' AND (dom = '' OR regexp_matches(dom, '[ıſ]')) THEN 'skip'
    WHEN sign = '.' AND lo >= own THEN 'none'
    WHEN sign = '.' THEN 'domain'
    WHEN length(sch) NOT BETWEEN 1 AND {max(map(len, SCHEMES)) + 1} THEN 'none'
    WHEN NOT list_contains({schemes}, lower(sch)) THEN 'skip' ELSE 'scheme' END AS kind FROM ow),
sp AS (SELECT {key}, t, pos, kind, CASE kind WHEN 'www' THEN pos - 3 WHEN 'domain' THEN lo ELSE pos - length(sch) END AS s,
       CASE WHEN kind = 'domain' AND substr(t, past + 1, 1) NOT IN ('/', '\\') THEN past WHEN kind = 'domain' THEN hi + 1 ELSE greatest(hi, pos) + 1 END AS e FROM kind),
go AS (SELECT *, CASE kind WHEN 'none' THEN pos + 1 WHEN 'skip' THEN pos + 2 ELSE e + 1 END AS on_from FROM sp),
nx AS (SELECT go.*, n.pos AS following FROM go ASOF LEFT JOIN (SELECT {key}, pos FROM tr) n ON go.{key} = n.{key} AND go.on_from <= n.pos),
walk AS (SELECT {key}, min(pos) AS pos FROM tr GROUP BY {key} UNION ALL SELECT nx.{key}, nx.following FROM walk JOIN nx ON walk.{key} = nx.{key} AND walk.pos = nx.pos WHERE nx.following IS NOT NULL),
found AS (SELECT nx.{key}, nx.t, nx.pos, nx.s, nx.e FROM walk JOIN nx ON walk.{key} = nx.{key} AND walk.pos = nx.pos WHERE nx.kind NOT IN ('none', 'skip'))"""


def without_urls(source: str, key: str, *more: str) -> str:
    """CTEs up to clean: the key, further columns and text with a line feed for each URL, overlapping ones together."""
    columns = "".join(f", d.{c}" for c in more)
    return f"""{urls(source, key, 'text')},
runs AS (SELECT *, coalesce(max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM found),
kept_parts AS (SELECT {key}, string_agg(substr(t, done + 1, s - done) || chr(10), '' ORDER BY s, e) FILTER (s >= done) AS head, max(e) AS last FROM runs GROUP BY {key}),
clean AS (SELECT d.{key}{columns}, CASE WHEN p.last IS NULL THEN d.text ELSE p.head || substr(d.text, p.last + 1) END AS text FROM {source} d LEFT JOIN kept_parts p ON d.{key} = p.{key})"""


def ngrams(n: int) -> str:
    """The n-grams of ws."""
    return f"(CASE WHEN len(ws) >= {n} THEN [array_to_string(ws[i:i + {n - 1}], ' ') FOR i IN range(1, len(ws) - {n} + 2)] ELSE [] END)" if n > 1 else "ws"


def levels(*keys: str, n_max: int, source: str = "w") -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(keys)}, {n} AS n, unnest({ngrams(n)}) AS term FROM {source}" for n in range(1, n_max + 1))


def positions(source: str, *keys: str) -> str:
    cols = ", ".join(keys)
    return f"WITH {words(source, *keys)} SELECT {cols}, unnest(range(len(ws)))::INTEGER AS pos, unnest(ws) AS word FROM w"


def bag(n: int) -> str:
    return f"WITH {words('documents', 'doc_id')}, g AS ({levels('doc_id', n_max=n)}) SELECT doc_id, term, count(*) AS cnt FROM g GROUP BY ALL"


def class_counts(n_max: int, source: str = "documents", key: str = "lang") -> str:
    """CTEs up to c: (key, n, term, cnt)."""
    return f"{words(source, key)}, g AS ({levels(key, n_max=n_max)}), c AS (SELECT {key}, n, term, count(*) AS cnt FROM g GROUP BY ALL)"


def kept(cut: tuple[int, ...], key: str = "lang") -> str:
    """CTE k: what the cut by running mass leaves of c."""
    percent = "CASE n " + " ".join(f"WHEN {n} THEN {p}" for n, p in enumerate(cut, 1)) + " END"
    return f"""s AS (
    SELECT *, sum(cnt) OVER (PARTITION BY {key}, n ORDER BY cnt DESC, term ROWS UNBOUNDED PRECEDING) AS running, sum(cnt) OVER (PARTITION BY {key}, n) AS total FROM c
), k AS (
    SELECT {key}, n, term, cnt FROM s
    WHERE running::FLOAT <= (total::FLOAT * ({percent})::FLOAT)::FLOAT / 100::FLOAT
)"""


D1, D2 = (95, 50, 15, 5), (50, 15, 5, 2)
#: CTEs up to b, the bags of the model, and f, the frequencies of its terms.
BAGS = f"""{class_counts(2)}, {kept(D1)}, b AS MATERIALIZED (SELECT lang, term, sum(cnt)::BIGINT AS cnt FROM k GROUP BY ALL),
f AS (SELECT term, count(DISTINCT lang) AS df, sum(cnt)::BIGINT AS cf FROM b GROUP BY term),
lengths AS (SELECT lang, sum(len(ws))::BIGINT AS length FROM w GROUP BY lang),
classes AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), nc AS (SELECT count(*) AS n_classes FROM classes)"""


def tfidf(n_classes: str = "(SELECT n_classes FROM nc)") -> str:
    return f"""SELECT b.term, b.lang, (-(cnt::FLOAT / size::FLOAT)::FLOAT * ln((df::FLOAT / {n_classes}::FLOAT)::FLOAT)::FLOAT)::FLOAT AS weight
    FROM b JOIN f ON b.term = f.term JOIN (SELECT lang, count(*) AS size FROM b GROUP BY lang) z ON b.lang = z.lang"""


#: CTE v: the model, without terms that weigh the same in all classes.
MODEL = f"""{BAGS}, a AS MATERIALIZED ({tfidf()}),
u AS (SELECT term FROM a, nc GROUP BY term
      HAVING least(min(weight), CASE WHEN count(*) < any_value(n_classes) THEN 0 ELSE min(weight) END)
           < greatest(max(weight), CASE WHEN count(*) < any_value(n_classes) THEN 0 ELSE max(weight) END)),
v AS MATERIALIZED (SELECT a.* FROM a JOIN u ON a.term = u.term)"""
#: CTE q: cosines.
SCORES = f"""{MODEL}, norms AS (SELECT lang, sum((weight * weight)::DOUBLE) AS sq_len FROM v GROUP BY lang),
{words('documents', 'doc_id').replace('m AS (', 'dm AS (').replace('FROM m', 'FROM dm').replace('x AS (', 'dx AS (', 1).replace('FROM x', 'FROM dx').replace('w AS (', 'dw AS (')},
dg AS ({levels('doc_id', n_max=2, source='dw')}), db AS (SELECT doc_id, term, count(*) AS cnt FROM dg GROUP BY ALL),
dots AS (SELECT doc_id, lang, sum((weight * cnt::FLOAT)::DOUBLE) AS dot FROM db JOIN v ON db.term = v.term GROUP BY ALL),
own AS (SELECT doc_id, sum(cnt * cnt) AS own FROM db GROUP BY doc_id),
q AS (SELECT dots.doc_id, dots.lang, dot / nullif(sqrt(sq_len * own), 0) AS cosine
      FROM dots JOIN own ON dots.doc_id = own.doc_id JOIN norms ON dots.lang = norms.lang WHERE dot / nullif(sqrt(sq_len * own), 0) <> 0)"""
SHARES = f"{SCORES}, r AS (SELECT *, cosine / sum(cosine) OVER (PARTITION BY doc_id) * 100 AS percent FROM q)"
NUMBERED = f"{SHARES}, ids AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS class_id FROM classes), named AS (SELECT r.*, class_id, " \
           "coalesce((MAP {0: 'German', 1: 'English', 2: 'Spanish'})[class_id], '[class-index: ' || class_id || ']') AS class_name FROM r JOIN ids ON r.lang = ids.lang WHERE percent >= 10)"


def out(column: str) -> str:
    return f"round({column}::DOUBLE, {DIGITS}) + 0.0 AS {column.split('.')[-1]}"


PLACES = f"WITH {SCORES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, lang)::INTEGER AS place FROM q)"

#: CTE r for trigrams of texts without URLs.
CLEAN_SHARES = (SHARES.replace(class_counts(2), class_counts(3, source="clean")).replace(levels("doc_id", n_max=2, source="dw"), levels("doc_id", n_max=3, source="dw"))
                .replace("FROM documents\n), dx", "FROM clean\n), dx"))

ORACLE_SQL: dict[str, str] = {
    "urls_extract": f"WITH RECURSIVE {urls('pages', 'page_id', 'html')} SELECT page_id, substr(t, s + 1, e - s) AS value, s::INTEGER AS start, (e - s)::INTEGER AS length FROM found",
    "tokens_no_urls": f"WITH RECURSIVE {without_urls('documents', 'doc_id')}, {words('clean', 'doc_id')} SELECT doc_id, unnest(range(len(ws)))::INTEGER AS pos, unnest(ws) AS word FROM w",
    "classify_report": f"WITH RECURSIVE {without_urls('documents', 'doc_id', 'lang')}, {CLEAN_SHARES} SELECT doc_id, lang, {out('cosine')}, {out('percent')} FROM r WHERE percent >= 10",
    "tokens": positions("documents", "doc_id"),
    "tokens_conversations": positions("conversations", "conv_id", "turn"),
    "tokens_benchmark": positions("benchmark", "item_id"),
    "tf_unigram": bag(1), "tf_ngram_2": bag(2), "tf_ngram_3": bag(3), "tf_ngram_4": bag(4),
    "tf_by_class": f"WITH {class_counts(3)} SELECT * FROM c",
    "tf_merged": f"WITH {class_counts(2, source="(SELECT lang, text FROM documents UNION ALL SELECT 'en', text FROM benchmark)")} SELECT * FROM c",
    "tf_cut_d1": f"WITH {class_counts(3)}, {kept(D1)} SELECT * FROM k",
    "tf_cut_d2": f"WITH {class_counts(3)}, {kept(D2)} SELECT * FROM k",
    "tf_cut_in_order": f"""WITH {class_counts(1)}, s AS (
    SELECT *, sum(cnt) OVER (PARTITION BY lang, n ORDER BY term ROWS UNBOUNDED PRECEDING) AS running, sum(cnt) OVER (PARTITION BY lang, n) AS total FROM c
) SELECT lang, n, term, cnt FROM s WHERE running::FLOAT <= (total::FLOAT * {D2[0]}::FLOAT)::FLOAT / 100::FLOAT""",
    "class_lengths": f"WITH {words('documents', 'lang')} SELECT lang, sum(len(ws))::BIGINT AS length FROM w GROUP BY lang",
    "average_length": f"WITH {BAGS} SELECT round(avg(length), {DIGITS}) AS average FROM lengths",
    "vocabulary": f"WITH {BAGS} SELECT DISTINCT term FROM b",
    "term_frequencies": f"WITH {BAGS} SELECT * FROM f",
    "weights_tfidf": f"WITH {BAGS}, a AS ({tfidf()}) SELECT term, lang, {out('weight')} FROM a",
    "weights_bm25": f"""WITH {BAGS}, a AS (
    SELECT b.term, b.lang, (3 * cnt / (2 * (0.25::DOUBLE + 0.75::DOUBLE * length / (SELECT avg(length) FROM lengths)) + cnt))::FLOAT
        * ln(((n_classes - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT)::FLOAT AS weight
    FROM b JOIN f ON b.term = f.term JOIN lengths ON b.lang = lengths.lang, nc) SELECT term, lang, {out('weight')} FROM a""",
    "weights_r_tfidf": f"""WITH {BAGS}, i AS (
    SELECT term, (-ln((df::FLOAT / n_classes::FLOAT)::FLOAT))::FLOAT AS idf, (-ln(1 - exp((-cf::DOUBLE / n_classes)::FLOAT::DOUBLE)))::FLOAT AS expected FROM f, nc
), a AS (SELECT i.term, classes.lang, CASE WHEN b.term IS NULL THEN idf ELSE (idf - expected)::FLOAT END AS weight
    FROM i CROSS JOIN classes LEFT JOIN b ON b.term = i.term AND b.lang = classes.lang) SELECT term, lang, {out('weight')} FROM a""",
    "weights_informative": f"WITH {MODEL} SELECT term, lang, {out('weight')} FROM v",
    "weights_dense": f"""WITH {MODEL}, d AS (SELECT t.term, classes.lang, coalesce(weight, 0) AS weight
    FROM (SELECT DISTINCT term FROM v) t CROSS JOIN classes LEFT JOIN v ON v.term = t.term AND v.lang = classes.lang) SELECT term, lang, {out('weight')} FROM d""",
    "weights_by_quality": f"""WITH {class_counts(1, source='(SELECT quality, text FROM documents JOIN labels USING (doc_id))', key='quality')},
lengths AS (SELECT quality, sum(len(ws)) AS length FROM w GROUP BY quality), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
a AS (SELECT c.term, c.quality, (3 * cnt / (2 * (0.25::DOUBLE + 0.75::DOUBLE * length / (SELECT avg(length) FROM lengths)) + cnt))::FLOAT
        * ln(((2 - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT)::FLOAT AS weight
      FROM c JOIN f ON c.term = f.term JOIN lengths ON c.quality = lengths.quality),
u AS (SELECT term FROM a GROUP BY term HAVING least(min(weight), CASE WHEN count(*) < 2 THEN 0 ELSE min(weight) END) < greatest(max(weight), CASE WHEN count(*) < 2 THEN 0 ELSE max(weight) END))
SELECT term, quality, {out('weight')} FROM a JOIN u USING (term)""",
    "one_dimension_tfidf": f"WITH {BAGS}, a AS ({tfidf('100')}) SELECT term, lang, {out('weight')} FROM a WHERE lang = 'en'",
    "class_norms": f"WITH {MODEL} SELECT lang, round(sum((weight * weight)::DOUBLE), {DIGITS}) + 0.0 AS sq_len FROM v GROUP BY lang",
    "dot_products": f"WITH {SCORES} SELECT doc_id, lang, {out('dot')} FROM dots",
    "cosine_scores": f"WITH {SCORES} SELECT doc_id, lang, {out('cosine')} FROM q",
    "score_report": f"WITH {SHARES} SELECT doc_id, lang, {out('cosine')}, {out('percent')} FROM r WHERE percent >= 10",
    "score_rank": f"{PLACES} SELECT doc_id, lang, {out('cosine')}, place FROM p",
    "top_class": f"{PLACES} SELECT doc_id, lang, {out('cosine')} FROM p WHERE place = 1",
    "residual_share": f"WITH {SHARES} SELECT doc_id, 'other' AS class_name, round(100 - sum(percent), {DIGITS}) + 0.0 AS percent FROM r WHERE percent >= 30 GROUP BY doc_id",
    "evaluation": f"""{PLACES}, j AS (SELECT d.lang AS actual, p.lang AS guess FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id AND place = 1),
e AS (SELECT c.class, (SELECT count(*) FROM j WHERE actual = c.class AND guess = c.class) AS true_positive, (SELECT count(*) FROM j WHERE guess = c.class) AS predicted,
      (SELECT count(*) FROM j WHERE actual = c.class) AS actual FROM (SELECT actual AS class FROM j WHERE actual IS NOT NULL UNION SELECT guess FROM j WHERE guess IS NOT NULL) c)
SELECT *, round(true_positive / nullif(predicted, 0), {DIGITS}) AS precision, round(true_positive / nullif(actual, 0), {DIGITS}) AS recall FROM e""",
    "class_names": f"WITH {NUMBERED} SELECT doc_id, class_id, class_name FROM named",
    "json_result": f"""WITH {NUMBERED} SELECT doc_id, to_json(list(struct_pack(i := class_id, n := class_name, p := format('{{:,.2f}}', round(percent, 2))) ORDER BY cosine DESC, class_id))::VARCHAR AS json
FROM named GROUP BY doc_id""",
    "text_preview": """SELECT doc_id, replace(translate(CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END, chr(13) || chr(10) || chr(9), '   '), '  ', ' ') AS preview,
    length(substring(text, 1, 10000))::INTEGER AS limited FROM documents""",
    "percent_text": "SELECT event_id, format('{:,.2f}', round(value, 2)) AS shown FROM events",
    "model_round_trip": f"""WITH {MODEL}, ids AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS class_id FROM classes)
SELECT t.term, class_id, round(coalesce(weight, 0)::DOUBLE, {DIGITS}) + 0.0 AS weight
FROM (SELECT DISTINCT term FROM v) t CROSS JOIN ids LEFT JOIN v ON v.term = t.term AND v.lang = ids.lang""",
    "request_counts": """WITH RECURSIVE e AS (
    SELECT user_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), o AS (
    SELECT user_id, min(us) AS opened FROM e GROUP BY user_id
    UNION ALL
    SELECT o.user_id, (SELECT min(us) FROM e WHERE e.user_id = o.user_id AND us >= o.opened + 600000000) FROM o
    WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = o.user_id AND us >= o.opened + 600000000)
) SELECT o.user_id, make_timestamp(opened) AS opened, count(*) AS requests
FROM o JOIN e ON e.user_id = o.user_id AND us >= opened AND us < opened + 600000000 GROUP BY ALL""",
    "request_bans": """WITH RECURSIVE e AS (
    SELECT user_id::VARCHAR AS key, ts, epoch_us(ts) / 1e6::DOUBLE AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), s AS (
    SELECT key, ts, now, k, 'admitted' AS outcome, 0::DOUBLE AS wait, 1 AS requests, false AS banned, now AS since, now + 600 AS until FROM e WHERE k = 1
    UNION ALL
    SELECT key, ts, now, k, outcome, wait, CASE outcome WHEN 'admitted' THEN CASE WHEN fresh THEN 1 ELSE requests + 1 END WHEN 'banned' THEN requests ELSE 1 END, outcome = 'banned',
           CASE outcome WHEN 'admitted' THEN CASE WHEN fresh THEN now ELSE since END WHEN 'banned' THEN now ELSE now + wait END,
           CASE outcome WHEN 'admitted' THEN CASE WHEN fresh THEN now + 600 ELSE until END WHEN 'banned' THEN now + 1200 + 1 ELSE now + wait + 600 END
    FROM (SELECT *, CASE outcome WHEN 'admitted' THEN 0::DOUBLE WHEN 'banned' THEN 1200::DOUBLE ELSE greatest(1::DOUBLE, remaining) END AS wait
          FROM (SELECT *, CASE WHEN fresh OR NOT banned AND requests < 3 THEN 'admitted' WHEN remaining > 3 THEN 'banned' ELSE 'waited' END AS outcome
                FROM (SELECT e.key, e.ts, e.now, e.k, s.requests, s.banned, s.since, s.until, e.now >= s.until AS fresh,
                             greatest(0::DOUBLE, CASE WHEN s.banned THEN 1200 - (e.now - s.since) ELSE 600 - (e.now - s.since) + 1 END) AS remaining
                      FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)))
) SELECT key, ts AS at, outcome, wait FROM s""",
}
LONG_BANS = ORACLE_SQL["request_bans"].replace("1200", "259200").replace("600", "604800")
BANNED = f"""(SELECT DISTINCT key, epoch_us("at") AS since FROM ({LONG_BANS}) WHERE outcome = 'banned')"""
ORACLE_SQL |= {
    "requests_in_bans": f"""SELECT e.event_id, count(*) AS bans FROM events e
JOIN (SELECT key, epoch_us("at") AS since FROM ({LONG_BANS}) WHERE outcome = 'banned') b
    ON b.key = e.user_id::VARCHAR AND epoch_us(e.ts) > b.since AND epoch_us(e.ts) < b.since + 259201000000 GROUP BY e.event_id""",
    "last_ban": f"""SELECT e.event_id, coalesce(b.since, -1) AS since FROM (SELECT event_id, user_id::VARCHAR AS key, epoch_us(ts) AS us FROM events) e
ASOF LEFT JOIN {BANNED} b ON e.key = b.key AND e.us >= b.since""",
    "request_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS since FROM e),
s AS (SELECT *, count(*) FILTER (since > 21600000000) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, make_timestamp(min(us)) AS begin, make_timestamp(max(us) + 21600000000) AS "end", count(*) AS requests FROM s GROUP BY user_id, k""",
    "request_answers": """SELECT c.user_id AS key, c.event_id AS request, c.ts AS "at", coalesce(p.event_id, -1) AS answer
FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 DAY""",
    "top_terms": f"""WITH {class_counts(3)}, p AS (SELECT *, row_number() OVER (PARTITION BY lang, n ORDER BY cnt DESC, term)::INTEGER AS place FROM c)
SELECT lang, n, term, cnt, place FROM p WHERE place <= 100""",
    "totals_cube": f"""WITH {words("documents", "lang", "source")}, z AS (SELECT lang, source, n, greatest(len(ws) - n + 1, 0) AS k FROM w, (VALUES (1), (2), (3)) v(n))
SELECT lang, source, coalesce(n, 0)::INTEGER AS n, GROUPING(lang, source, n)::BIGINT AS grouping, count(*) AS documents, sum(k)::BIGINT AS terms FROM z GROUP BY CUBE (lang, source, n)""",
    "sketch_errors": f"""WITH {class_counts(1)} SELECT lang, count(*) AS words, true AS vocabulary_close, true AS counts_close, true AS lengths_close FROM c GROUP BY lang""",
    "model_streamed": ORACLE_SQL["weights_informative"],
    "cosine_scores_stored": ORACLE_SQL["cosine_scores"],
}

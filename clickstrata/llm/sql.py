"""DuckDB SQL for the queries that plain SQL can express; written from their contracts, not from their operators.

What is a parameter of an operator (thresholds, license templates) comes from its module.
"""

import numpy as np

from . import licenses, quality, sharding
from .hashing import mix

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"


def _escaped(column: str) -> str:
    """Length of a string whose five control characters take two places each."""
    return f"(length({column}) + length(regexp_replace({column}, '[^\\\\<>\\[\\]]', '', 'g')))"


NGRAM_JACCARD = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i, len(l) AS n
    FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK}') AS l FROM documents)
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, i, n, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words
    ) WHERE i <= greatest(n - 4, 1)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT o.a, o.b FROM common o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b WHERE 100 * o.n >= 80 * (x.n + y.n - o.n)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, coalesce(l.n, 0) AS n_links
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
"""

CHAT_FORMAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<s>[] ' || ' </s>') + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH pieces AS (
    SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS k
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}|{_GAP}') AS l FROM documents)
), placed AS (
    SELECT doc_id, k, piece, regexp_full_match(piece, '{_WORD}') AS is_word, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM pieces
), words AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, stop - length(piece) AS start, stop, {_LOWER.replace("coalesce(text, '')", "piece")} AS w FROM placed WHERE is_word
), item_words AS (
    SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS i, len(l) AS n
    FROM (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS l FROM benchmark)
), windows AS (
    SELECT DISTINCT item_id, ws, len(ws) AS size FROM (
        SELECT item_id, i, n, list(w) OVER (PARTITION BY item_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM item_words
    ) WHERE i <= greatest(n - 9, 1)
), ahead AS (
    SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM words
), found AS (
    SELECT a.doc_id, a.i, t.size, t.item_id FROM (
        SELECT ahead.doc_id, ahead.i, s.size, ahead.ws[1:s.size] AS ws FROM ahead JOIN (SELECT DISTINCT size FROM windows) s ON len(ahead.ws) >= s.size
    ) a JOIN windows t ON t.ws = a.ws
), hit AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS i FROM found
), runs AS (
    SELECT doc_id, min(start) AS a, max(stop) AS b FROM (
        SELECT h.doc_id, w.start, w.stop, h.i - row_number() OVER (PARTITION BY h.doc_id ORDER BY h.i) AS run FROM hit h JOIN words w ON w.doc_id = h.doc_id AND w.i = h.i
    ) GROUP BY doc_id, run
), spans AS (
    SELECT doc_id, string_agg(CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS named FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(w.n, 0) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.named, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AS contaminated, coalesce(s.spans, '') AS spans
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id) w USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id) h USING (doc_id) LEFT JOIN items m USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""

_METRIC = {
    "symbol_ratio": "n_symbols / word_chars",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
    "word_length": "word_chars / n_words",
}


def _values(table: dict) -> str:
    return ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in table.items())


QUALITY_RULES = rf"""
WITH listed AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS ws FROM documents
), words AS (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed
), triples AS (
    SELECT doc_id, i, [w, lead(w) OVER o, lead(w, 2) OVER o] AS t, lead(w, 2) OVER o IS NOT NULL AS whole FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), again AS (
    SELECT doc_id, i FROM triples WHERE whole QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1
), repeated AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n, count(DISTINCT line) AS different FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM listed) WHERE regexp_matches(line, '{_BLANK}') GROUP BY doc_id
), metrics AS (
    SELECT l.doc_id, lang, source, len(ws) AS n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n.n - n.different, 0) AS n_dup_lines, coalesce(n.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM listed l LEFT JOIN lines n USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM metrics
), ratios AS (
    SELECT doc_id, lang, source, base_failed, unnest([{", ".join(f"struct_pack(metric := '{k}', value := coalesce(CASE WHEN {v.split(' / ')[1]} > 0 THEN {v.replace(' / ', '::DOUBLE / ')} END, 0.0))" for k, v in _METRIC.items())}], recursive := true) FROM judged
), buckets AS (
    SELECT lang, source, metric, CASE WHEN value > 0 THEN cast(ceil(ln(value) / ln({quality.GAMMA})) AS BIGINT) END AS bucket, count(*) AS n FROM ratios WHERE NOT base_failed GROUP BY ALL
), sketches AS (
    SELECT 1 AS level, lang, source, metric, bucket, n FROM buckets
    UNION ALL SELECT 2, lang, NULL, metric, bucket, sum(n) FROM buckets GROUP BY ALL
    UNION ALL SELECT 3, NULL, NULL, metric, bucket, sum(n) FROM buckets GROUP BY ALL
), ranked AS (
    SELECT *, sum(n) OVER (o ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS below, sum(n) OVER o AS total FROM sketches WINDOW o AS (PARTITION BY level, lang, source, metric)
), learnt AS (
    SELECT level, lang, source, metric, min(CASE WHEN bucket IS NULL THEN 0.0 ELSE pow({quality.GAMMA}, bucket) * (2 / (1 + {quality.GAMMA})) END) AS value, any_value(total) AS total
    FROM ranked WHERE below >= greatest(floor(total * {quality.QUANTILE}), 1) GROUP BY ALL
), params AS (
    SELECT f.metric, factor, floor_ FROM (VALUES {_values(quality.FACTORS)}) f(metric, factor) JOIN (VALUES {_values(quality.FLOORS)}) g(metric, floor_) USING (metric)
), wider AS (
    SELECT o.*, factor, floor_, CASE WHEN l.total >= {quality.MIN_ROWS} THEN l.value ELSE a.value END AS wide
    FROM (FROM learnt WHERE level = 1) o JOIN (FROM learnt WHERE level = 2) l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN (FROM learnt WHERE level = 3) a ON o.metric = a.metric JOIN params ON params.metric = o.metric
), limits AS (
    SELECT lang, source, metric, greatest(CASE WHEN total >= {quality.MIN_ROWS} THEN least(value, greatest(wide, floor_) * {quality.SPREAD}) ELSE wide END * factor, floor_) AS bound FROM wider
), over_ AS (
    SELECT DISTINCT r.doc_id FROM ratios r JOIN limits l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source AND r.metric = l.metric WHERE value > bound
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over_) AS kept FROM judged
"""

#: Pairs within one edit share the first or the second half of the shorter line.
LINE_DEDUP = rf"""
WITH cut AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), normal AS (
    SELECT doc_id, pos, lower(trim(line, ' ')) AS line FROM cut WHERE regexp_matches(line, '{_BLANK}')
), firsts AS (
    SELECT line, length(line) AS n, arg_min(doc_id, (doc_id, pos)) AS doc_id, min((doc_id, pos)) AS at FROM normal GROUP BY line
), longer AS (
    SELECT *, unnest([n, n - 1]) AS m FROM firsts WHERE n >= 32
), pairs AS (
    SELECT a.line AS x, b.line AS y, a.at AS xa, b.at AS ya FROM firsts a JOIN longer b ON a.n = b.m AND left(a.line, a.n // 2) = left(b.line, b.m // 2) AND a.n >= 32
    UNION SELECT a.line, b.line, a.at, b.at FROM firsts a JOIN longer b ON a.n = b.m AND right(a.line, a.n - a.n // 2) = right(b.line, b.m - b.m // 2) AND a.n >= 32
), near AS (
    SELECT DISTINCT CASE WHEN xa < ya THEN y ELSE x END AS line FROM pairs WHERE x <> y AND levenshtein(x, y) <= 1
), gone AS (
    SELECT n.doc_id, n.pos FROM normal n JOIN firsts f USING (line) LEFT JOIN near ON near.line = n.line WHERE near.line IS NOT NULL OR f.at <> (n.doc_id, n.pos)
), kept AS (
    SELECT c.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (g.pos IS NULL) AS text FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.pos = c.pos GROUP BY c.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({t}, '{label}', '{text}', '{phrase}')" for t, (label, text, phrase) in enumerate(licenses.TEMPLATES))
LICENSE_SCAN = rf"""
WITH files AS (
    SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents
), tokens AS (
    SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM files
), base(phrase, label) AS (VALUES {", ".join(f"('{p}', '{label}')" for p, label in licenses.BASE.items())}),
starts AS (
    SELECT t.r, t.pos, b.label FROM tokens t JOIN base b ON t.word = split_part(b.phrase, ' ', 1) JOIN files f USING (r)
    WHERE f.ws[t.pos + 1 : t.pos + len(string_split(b.phrase, ' '))] = string_split(b.phrase, ' ')
), found AS (
    SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM starts GROUP BY r
), templates(t, label, body, phrase) AS (VALUES {_TEMPLATES}),
placed AS (
    SELECT t, label, phrase, unnest(string_split(body, ' ')) AS word, generate_subscripts(string_split(body, ' '), 1) - 1 AS tpos FROM templates
), index_ AS (
    SELECT * FROM placed WHERE word NOT IN ({", ".join(f"'{w}'" for w in sorted(licenses.FUNCTION_WORDS))})
), sizes AS (
    SELECT t, least({licenses.RARE}, count(DISTINCT word)) AS wanted FROM index_ GROUP BY t
), frequency AS (
    SELECT word, count(DISTINCT {_LOWER}) AS df FROM tokens JOIN files USING (r) WHERE word IN (SELECT word FROM index_) GROUP BY word
), shared AS (
    SELECT DISTINCT r, t, word, df FROM tokens JOIN index_ USING (word) JOIN frequency USING (word)
), rare AS (
    SELECT r, t, word FROM shared QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY df, word) <= {licenses.RARE}
), votes AS (
    SELECT r, t, max(n) AS n FROM (SELECT r, t, pos - tpos, count(DISTINCT word) AS n FROM rare JOIN tokens USING (r, word) JOIN index_ USING (t, word) GROUP BY ALL) GROUP BY ALL
), scored AS (
    SELECT r, label, phrase, n / wanted AS score FROM votes JOIN sizes USING (t) JOIN templates USING (t)
), told AS (
    SELECT r, max(score) AS score, list(DISTINCT label) FILTER (score >= {licenses.MIN_SCORE} AND contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')) AS labels FROM scored JOIN files USING (r) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(f.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(f.labels, []), coalesce(t.labels, [])))), ','), '') AS labels, coalesce(t.score, 0.0) AS score
FROM files LEFT JOIN found f USING (r) LEFT JOIN told t USING (r)
"""


def _mixed(x: str) -> str:
    """The splitmix64 finaliser of an unsigned expression, as a scalar subquery chain."""
    wrap = "18446744073709551616::UHUGEINT"
    times = lambda z, c: f"(({z})::UHUGEINT * {c}::UHUGEINT % {wrap})::UBIGINT"
    fold = lambda z, k: f"xor({z}, {z} >> {k})"
    a = f"(SELECT {times(fold('z', 30), 13787848793156543929)} FROM (SELECT (({x}) % {wrap})::UBIGINT AS z))"
    b = f"(SELECT {times(fold('z', 27), 10723151780598845931)} FROM (SELECT {a} AS z))"
    return f"(SELECT {fold('z', 31)} FROM (SELECT {b} AS z))"


_KEYS = ", ".join(str(int(k)) for k in mix(np.arange(1, sharding.ROUNDS + 1, dtype=np.uint64) + np.uint64(sharding.SEED)))
FEISTEL_SHARDS = rf"""
WITH RECURSIVE polynomial AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) r(b)
), rows_ AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS crc
    FROM documents, polynomial
), numbered AS (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS number, (SELECT count(*) FROM documents) AS total FROM rows_
), shaped AS (
    SELECT *, greatest(1, (length(ltrim(bin(greatest(total, 2) - 1), '0')) + 1) // 2)::INTEGER AS half FROM numbered
), walk AS (
    SELECT number, total, half, 0 AS round, (number >> half)::UBIGINT AS l, (number & ((1 << half) - 1))::UBIGINT AS r FROM shaped
    UNION ALL
    SELECT number, total, half, CASE WHEN round = {sharding.ROUNDS} THEN 0 ELSE round + 1 END, CASE WHEN round = {sharding.ROUNDS} THEN l ELSE r END,
        CASE WHEN round = {sharding.ROUNDS} THEN r ELSE xor(l, {_mixed(f"r::UHUGEINT + [{_KEYS}][round + 1]::UHUGEINT")} & ((1::UBIGINT << half::UBIGINT) - 1)::UBIGINT) END
    FROM walk WHERE round < {sharding.ROUNDS} OR ((l << half::UBIGINT) | r) >= total
), placed AS (
    SELECT number, ((l << half::UBIGINT) | r)::BIGINT AS p FROM walk WHERE round = {sharding.ROUNDS} AND ((l << half::UBIGINT) | r) < total
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (p % {sharding.SHARDS})::INTEGER AS shard, p // {sharding.SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM numbered JOIN placed USING (number)
"""


#: A word equal to the one q words before it, without a gap: each unbroken row of such places is a run, of its least q.
PERIODIC_RUNS = rf"""
WITH polynomial AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) r(b)
), listed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS ws, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(doc_id || ''), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
    FROM documents, polynomial
), shaped AS (
    SELECT doc_id, ws, h, len(ws) AS n, CASE WHEN len(ws) > 0 THEN h // 10 % len(ws) ELSE 0 END AS a FROM listed
), shifted AS (
    SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM shaped
), words AS (
    SELECT doc_id, i, ws[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM shifted)
), same AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i
), stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY ALL
), told AS (
    SELECT doc_id, count(*) AS n_runs, arg_min((start, length, period), (-length, start, period)) AS longest, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT doc_id, count(*) AS n_words, count(gone.i) AS n_dropped, string_agg(w, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS text FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, longest[1] AS start, longest[2] AS length, longest[3] AS period, 1000 * longest[2] // longest[3] AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256, coalesce(n_words, 0) AS n_words, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN told t USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


#: Every page of the tables has one article, of headings and paragraphs; references are those that occur there.
HTML_TEXT = r"""
WITH articles AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1) AS body FROM pages
), bare AS (
    SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(?:b|i|a|em|span|strong)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM articles
), decoded AS (
    SELECT page_id, url, regexp_replace(replace(replace(regexp_replace(body, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS body FROM bare
), told AS (
    SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM decoded
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM told
"""


RANKED_SEARCH = rf"""
WITH listed AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents
), sizes AS (
    SELECT doc_id, len(ws)::BIGINT AS n FROM listed WHERE len(ws) > 0
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), tf AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM listed) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), asked AS (
    SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS term FROM benchmark) GROUP BY ALL
), scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL
)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""

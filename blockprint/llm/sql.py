"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from blockprint.llm.common import WORD_PATTERN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')"

#: Pairs by shared shingles, then everything that links reach.
JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN least ON least.a = d.doc_id"""

#: Every string of 50 bytes, as hexadecimal digits, and the smallest document that has it.
STRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
least AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM starts JOIN least USING (s) WHERE first < doc_id),
bytes_ AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS b FROM (SELECT doc_id, regexp_extract_all(h, '..') AS p FROM d)),
marked AS (SELECT b.doc_id AS doc_id, k, b, coalesce(max(i) OVER (PARTITION BY b.doc_id ORDER BY k) > k - 50, false) AS g FROM bytes_ b LEFT JOIN gone ON gone.doc_id = b.doc_id AND i = k),
edges AS (SELECT *, lag(g, 1, false) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM marked),
done AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE g) AS r, count(*) FILTER (WHERE g AND NOT before) AS spans, coalesce(string_agg(b, '' ORDER BY k) FILTER (WHERE NOT g), '') AS kept FROM edges GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN done ON done.doc_id = d.doc_id"""

WINDOWS = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM starts JOIN twice USING (s)),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM d),
marked AS (SELECT b.doc_id AS doc_id, k, word, coalesce(max(i) OVER (PARTITION BY b.doc_id ORDER BY k) > k - 35, false) AS g FROM words b LEFT JOIN gone ON gone.doc_id = b.doc_id AND i = k),
done AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE g) AS r, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT g), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN done ON done.doc_id = d.doc_id"""

ARCHIVES = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
g AS (SELECT raw, max(page_id) AS first FROM p WHERE octet_length(raw) >= 1000 GROUP BY raw)
SELECT page_id, cast(octet_length(p.raw) AS bigint) AS payload_bytes, sha1(p.raw) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN g ON g.raw = p.raw"""

#: Shares by weight, cut at twice a source's size as long as any is above; then the seeded order's documents up to where
#: their sum is nearest to the rest of the target.
MIX = f"""WITH RECURSIVE d AS (SELECT doc_id, source, cast(len({WORDS}) AS BIGINT) AS size, md5(concat_ws('|', '17', coalesce(cast(doc_id AS VARCHAR), '-'), md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS words, ([3, 1, 2])[cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM d GROUP BY source),
fill AS (SELECT 0 AS k, cast(sum(words) AS DOUBLE) * 150 / 100 / sum(weight) AS unit FROM s
UNION ALL SELECT k + 1, coalesce(((SELECT cast(sum(words) AS DOUBLE) * 150 / 100 FROM s) - sum(CASE WHEN unit * weight > 2 * words THEN 2 * words ELSE 0 END)) / nullif(sum(CASE WHEN unit * weight > 2 * words THEN 0 ELSE weight END), 0), unit) FROM fill, s WHERE k < (SELECT count(*) FROM s) GROUP BY k, unit),
last AS (SELECT unit FROM fill ORDER BY k DESC LIMIT 1),
targets AS (SELECT source, words, CASE WHEN unit * weight > 2 * words THEN cast(2 * words AS DOUBLE) ELSE unit * weight END AS target FROM s, last),
takes AS (SELECT *, least(cast(round_even(target, 0) AS BIGINT), 2 * words) AS take FROM targets),
rests AS (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 1 END AS whole FROM takes),
placed AS (SELECT d.*, words, target, whole, take - whole * words AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN rests ON d.source IS NOT DISTINCT FROM rests.source),
repeated AS (SELECT *, cast(whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM placed)
SELECT doc_id, size, words AS source_size, target, size * repeats AS taken, repeats FROM repeated"""

"""SQL of the longer queries, over the same tables, by plainer ways than the operators'."""

from __future__ import annotations

from tidegrid.llm.license_rules import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Word by word with crc32 from its table of 256 remainders; near words by deleting one code point of both.
SPELLING = f"""
WITH RECURSIVE bits AS (
  SELECT v, 0 AS k, CAST(v AS BIGINT) AS c FROM range(256) t(v)
  UNION ALL
  SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
remainders AS MATERIALIZED (SELECT list(c ORDER BY v) AS rest FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS m FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, m, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(key)), lambda i:         CAST(('0x' || hex(key)[2 * i + 1 : 2 * i + 2]) AS BIGINT))),
      lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs), remainders),
words AS MATERIALIZED (
  SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (
    SELECT m, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cuts AS MATERIALIZED (
  SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 2)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b USING (cut)
  WHERE a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1 AND (
    (length(a.word) <> length(b.word) AND cut IN (a.word, b.word))
    OR (length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1),
        lambda i: a.word[i] <> b.word[i])) = 1))),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS top, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY word),
found AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form,
         CASE WHEN top >= 5 * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)),
ways AS (
  SELECT word, word AS up FROM found
  UNION ALL
  SELECT w.word, f.form FROM ways w JOIN found f ON f.word = w.up WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.up AS root, f.n, f.n_near, f.form_n
FROM found f JOIN ways w USING (word) JOIN found l ON l.word = w.up AND l.form IS NULL"""


def _assigned(books: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
    FROM comps c JOIN {books} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""


def _moved(books: str, assigned: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(y, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS y
    FROM comps JOIN {assigned} USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos))"""


CODES = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (
  SELECT vec_id, (i * 16) // len(v) AS part, i % (len(v) // 16) AS pos,
         CAST(floor(256 * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(len(v))) AS i FROM kept)),
b0 AS MATERIALIZED (
  SELECT part, entry, pos, x FROM comps JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_assigned("b0", "a0")},
{_moved("b0", "a0", "b1")},
{_assigned("b1", "a1")},
{_moved("b1", "a1", "b2")},
{_assigned("b2", "a2")},
coded AS (
  SELECT vec_id, string_agg(right('0' || lower(to_hex(entry)), 2), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""


def licenses_sql() -> str:
    """The rules tried one by one on every text that holds their keyword."""
    rows = ",\n".join(
        f"({r.number}, '{r.label}', {r.priority}, CAST({r.score} AS DOUBLE), '{r.keyword}', '{r.pattern}', {r.base})"
        for r in RULES
    )
    return f"""
WITH rules(number, label, priority, score, keyword, pattern, base) AS (VALUES {rows}),
texts AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS core FROM documents),
keyed AS (SELECT DISTINCT r, unnest(string_split(core, '  ')) AS keyword FROM texts),
tried AS (
  SELECT r, number, string_split_regex(' ' || core || ' ', pattern) AS gaps,
         regexp_extract_all(' ' || core || ' ', pattern) AS hits
  FROM keyed JOIN rules USING (keyword) JOIN texts USING (r)),
lengths AS (
  SELECT r, number, list_transform(gaps, lambda x: length(x) - length(replace(x, ' ', ''))) AS gaps,
         list_transform(hits, lambda x: length(x) - length(replace(x, ' ', ''))) AS hits
  FROM tried WHERE len(hits) > 0),
places AS (
  SELECT r, number, hits[j] AS width, list_sum(gaps[1:j]) + coalesce(list_sum(hits[1:j-1]), 0) AS blanks
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM lengths)),
spans AS MATERIALIZED (
  SELECT r, number, label, priority, score, base, CAST(blanks AS BIGINT) // 2 AS first,
         CAST(blanks + width AS BIGINT) // 2 - 1 AS last
  FROM places JOIN rules USING (number)),
kept AS (
  SELECT * FROM spans a WHERE base OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.r = a.r AND b.first <= a.first AND b.last >= a.last AND b.priority >= a.priority
      AND (b.first < a.first OR b.last > a.last OR b.priority > a.priority OR b.number < a.number))),
facts AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM kept GROUP BY r)
SELECT doc_id, CAST(CASE WHEN core = '' THEN 0 ELSE (length(core) - length(replace(core, '  ', ''))) // 2 + 1 END AS BIGINT) AS n_words,
       coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN facts USING (r)"""

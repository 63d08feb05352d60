"""SQL statements of the queries that SQL can express.

The rules are whole in SQL. The others hold tokenizers, hashing of code-point spans, fitted models,
link propagation or similarity classes, which tests compare with brute force instead.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]"

RULES = rf"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
tri AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, g FROM tri GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM tri JOIN twice USING (r, g), range(3) s(k) GROUP BY 1),
m AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '\P{{L}}', '', 'g')) AS letters,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS capitals,
    len(string_split(t, chr(10))) AS n_lines
  FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_symbols > n_words
    OR 3 * n_dup_lines > n_lines
    OR 10 * letters < 6 * word_chars
    OR 2 * capitals > letters) AS kept
FROM m"""

# CRC-32 of the strings of ``{name}(s)``, as ``{name}_crc(s, crc)``: what each byte adds, by how many bytes
# follow it, from the polynomial; the additions are exclusive-ors.
CRC = """bit(i, k, c) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
one AS (SELECT i, c FROM bit WHERE k = 8),
after(k, i, c) AS (SELECT 0::BIGINT, i, c FROM one
  UNION ALL SELECT after.k + 1, after.i, xor(after.c >> 8, one.c) FROM after JOIN one ON one.i = (after.c & 255)
  WHERE after.k + 1 < (SELECT max(strlen(s)) FROM {name})),
blank(n, c) AS (SELECT 0::BIGINT, 4294967295::BIGINT
  UNION ALL SELECT n + 1, xor(blank.c >> 8, one.c) FROM blank JOIN one ON one.i = (blank.c & 255)
  WHERE n < (SELECT max(strlen(s)) FROM {name})),
{name}_byte AS (SELECT s, strlen(s) - 1 - j AS k, CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT) AS i
  FROM (SELECT s, hex(s) AS h, unnest(range(strlen(s))) AS j FROM {name})),
{name}_sum AS (SELECT s, bit_xor(c) AS c FROM {name}_byte JOIN after USING (k, i) GROUP BY s),
{name}_crc AS (SELECT s, xor(xor({name}_sum.c, blank.c), 4294967295) AS crc
  FROM {name}_sum JOIN blank ON blank.n = strlen(s))"""

IMPORTANCE = rf"""WITH RECURSIVE t AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
  UNION ALL SELECT false, row_number() OVER (), 0, coalesce(text, '') FROM benchmark),
w AS (SELECT own, r, doc_id, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
f AS (SELECT own, r, array_to_string(w[i:i + k], ' ') AS s FROM (
    SELECT own, r, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(3) n(k) WHERE i + k <= len(w)),
names AS (SELECT DISTINCT s FROM f),
{CRC.format(name="names")},
b AS (SELECT own, r, crc % 10000 AS bucket, count(*) AS n FROM f JOIN names_crc USING (s) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM b GROUP BY 1),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE
  / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c, a),
d AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM b JOIN g USING (bucket) WHERE own GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (r) WHERE own),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM m),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
    5 * count(*) OVER () // 100 AS wanted FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank
FROM z LEFT JOIN o USING (doc_id)"""

SPELLING = rf"""WITH RECURSIVE x AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
runs AS (SELECT run, doc_id || ':' || run AS s, count(*) AS n FROM x GROUP BY ALL),
names AS (SELECT DISTINCT s FROM runs),
{CRC.format(name="names")},
made AS (SELECT CASE WHEN crc % 97 = 0
    THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n
  FROM runs JOIN names_crc USING (s)),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
gap AS (SELECT word, n, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gap a JOIN gap b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM gap a JOIN v ON v.word = a.l || a.r
  UNION SELECT v.word, a.word, a.n FROM gap a JOIN v ON v.word = a.l || a.r),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
    CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, place) AS (SELECT word, word FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NOT NULL),
root AS (SELECT walk.word, walk.place AS root FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""

REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
p AS (SELECT r, doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k
  FROM (SELECT r, doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM d)),
late AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM p)
  WHERE place > 1),
run AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS number FROM (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM late)),
gone AS (SELECT r, min(i) AS low, max(i) + 100 AS high FROM run GROUP BY r, number),
left_over AS (SELECT r, h, low, high, coalesce(lag(high) OVER w, 0) AS before, lead(low) OVER w AS next
  FROM gone JOIN d USING (r) WINDOW w AS (PARTITION BY r ORDER BY low)),
kept AS (SELECT r, count(*) AS n_spans, CAST(sum(high - low) AS BIGINT) AS n_removed,
  string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low)
    || last(CASE WHEN next IS NULL THEN substr(h, 2 * high + 1) END ORDER BY low) AS k FROM left_over GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

ORACLES: dict[str, str] = {
    "op8_rules": RULES,
    "op11_repeats": REPEATS,
    "op12_importance": IMPORTANCE,
    "op13_spelling": SPELLING,
}

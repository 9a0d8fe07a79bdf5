"""The same rows in DuckDB's SQL, for the queries that SQL can express. Windows and sets are spelled out, so it is for small tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN_LOWER = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"
_LETTERS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
s AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS text FROM words),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY text ORDER BY doc_id, i) AS k FROM s WHERE i + 19 <= n),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM r WHERE k > 1),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.i) AS text FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_PLAIN} AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
s AS (SELECT doc_id, n, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS text FROM words),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, text) AS n FROM s WHERE i + 7 <= n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM r WHERE n > 1) GROUP BY 1),
same AS (SELECT doc_id, count(*) AS n FROM s WHERE word = before GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(same.n, 0) AS n_stutter
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN same ON d.doc_id = same.doc_id
),
n AS (SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 60 * n_lines OR 100 * n_stutter > 40 * n_words) AS kept
FROM n
"""

DECONTAMINATE = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_LETTERS} AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i+k-1], ' ') AS text FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized)),
d AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS text FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, win.k, item FROM s JOIN win ON s.k = win.k AND s.text = win.text),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(found.items, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN_LOWER} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN reach ON d.doc_id = reach.a GROUP BY d.doc_id, n.n
"""

URL_MINED = """
WITH u AS (SELECT regexp_matches(url, '[?&]page=') AS by_page, contains(url, '/es/') AS by_es FROM pages)
SELECT CASE WHEN by_es THEN 'path:es' ELSE 'key:page' END AS rule, count(*)::BIGINT AS n_pages, count(*)::BIGINT AS n_blocked FROM u WHERE by_page OR by_es GROUP BY 1
"""


def license_phrases(phrases: dict[str, str]) -> str:
    wanted = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in phrases.items())
    return rf"""
WITH phrases(phrase, k, label) AS (VALUES {wanted}),
d AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
hit AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d) JOIN phrases ON array_to_string(w[i:i+k-1], ' ') = phrase),
n AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS first, max(i) - 1 AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n.n IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS score
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""


def url_rules(rules: list[tuple[str, str, str]]) -> str:
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    stated = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return rf"""
WITH rules(verdict, host, path) AS (VALUES {stated}),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce({rest}, '') AS rest FROM pages)),
fit AS (SELECT u.*, rules.host || rules.path AS rule, rules.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rules.host || rules.path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""

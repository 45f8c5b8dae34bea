"""The results of the registered queries as DuckDB SQL, where SQL can state them."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {}

ORACLE["op8_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, spot.n AS n, item FROM spot JOIN win ON spot.n = win.n AND spot.g = win.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_HOST = f"translate(regexp_extract({_REST}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BLOCKS = "p|div|br|li|ul|ol|nav|article|footer|header|h[1-6]|title|section|table|tr|td|th|body|head|html|main|aside|blockquote|pre"
_TEXT = "html"
for _gone in (r"(?is)<script.*?</script[^>]*>", r"(?is)<style.*?</style[^>]*>", r"(?s)<!--.*?-->", rf"(?i)</?({_BLOCKS})([ \t\r\n/][^>]*)?>"):
    _TEXT = f"regexp_replace({_TEXT}, '{_gone}', chr(10), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '<[^>]*>', '', 'g')"
for _name, _char in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}.items():
    _TEXT = f"replace({_TEXT}, '{_name}', '{_char}')"
_TEXT = rf"regexp_replace({_TEXT}, '[ \t\r\x0B\x0C]+', ' ', 'g')"

ORACLE["op3_line_dedup"] = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, {_HOST} AS host,
         list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
total AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, r, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
gone AS (SELECT host, list(line) AS drop FROM c JOIN total USING (host) WHERE host <> '' AND n >= 3 AND n > CAST(0.2 AS DOUBLE) * pages GROUP BY host),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(drop, x), false)) AS kept FROM p LEFT JOIN gone USING (host))
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM k
"""

ORACLE["op4_url_filter"] = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {_HOST} AS host, regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
"""

ORACLE["op5_mixing"] = """
WITH RECURSIVE n AS (
  SELECT doc_id, coalesce(source, chr(0)) AS source,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), CAST(doc_id AS VARCHAR)) - 1 AS n
  FROM documents),
b AS (SELECT source, (max(n) + 16) // 16 AS blocks, CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS w FROM n GROUP BY source),
src AS (SELECT source, row_number() OVER (ORDER BY source) AS i, blocks, w FROM b),
run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS ran, CAST(0 AS BIGINT) AS pick,
         list(CAST(0 AS BIGINT) ORDER BY i) AS done, list(CAST(blocks AS BIGINT) ORDER BY i) AS rem, list(CAST(w AS BIGINT) ORDER BY i) AS w FROM src
  UNION ALL
  SELECT slot + 1, CASE WHEN rem[p] = 1 THEN slot + 2 ELSE start END, phase + CASE WHEN rem[p] = 1 THEN 1 ELSE 0 END, phase, p,
         list_transform(done, lambda d, i: CASE WHEN rem[p] = 1 THEN 0 WHEN i = p THEN d + 1 ELSE d END),
         list_transform(rem, lambda r, i: CASE WHEN i = p THEN r - 1 ELSE r END), w
  FROM (
    SELECT *, list_sort(list_filter(list_transform(act, lambda a, i: CASE WHEN a > 0 AND (done[i] * total) // a <= slot + 1 - start
                THEN {'due': ((done[i] + 1) * total + a - 1) // a, 'i': i} END), lambda x: x IS NOT NULL))[1].i AS p
    FROM (SELECT *, list_sum(act)::BIGINT AS total FROM (SELECT *, list_transform(rem, lambda r, i: CASE WHEN r > 0 THEN w[i] ELSE 0 END) AS act FROM run))
    WHERE total > 0)),
placed AS (SELECT source, slot, ran AS phase, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM run JOIN src ON pick = i)
SELECT doc_id, n.source AS source, CAST(phase AS INT) AS phase, block, slot, slot * 16 + n % 16 AS position
FROM n JOIN placed ON n.source = placed.source AND n.n // 16 = placed.block
"""

#: {least} and {wanted} are the least count of a candidate and the number of phrases of a language.
COLLOCATIONS = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n-\r]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM t),
one AS (SELECT lang, unnest(w) AS phrase FROM w),
total AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {{least}}),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, a AS longer, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
around AS (SELECT lang, phrase, max(longer) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= {{wanted}}
"""
ORACLE["op11_collocations"] = COLLOCATIONS.format(least=30, wanted=2000)

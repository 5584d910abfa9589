"""The queries' results in DuckDB's SQL, where SQL can express them."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS wt FROM d GROUP BY source
), o AS (
  SELECT *, (sum(w) OVER ())::BIGINT AS total,
    coalesce(sum(3 * w) OVER (ORDER BY (3 * w)::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
    (sum(wt) OVER (ORDER BY (3 * w)::DOUBLE / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM s
), c AS (
  SELECT *, 3 * w * open <= wt * (total - caps) AS capped FROM o
), t AS (
  SELECT source, sid, w, CASE WHEN capped THEN (3 * w)::DOUBLE
    ELSE wt * ((SELECT any_value(total) - coalesce(sum(3 * w) FILTER (capped), 0)::BIGINT FROM c)::DOUBLE / (SELECT sum(wt) FILTER (NOT capped) FROM c)::DOUBLE) END AS target
  FROM c
), p AS (
  SELECT d.*, sid, w, target, floor(target + 0.5)::BIGINT AS take,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, start // 4096 AS block, CASE WHEN w = 0 THEN 0 ELSE take // w END AS passes, CASE WHEN w = 0 THEN 0 ELSE take % w END AS rest FROM p
), b AS (
  SELECT sid, block, sum(size)::BIGINT AS words, min(start) AS first, ('0x' || substr(md5('5-' || sid || '-' || block), 1, 8))::BIGINT AS bh FROM q WHERE size > 0 GROUP BY sid, block
), r AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY sid ORDER BY bh, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b
)
SELECT doc_id, size, w AS source_size, target,
  (passes * size + CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(size, least(words, rest - before) - (start - first))) END)::BIGINT AS taken
FROM q LEFT JOIN r USING (sid, block)
"""


def op2(stop_words: list[str]) -> str:
    stop = ", ".join(f"'{w}'" for w in stop_words)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), f AS (
  SELECT r, doc_id, text, words, len(words)::BIGINT AS n_words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), w AS (
  SELECT r, unnest(range(1, greatest(len(words) - 1, 1))) AS i, words FROM f
), k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM w
), v AS (
  SELECT r, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY r
), g AS (
  SELECT doc_id, n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: list_contains([{stop}], x)))::BIGINT AS n_stop_words
  FROM f LEFT JOIN v USING (r)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words < 50 THEN 'too_few_words' WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_windows'
      WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 'mean_word_length'
      WHEN 4 * n_symbols > n_words THEN 'symbols_per_word'
      WHEN 100 * n_stop_words < n_words THEN 'stop_words'
      WHEN n_dup_lines::DOUBLE / n_lines > 0.6 THEN 'repeated_lines' END AS failed_rule
  FROM g
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM j
"""


OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents
), w AS (
  SELECT r, doc_id, i, array_to_string(words[i : i + 49], ' ') AS body FROM (SELECT *, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM d WHERE doc_id IS NOT NULL)
), m AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY body) AS least FROM w) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM m
), g AS (
  SELECT r, list(j) AS js, count(*)::BIGINT AS n FROM gone GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(js, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 5
"""


def op8(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    return rf"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages
), h AS (
  SELECT page_id, r, CASE WHEN mark = 0 THEN '' ELSE substr(url, mark + 3) END AS rest FROM u
), s AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM h
), m AS (
  SELECT s.r, rule_action, rule_host || rule_path AS rule,
    row_number() OVER (PARTITION BY s.r ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS n
  FROM s JOIN (VALUES {values}) AS rules(rule_action, rule_host, rule_path)
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_action, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (r)
"""


OP9 = r"""
WITH b AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(coalesce(url, '') || chr(10) || coalesce(html, '')) AS m FROM pages
), c AS (
  SELECT page_id, url, ('0x' || substr(md5(concat_ws(chr(10), page_id::VARCHAR, url)), 1, 8))::BIGINT AS h,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM b
), d AS (
  SELECT page_id, url, h, strlen(record)::BIGINT AS record_length, sha256(record) AS record_sha256 FROM c
), f AS (
  SELECT *, h % greatest(1, (SELECT ceil(sum(record_length) / 4194304.0) FROM d))::BIGINT AS file FROM d
)
SELECT page_id, file, record_length, record_sha256,
  coalesce(sum(record_length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, url, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset,
  CASE WHEN page_id % 211 = 11 THEN 'lost' WHEN page_id % 211 = 7 THEN 'altered' ELSE 'intact' END AS status
FROM f
"""


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), o AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), n AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (total + v)::HUGEINT AS p
  FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(n) + 1)::HUGEINT // ((sum(sum(n)) OVER (PARTITION BY lang)) + any_value(v))::HUGEINT AS q FROM c JOIN v USING (lang) GROUP BY lang, term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), f AS (
  SELECT 'pair' AS part, a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT 'term', lang, source, term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank FROM f
) WHERE part = 'pair' OR rank <= 200
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i : i + 9], ' ') AS body FROM (SELECT *, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)
), s AS (
  SELECT DISTINCT size FROM w
), h AS (
  SELECT r, i, size, body FROM (SELECT r, size, i, array_to_string(words[i : i + size - 1], ' ') AS body FROM (SELECT r, words, size, unnest(range(1, greatest(len(words) - size + 2, 1))) AS i FROM d, s))
    SEMI JOIN w USING (size, body)
), n AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + size)) AS j FROM h) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h JOIN w USING (size, body) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

_CRC32 = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8)::BIGINT[], lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)))"


def _leaf(n_chars: str) -> str:
    sized = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    return f"sha256({' || '.join(sized(x) for x in ('doc_id::VARCHAR', 'source', 'lang', f'({n_chars})::VARCHAR', 'text'))})"


OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS now FROM documents
), e AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), lows AS (
  SELECT 0 AS level, g, i, leaf AS h, n FROM e
  UNION ALL SELECT level + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lows WHERE n > 1 GROUP BY level, g, i // 2, n
), sub AS (
  SELECT g, level AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n FROM lows WHERE n = 1
), highs AS (
  SELECT 0 AS level, k, subroot AS h, n FROM sub
  UNION ALL SELECT level + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (n + 1) // 2 FROM highs WHERE n > 1 GROUP BY level, k // 2, n
), ups AS (
  SELECT g, i, e.doc_id, e.leaf, e.now, subroot, height, k FROM e JOIN sub USING (g)
), steps AS (
  SELECT u.g, u.i, l.level, u.i >> l.level AS own, (SELECT any_value(x.h) FROM lows x WHERE x.g = u.g AND x.level = l.level AND x.i = xor(u.i >> l.level, 1)) AS sibling
  FROM ups u JOIN (SELECT DISTINCT g, level FROM lows WHERE n > 1) l USING (g)
  UNION ALL SELECT u.g, u.i, height + l.level, u.k >> l.level, (SELECT any_value(x.h) FROM highs x WHERE x.level = l.level AND x.k = xor(u.k >> l.level, 1))
  FROM ups u, (SELECT DISTINCT level FROM highs WHERE n > 1) l
), proofs AS (
  SELECT g, i, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY level)) AS proof_sha256, max(level) + 1 AS height FROM steps GROUP BY g, i
), folds AS (
  SELECT g, i, 0 AS level, now AS h FROM ups
  UNION ALL SELECT f.g, f.i, f.level + 1, sha256(CASE WHEN own % 2 = 0 THEN f.h || coalesce(sibling, '') ELSE sibling || f.h END) FROM folds f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.level = f.level
), folded AS (
  SELECT g, i, arg_max(h, level) AS folded_root FROM folds GROUP BY g, i
), root AS (
  SELECT h AS root FROM highs WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ups JOIN folded USING (g, i) LEFT JOIN proofs USING (g, i), root
"""

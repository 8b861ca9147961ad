"""DuckDB SQL for the text queries that SQL can express."""

OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT row_number() OVER () AS k, * FROM w),
g AS (SELECT k, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM k WHERE len(ws) > 8)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(0, 8)) AS o) GROUP BY k),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines FROM k LEFT JOIN c USING (k)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words)::INT
             + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT + 16 * (n_words > 0 AND (word_chars > 20 * n_words OR word_chars < 2 * n_words))::INT
             + 32 * (n_words > 0 AND n_words < 5 AND word_chars > 1000)::INT AS INT) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failure_bits,
       (failure_bits & 3) <> 0 AS base_failed, (failure_bits & 31) = 0 AS kept FROM f
"""

OP7 = r"""
WITH c AS (SELECT page_id, coalesce(url, '') AS url, CAST(1704067200 + ((page_id * 7919) % 8640 + 8640) % 8640 * 300 AS BIGINT) AS fetched_at FROM pages),
h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM c),
k AS (SELECT row_number() OVER () AS n, page_id, url, fetched_at, host, regexp_extract(host, '([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.0-9]+))$', 1) AS site,
             CASE WHEN host = '' OR seg = '' THEN '' ELSE host || '/' || seg END AS prefix,
             CAST((fetched_at - 1704067200) // 86400 + 1 AS BIGINT) * 86400 + 1704067200 AS eff FROM h),
e AS (SELECT 'host' AS l, host AS key, 'add' AS a, eff FROM k WHERE contains(url, 'utm_source=')
      UNION ALL SELECT 'host', host, 'remove', eff FROM k WHERE contains(url, 'page=')
      UNION ALL SELECT 'prefix', prefix, 'add', eff FROM k WHERE suffix(url, '#top')
      UNION ALL SELECT 'prefix', prefix, 'remove', eff FROM k WHERE suffix(url, '.html')
      UNION ALL SELECT 'site', site, 'add', eff FROM k WHERE suffix(url, '/') AND NOT contains(url, '://www.')
      UNION ALL SELECT 'site', site, 'remove', eff FROM k WHERE contains(url, 'page=')),
m AS (SELECT l, key, eff, max((a = 'add')::INT) AS listed FROM e WHERE key <> '' GROUP BY l, key, eff),
x AS (SELECT *, coalesce(lag(listed) OVER (PARTITION BY l, key ORDER BY eff), 0) AS was FROM m),
ch AS (SELECT l, key, eff, listed, coalesce(lead(eff) OVER (PARTITION BY l, key ORDER BY eff), 4611686018427387904) AS til FROM x WHERE listed <> was),
v AS (SELECT * FROM ch WHERE listed = 1),
ks AS (SELECT n, 'host' AS l, host AS key, fetched_at FROM k UNION ALL SELECT n, 'site', site, fetched_at FROM k UNION ALL SELECT n, 'prefix', prefix, fetched_at FROM k),
j AS (SELECT n, min(CASE WHEN l = 'host' THEN eff END) AS hs, min(CASE WHEN l = 'site' THEN eff END) AS ss, min(CASE WHEN l = 'prefix' THEN eff END) AS ps
      FROM ks JOIN v USING (l, key) WHERE fetched_at >= eff AND fetched_at < til GROUP BY n)
SELECT page_id, host, fetched_at, hs IS NOT NULL AS host_listed, ss IS NOT NULL AS site_listed, ps IS NOT NULL AS prefix_listed,
       (hs IS NOT NULL OR ss IS NOT NULL OR ps IS NOT NULL) AS blocked, least(hs, ss, ps) AS since
FROM k LEFT JOIN j USING (n)
"""

OP5 = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

# Runs of at least 50 words that lose this when their first or their last line goes, by their own text; any but the first place of a run goes.
OP4 = r"""
WITH l AS MATERIALIZED (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)),
c AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS cum FROM (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE x <> '')),
r AS MATERIALIZED (SELECT a.doc_id, a.k AS s, z.k AS e FROM c a JOIN c z ON z.doc_id = a.doc_id AND z.k BETWEEN a.k AND a.k + 49
  WHERE z.cum - a.cum + a.n >= 50 AND (z.cum - z.n - a.cum + a.n < 50 OR z.cum - a.cum < 50)),
g AS MATERIALIZED (SELECT r.doc_id, s, e, string_agg(x, chr(10) ORDER BY k) AS gram FROM r JOIN c ON c.doc_id = r.doc_id AND k BETWEEN s AND e GROUP BY r.doc_id, s, e),
f AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY gram ORDER BY doc_id, s) AS nth FROM g),
m AS MATERIALIZED (SELECT DISTINCT f.doc_id, i FROM f JOIN c ON c.doc_id = f.doc_id AND k BETWEEN s AND e WHERE nth > 1),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(m.i) AS n_removed, string_agg(CAST(m.i AS VARCHAR), ',' ORDER BY m.i) AS removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE m.i IS NULL) AS kept
  FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN coalesce(kept, '') ELSE text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed_places
FROM documents d LEFT JOIN t USING (doc_id)
"""

# Every item against every passage of its own length class, by BM25 as a share of the item's best score; then five-word runs of question and answer.
_FOLD = r"list_filter(string_split(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda y: y <> '')"
OP10 = r"""
WITH it AS MATERIALIZED (SELECT row_number() OVER () AS it, item_id, text FROM benchmark WHERE text IS NOT NULL),
folded AS (SELECT it, item_id, text, FOLDED_TEXT AS ws FROM it),
iw AS MATERIALIZED (SELECT it, item_id, text, ws, CAST(64 * pow(2, greatest(0, ceil(log2(len(ws) / 64.0)))) AS BIGINT) AS stride FROM folded WHERE len(ws) > 0),
tf AS MATERIALIZED (SELECT it, w, count(*) AS tf FROM (SELECT it, unnest(ws) AS w FROM iw) GROUP BY it, w),
st AS MATERIALIZED (SELECT count(*) AS n, avg(len(ws)) AS mean FROM iw),
dfs AS MATERIALIZED (SELECT w, count(*) AS df FROM tf GROUP BY w),
gain AS MATERIALIZED (SELECT it, w, stride, g / sum(g) OVER (PARTITION BY it) AS g FROM (
  SELECT it, w, stride, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) AS g FROM tf JOIN iw USING (it) JOIN dfs USING (w), st)),
dw AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, FOLDED_TEXT AS ws FROM documents WHERE text IS NOT NULL),
dt AS MATERIALIZED (SELECT d, w, p FROM (SELECT d, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM dw) SEMI JOIN dfs USING (w)),
hit AS MATERIALIZED (SELECT d, it, b, stride, sum(g) AS score FROM (
    SELECT DISTINCT d, it, p // stride - o AS b, stride, w, g FROM dt JOIN gain USING (w), (SELECT unnest([0, 1]) AS o) WHERE p // stride - o >= 0) GROUP BY d, it, b, stride HAVING sum(g) >= 0.5 - 1e-9),
sent AS (SELECT it, ws, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'),
    lambda x: FOLDED_SENTENCE), lambda s: len(s) > 0) AS ss FROM iw),
part AS (SELECT it, 'q' AS side, CASE WHEN len(ss) > 1 THEN flatten(ss[:-2]) ELSE ws END AS ws FROM sent UNION ALL SELECT it, 'a', CASE WHEN len(ss) > 1 THEN ss[-1] ELSE ws END FROM sent),
wanted AS MATERIALIZED (SELECT it, side, len(ws) AS size, least(5, len(ws)) AS n, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM part)),
around AS MATERIALIZED (SELECT d, it, b, score, stride, ws[greatest(0, (b - 1) * stride) + 1:(b + 3) * stride] AS ws FROM hit JOIN dw USING (d)),
grams AS (SELECT DISTINCT d, it, b, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT d, it, b, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM around JOIN (SELECT DISTINCT it, n FROM wanted) USING (it))),
over AS (SELECT d, it, b, side, count(g.gram) / count(*) AS share FROM (SELECT d, it, b, side, wanted.n, wanted.gram FROM hit JOIN wanted USING (it)) x LEFT JOIN grams g USING (d, it, b, n, gram) GROUP BY d, it, b, side),
both_ AS (SELECT d, it, b, max(share) FILTER (side = 'q') AS q, max(share) FILTER (side = 'a') AS a FROM over GROUP BY d, it, b),
best AS (SELECT d, it, h.b * stride AS first_word, score, q, a, row_number() OVER (PARTITION BY d, it ORDER BY round(score, 9) DESC, h.b) AS nth FROM hit h JOIN both_ USING (d, it, b) WHERE least(q, a) >= 0.5)
SELECT doc_id, item_id, round(score, 6) AS score, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap, CAST(first_word AS BIGINT) AS first_word FROM best JOIN dw USING (d) JOIN it USING (it) WHERE nth = 1
""".replace("FOLDED_TEXT", _FOLD.format("text")).replace("FOLDED_SENTENCE", _FOLD.format("x"))

# CRC-32 of the UTF-8 bytes of {0}, a byte at a time through the table of 256 remainders in `crc`.
_CRC = r"xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length(encode({0}))), lambda i: CAST(concat('0x', hex(encode({0}))[2 * i + 1:2 * i + 2]) AS BIGINT)), lambda a, b: xor(a >> 8, remainders[(xor(a, b) & 255) + 1])))"
_CRC_TABLE = r"crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS remainders)"

OP13 = r"""
WITH CRC_TABLE,
t AS (SELECT conv_id, turn, md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, list({'id': id, 'words': words} ORDER BY turn NULLS FIRST, id) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, CRC_OF % 4 AS h FROM o, crc),
r AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(d.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN o d ON d.conv_id = h.conv_id - h.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, turns, len(turns) AS n, depth, md5(array_to_string(list_transform(turns[1:depth], lambda x: x.id), ',')) AS node,
      CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(turns[1:depth - 1], lambda x: x.id), ',')) END AS parent, coalesce(turns[depth].words, 0) AS words
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM r)),
n AS MATERIALIZED (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256, any_value(turns) AS turns FROM p GROUP BY node),
c AS MATERIALIZED (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT md5(array_to_string(list_transform(turns[1:up], lambda x: x.id), ',')) AS node, saved, leaf FROM (
      SELECT turns, saved, (c.node IS NULL)::INT AS leaf, unnest(range(0, depth + 1)) AS up FROM n LEFT JOIN c USING (node))),
s AS (SELECT node, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM u GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN c ON c.node = n.node LEFT JOIN n q ON q.node = n.parent
""".replace("CRC_TABLE", _CRC_TABLE).replace("CRC_OF", _CRC.format("CAST(conv_id AS VARCHAR)"))

# Words with one place cut out or opened, marked by a star, meet their neighbours.
OP11 = r"""
WITH RECURSIVE CRC_TABLE,
t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
k AS MATERIALIZED (SELECT run, count(*) AS n, concat(d, ':', run) AS key FROM t GROUP BY ALL),
h AS MATERIALIZED (SELECT run, n, CRC_OF AS h FROM k, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, substr(word, 1, i) || '*' || substr(word, i + 2) AS x FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
gap AS MATERIALIZED (SELECT word, substr(word, 1, i) || '*' || substr(word, i + 1) AS x FROM (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (SELECT a.word, b.word AS v FROM cut a JOIN cut b USING (x) WHERE a.word <> b.word UNION SELECT a.word, b.word FROM cut a JOIN gap b USING (x) UNION SELECT b.word, a.word FROM cut a JOIN gap b USING (x)),
best AS MATERIALIZED (SELECT near.word, count(*) AS n_near, max(w.n) AS n_best, min_by(v, (-w.n, v)) AS v FROM near JOIN w ON w.word = v GROUP BY near.word),
j AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_best >= 5 * w.n THEN v END AS form, CASE WHEN n_best >= 5 * w.n THEN n_best END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM j UNION ALL SELECT up.word, j.form FROM up JOIN j ON j.word = up.root WHERE j.form IS NOT NULL)
SELECT j.word, j.form, up.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n FROM j JOIN up USING (word) JOIN j r ON r.word = up.root WHERE r.form IS NULL
""".replace("CRC_TABLE", _CRC_TABLE).replace("CRC_OF", _CRC.format("key"))

ORACLES = {"op11_spelling_variants": OP11, "op13_prefix_trie": OP13, "op10_decontamination": OP10, "op3_quality_rules": OP3, "op4_line_dedup": OP4, "op5_jaccard_join": OP5, "op7_url_filters": OP7}

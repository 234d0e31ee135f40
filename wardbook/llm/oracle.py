"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

MIX = r"""
WITH q AS (SELECT doc_id, 0.5 + 0.5 * avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || substr(md5('mix' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce(q.quality, 0.75) AS key
  FROM {docs} d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY 1),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
-- the level of the water: the largest l with sum(min(l * weight, 2 * n)) <= 1.5 * sum(n), tried at every source
l AS (
  SELECT arg_min(rest, own) AS rest, arg_min(left_weight, own) AS shares FROM (
    SELECT (SELECT 1.5 * sum(n) FROM w) - coalesce(sum(CASE WHEN b.n / b.weight < a.n / a.weight THEN 2 * b.n END), 0) AS rest,
           sum(CASE WHEN b.n / b.weight >= a.n / a.weight THEN b.weight END) AS left_weight, 2 * a.n / a.weight AS own
    FROM w a, w b GROUP BY a.source, a.n, a.weight)
  WHERE own * left_weight > rest),
t AS (SELECT source, n, least(2 * n, coalesce((SELECT rest FROM l) * weight / (SELECT shares FROM l), 2 * n)) AS target FROM w),
r AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t),
x AS (
  SELECT d.*, r.n, r.target, r.epochs, r.target - r.epochs * r.n AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT {columns} FROM x"""

_TAKEN = "size * (epochs::BIGINT + CASE WHEN before < rest AND before + size / 2.0 <= rest THEN 1 ELSE 0 END)"

MIX_QUERY = MIX.format(docs="documents", columns=f"doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target, ({_TAKEN})::BIGINT AS taken")

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS t FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT n FROM k),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, g WHERE len(w) >= n)),
m AS (SELECT p.doc_id, p.i, p.n, k.item_id FROM p JOIN k ON p.t = k.t AND p.n = k.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(c.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(c.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id"""

_LATER = """
k AS (SELECT doc_id, unnest(range(1, len(w) - {n} + 2)) AS i, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], {join}))) AS t
      FROM d WHERE len(w) >= {n}),
x AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS place FROM k WHERE {where}) WHERE place > 1),
g AS (SELECT doc_id, list(j) AS js FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS j FROM x) GROUP BY 1),
y AS (SELECT d.doc_id, len(w) AS n, coalesce(len(js), 0) AS gone,
             CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(js, i)), lambda i: w[i]) END AS kept
      FROM d LEFT JOIN g ON g.doc_id = d.doc_id)"""

DEDUP_LINES = ("WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS w FROM documents),"
               + _LATER.format(n=3, join="chr(10)", where="t <> chr(10) || chr(10)") + """
SELECT doc_id, n::BIGINT AS n_lines, gone::BIGINT AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM y""")

DEDUP_SUBSTRINGS = (r"WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),"
                    + _LATER.format(n=20, join="' '", where="true") + """
SELECT doc_id, n::BIGINT AS n_words, gone::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y""")

# CRC-32: its table from the polynomial 0xEDB88320, then byte by byte over the UTF-8 text {s}
_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i))"
_BYTES = "list_transform(range(1, octet_length(encode({s})) + 1), lambda j: ('0x' || substr(hex(encode({s})), 2 * j - 1, 2))::BIGINT)"
_CRC = "xor(list_reduce(list_prepend(4294967295, " + _BYTES + "), lambda c, b: xor(c >> 8, {table}[xor(c, b) % 256 + 1])), 4294967295)"

TRIE = "WITH k AS " + _TABLE + """,
t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, length(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'code': code, 'size': size} ORDER BY turn NULLS FIRST, code) AS turns FROM t GROUP BY 1),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, turns, """ + _CRC.format(s="CAST(conv_id AS VARCHAR)", table="k.crc") + """ % 6 AS h FROM c, k),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
m AS (SELECT conv_id, depth, n, array_to_string(list_transform(turns[1:depth], lambda x: x.code), '') AS path,
             array_to_string(list_transform(turns[1:depth - 1], lambda x: x.code), '') AS above, CASE WHEN depth > 0 THEN turns[depth].size ELSE 0 END AS size FROM p),
v AS (SELECT path, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf, (count(*) - 1) * max(size) AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends FROM m GROUP BY 1, 2),
u AS (SELECT substr(path, 1, 32 * d) AS path, sum(saved) AS saved, sum(leaf::INT) AS leaves FROM (SELECT path, saved, leaf, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY 1),
g AS (SELECT above, count(*) AS children FROM v WHERE depth > 0 GROUP BY 1)
SELECT v.conv_id, v.depth::BIGINT AS depth, CASE WHEN v.depth > 0 THEN o.conv_id END AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(g.children, 0)::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN u ON u.path = v.path LEFT JOIN g ON g.above = v.path LEFT JOIN v o ON o.path = v.above"""

VARIANTS = "WITH RECURSIVE k AS " + _TABLE + """,
a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
b AS (SELECT w, n, """ + _CRC.format(s="(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)", table="k.crc") + """ AS h FROM a, k WHERE length(w) > 4),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM b),
v AS (SELECT w AS word, sum(n)::BIGINT AS n FROM s WHERE length(w) > 4 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || '-' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.hole = y.hole AND x.word <> y.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS form, max(near_n) AS form_n FROM e GROUP BY 1),
l AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
r(word, root) AS (SELECT word, word FROM l UNION ALL SELECT r.word, l.form FROM r JOIN l ON l.word = r.root WHERE l.form IS NOT NULL)
SELECT l.word, l.form, r.root, l.n, l.n_near, l.form_n FROM l JOIN (SELECT r.word, r.root FROM r JOIN l ON l.word = r.root WHERE l.form IS NULL) r ON r.word = l.word"""

ORACLE = {"op1_jaccard_join": JACCARD, "op2_dedup_lines": DEDUP_LINES, "op3_mix_sources": MIX_QUERY,
          "op9_decontaminate": DECONTAMINATE, "op10_dedup_substrings": DEDUP_SUBSTRINGS, "op11_prefix_trie": TRIE, "op13_spelling_variants": VARIANTS}

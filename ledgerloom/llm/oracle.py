"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM g WHERE k > 1),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body, replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>') AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l0 AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS s, w FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, array_to_string(w[s:s + 7], ' ')) AS k FROM p),
rep AS (SELECT doc_id, count(DISTINCT i) AS n_rep FROM (SELECT doc_id, unnest(range(s, s + 8)) AS i FROM g WHERE k > 1) GROUP BY doc_id),
n AS (SELECT doc_id, source, text, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, len(lw) AS k FROM l),
f AS (SELECT source, line, count(DISTINCT doc_id) AS docs FROM n GROUP BY ALL),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
o AS (SELECT f.source, f.line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE f.docs > 10 AND f.docs > h.docs * 0.01::DOUBLE),
lost AS (SELECT n.doc_id, sum(k) AS n FROM n JOIN o ON n.source IS NOT DISTINCT FROM o.source AND n.line = o.line GROUP BY n.doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.3::DOUBLE * n_words)) AS kept, n_removed_words
FROM v
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(no % 3 + 1)::INT] AS weight, source_size::DOUBLE * 2 AS cap FROM k),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  sum(cap) OVER (ORDER BY cap / weight, no ROWS UNBOUNDED PRECEDING) - cap AS capped FROM w),
lv AS (SELECT *, (total - capped) / rest AS level FROM o),
x AS (SELECT arg_min(level, [cap / weight, no::DOUBLE]) AS level FROM lv WHERE level * weight <= cap),
t AS (SELECT w.*, CASE WHEN x.level IS NULL THEN cap ELSE least(cap, x.level * weight) END AS target FROM w LEFT JOIN x ON true),
r AS (SELECT d.*, source_size, target, no, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(least(floor(target)::BIGINT - a, size), 0)::BIGINT AS one, greatest(least(floor(target)::BIGINT - a - source_size, size), 0)::BIGINT AS two,
  [1.0::DOUBLE, 0.5::DOUBLE, 1.5::DOUBLE][(no % 3 + 1)::INT] AS w0, [1.0::DOUBLE, 1.5::DOUBLE, 0.5::DOUBLE][(no % 3 + 1)::INT] AS w1 FROM r),
f AS (SELECT *, CASE WHEN one > 0 THEN a / target END AS s1, CASE WHEN two > 0 THEN (a + source_size) / target END AS s2, (w1 - w0) / 2 AS slope, (w0 + w1) / 2 AS whole FROM q)
SELECT doc_id, size, source_size, target, one + two AS taken,
  CASE WHEN slope = 0 THEN s1 ELSE 2 * (s1 * whole) / (w0 + sqrt(greatest(w0 * w0 + 4 * slope * (s1 * whole), 0.0::DOUBLE))) END AS at_first,
  CASE WHEN slope = 0 THEN s2 ELSE 2 * (s2 * whole) / (w0 + sqrt(greatest(w0 * w0 + 4 * slope * (s2 * whole), 0.0::DOUBLE))) END AS at_second
FROM f
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM h
"""



def _crc32() -> str:
    """A relation of one row, the checksum's table, made by its rule."""
    steps = "SELECT n, n AS x FROM range(256) r(n)"
    for _ in range(8):
        steps = f"SELECT n, xor(x >> 1, 3988292384 * (x & 1)) AS x FROM ({steps})"
    return f"crc AS (SELECT list(x ORDER BY n) AS t FROM ({steps}))"


def _crc_of(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


OP11 = rf"""
WITH {_crc32()}, d0 AS (SELECT doc_id, {_WORDS} AS w, {_crc_of('doc_id::VARCHAR')} AS h FROM documents, crc),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM d1),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM d2),
p AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM d),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
b AS (SELECT doc_id, start, length, period, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

OP12 = rf"""
WITH {_crc32()}, c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT c.*, b.ts AS bs, {_crc_of('c.conv_id::VARCHAR')} % 4 AS h FROM crc, c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
r AS (SELECT conv_id, list_concat(coalesce(bs, [])[1:h], ts[h + 1:]) AS ts FROM k),
p AS (SELECT conv_id, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM r),
q AS (SELECT conv_id, n, depth, md5(ts[1:depth]::VARCHAR) AS node, CASE WHEN depth > 0 THEN md5(ts[1:depth - 1]::VARCHAR) END AS up, CASE WHEN depth > 0 THEN len(regexp_extract_all(ts[depth].text, '[^ 	-]+')) ELSE 0 END AS words FROM p),
g AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS said FROM q GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM g WHERE depth > 0 GROUP BY ALL),
v AS (SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids USING (depth, node)),
under AS (SELECT q.depth, q.node, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved FROM v JOIN q m ON m.conv_id = v.conv_id AND m.depth = v.depth AND m.node = v.node
  JOIN q ON q.conv_id = v.conv_id AND q.depth <= v.depth GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(v.said, '')) AS ends_sha256
FROM v JOIN under USING (depth, node) LEFT JOIN v parent ON parent.depth = v.depth - 1 AND parent.node = v.up
"""

ORACLE = {"op2_substring_dedup": OP2, "op3_chat_formatting": OP3, "op4_quality_rules": OP4, "op8_mixing": OP8, "op9_warc": OP9, "op11_periodic_runs": OP11, "op12_prefix_trie": OP12}

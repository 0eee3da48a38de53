"""Oracle SQL (DuckDB) for the operators that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = """
WITH RECURSIVE src AS (
  SELECT coalesce('s' || source, 'n') AS k, count(*) AS n FROM documents GROUP BY 1
), tick AS (
  SELECT k, greatest(1, CAST(floor(64 * sqrt(n) / (SELECT sqrt(max(n)) FROM src)) AS BIGINT)) AS a,
         row_number() OVER (ORDER BY k) AS i FROM src
), conf AS (
  SELECT list(a ORDER BY i) AS al, CAST(sum(a) AS BIGINT) AS period, count(*) AS m FROM tick
), sim AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(range(m), lambda x: CAST(0 AS BIGINT)) AS done FROM conf
  UNION ALL
  SELECT t + 1, p, list_transform(range(1, m + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END)
  FROM (
    SELECT t, done, m, period,
      list_min(list_transform(range(1, m + 1), lambda i: CASE WHEN (done[i] * period) // al[i] <= t
        THEN (((done[i] + 1) * period + al[i] - 1) // al[i]) * 1000000 + i ELSE 4000000000000000000 END)) % 1000000 AS p
    FROM sim, conf WHERE t < period
  )
), places AS (
  SELECT pick AS i, t - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM sim WHERE t > 0
), ranked AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS k,
    row_number() OVER (PARTITION BY coalesce('s' || source, 'n') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS pos
  FROM documents
)
SELECT doc_id, r.k AS source_key, pos // 4 AS block, pos % 4 AS block_offset,
  ((pos // 4) // a) * period + place AS slot,
  ((pos // 4) * period) // a AS release,
  ((pos // 4 + 1) * period + a - 1) // a AS deadline,
  (((pos // 4) // a) * period + place) * 4 + pos % 4 AS mix_order
FROM ranked r JOIN tick USING (k) CROSS JOIN conf JOIN places p ON p.i = tick.i AND p.nth = (pos // 4) % a
"""

OP3 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines
), bad AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, (b.key IS NOT NULL AND k.doc_id <> b.keeper) AS dropped
  FROM keyed k LEFT JOIN bad b USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = f"""
WITH norm AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
  sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)
"""

SQL = {"op1_mix_sources": OP1, "op3_line_dedup": OP3, "op8_exact_dedup": OP8}

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 75 * (s.n + t.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), named AS (
  SELECT a AS doc_id, min(b) AS component_id, count(*) AS class_size FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, class_size FROM w LEFT JOIN sizes USING (doc_id) JOIN named USING (doc_id)
"""
SQL["op5_jaccard_join"] = OP5

# Bytes as two hexadecimal digits each; windows are cut from pieces of 699 bytes, so that cutting costs the same anywhere in a text.
OP6 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), block AS (
  SELECT doc_id, len(h) // 2 AS n, h, unnest(range(0, len(h) // 2, 500)) AS pos FROM d
), piece AS (
  SELECT doc_id, n, pos, substr(h, 2 * pos + 1, 1398) AS t FROM block
), p AS (
  SELECT doc_id, n, pos, t, unnest(range(0, 500)) AS j FROM piece
), s AS (
  SELECT doc_id, pos + j AS i, md5_number(substr(t, 2 * j + 1, 400)) AS k FROM p WHERE pos + j <= n - 200
), r AS (
  SELECT k FROM s GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM r)
), step AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER w + 200, true) AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), run AS (
  SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM step
), span AS (
  SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY doc_id, g
), gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM span
), cut AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(b) AS last
  FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
SQL["op6_suffix_dedup"] = OP6

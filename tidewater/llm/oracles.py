"""DuckDB SQL of the operators that SQL can state, for comparison on small tables."""

from __future__ import annotations

_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


_ROWS = "t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents)"

JACCARD = f"""WITH RECURSIVE {_ROWS}, w AS (SELECT rid, doc_id, regexp_extract_all({_low('text')}, '{_SPACE}') AS ws FROM t),
  sh AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(ws[i : i + 2], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)),
  n AS MATERIALIZED (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
  linked AS MATERIALIZED (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM sh AS x JOIN sh AS y ON x.k = y.k AND x.rid < y.rid GROUP BY x.rid, y.rid) JOIN n AS na ON na.rid = a JOIN n AS nb ON nb.rid = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
  e AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
  r AS (SELECT rid, rid AS to_ FROM t UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.to_)
  SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM t JOIN r ON r.rid = t.rid JOIN t AS o ON o.rid = r.to_ LEFT JOIN n ON n.rid = t.rid GROUP BY t.rid, t.doc_id, n.n"""

DECONTAMINATION = f"""WITH {_ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, regexp_extract_all({_low('text')}, '{_ALNUM}') AS ws FROM t),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM benchmark),
  iw AS MATERIALIZED (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i : i + 9], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
  dw AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
  h AS MATERIALIZED (SELECT rid, i, dw.n, item FROM dw JOIN iw ON iw.k = dw.k AND iw.n = dw.n),
  hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
  its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM w LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""

QUALITY_RULES = f"""WITH {_ROWS}, w AS MATERIALIZED (SELECT *, coalesce(source, chr(0)) AS host, coalesce('i' || doc_id, 't' || text) AS doc, regexp_extract_all(text, '{_SPACE}') AS ws FROM t),
  ls AS MATERIALIZED (SELECT rid, host, doc, line, regexp_extract_all({_low('line')}, '{_SPACE}') AS lw FROM (SELECT rid, host, doc, unnest(string_split(text, chr(10))) AS line FROM w)),
  dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ls WHERE len(lw) > 0 GROUP BY rid),
  win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8))),
  rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win WHERE c > 1) GROUP BY rid),
  held AS (SELECT host, array_to_string(lw, ' ') AS k, count(DISTINCT doc) AS docs FROM ls WHERE len(lw) > 0 GROUP BY ALL),
  hosts AS (SELECT host, count(DISTINCT doc) AS of_ FROM w GROUP BY host),
  over_ AS MATERIALIZED (SELECT host, k FROM held JOIN hosts USING (host) WHERE docs > least(10, greatest(2, of_ * 0.5::DOUBLE))),
  lost AS (SELECT rid, sum(len(lw)) AS n FROM ls JOIN over_ ON over_.host = ls.host AND over_.k = array_to_string(lw, ' ') WHERE len(lw) > 0 GROUP BY rid),
  s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_line_words FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
  SELECT *, NOT base_failed AND n_words - n_line_words >= 0.3::DOUBLE * n_words AS kept FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)"""

SUBSTRING = f"""WITH {_ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, regexp_extract_all(text, '{_SPACE}') AS ws FROM t),
  win AS (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM (SELECT rid, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35))),
  cut AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM win WHERE c > 1),
  kept AS (SELECT w.rid, array_to_string(list(x.word ORDER BY x.p) FILTER (cut.p IS NULL), ' ') AS kept, count(cut.p) AS n_removed FROM w, LATERAL (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p) AS x LEFT JOIN cut ON cut.rid = w.rid AND cut.p = x.p GROUP BY w.rid)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)"""

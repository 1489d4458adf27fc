"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _tokens(text: str, ratio: str = "3.8") -> str:
    n = f"length(trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g')))"
    return f"(CASE WHEN {text} IS NULL OR {n} = 0 THEN 0 ELSE greatest(1, round({n} / CAST({ratio} AS DOUBLE))) END)"


_WORDS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}]+')"
_RUNS = "list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))"
_SPANS = """
t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400),
w AS (SELECT doc_id, i, md5(substr(text, CAST(i AS BIGINT), 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM t)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id))"""

SQL = {
    "p4_found": f"""
WITH c AS (SELECT DISTINCT chunk_id AS id, {_WORDS % "content"} AS w FROM chunks),
t AS (SELECT DISTINCT doc_id AS id, array_to_string({_WORDS % "title"}, ' ') AS w FROM documents WHERE title IS NOT NULL),
s AS (
  SELECT DISTINCT 'chunk' AS record_kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM c WHERE len(w) >= 20
  UNION ALL SELECT DISTINCT 'title', id, unnest(list_transform(range(1, CAST(length(w) - 1 AS BIGINT)), lambda i: substr(w, i, 3))) FROM t WHERE length(w) >= 15),
n AS (SELECT record_kind, id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.record_kind, a.id AS id_a, b.id AS id_b, count(*) AS i FROM s a JOIN s b ON a.record_kind = b.record_kind AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT p.record_kind, id_a, id_b FROM p JOIN n x ON x.record_kind = p.record_kind AND x.id = id_a JOIN n y ON y.record_kind = p.record_kind AND y.id = id_b WHERE i * 10 >= 7 * (x.n + y.n - i)""",
    "p5_found": f"""
SELECT DISTINCT record_kind, doc_id, item_no FROM (
  SELECT 'chunk' AS record_kind, doc_id, chunk_index AS item_no, {_tokens("content")} AS b, {_tokens("section_path")} AS t FROM chunks
  UNION ALL SELECT 'block', doc_id, block_pos, {_tokens("block_text", "CASE WHEN block_type = 'code' THEN 2.9 ELSE 3.8 END")}, {_tokens("array_to_string(heading_path, ' > ')")} FROM blocks)
WHERE b + t > 700 AND b > 0""",
    "p5_coverage": f"""
SELECT record_kind, doc_id, item_no, CAST(n AS BIGINT) AS n_chars, true AS sound FROM (
  SELECT 'chunk' AS record_kind, doc_id, chunk_index AS item_no, length(content) AS n, {_tokens("content")} AS b, {_tokens("section_path")} AS t FROM chunks
  UNION ALL SELECT 'block', doc_id, block_pos, length(block_text), {_tokens("block_text", "CASE WHEN block_type = 'code' THEN 2.9 ELSE 3.8 END")}, {_tokens("array_to_string(heading_path, ' > ')")} FROM blocks)
WHERE b + t > 700 AND b > 0""",
    "p6_assigned": "SELECT doc_id, count(*) AS n_rows, true AS whole FROM documents GROUP BY 1",
    "p7_found": f"""
WITH c AS (SELECT case_id, {_WORDS % "question"} AS w FROM eval_cases UNION ALL SELECT case_id, {_WORDS % "passage"} FROM eval_cases),
d AS (SELECT doc_id, {_WORDS % "text"} AS w FROM documents),
cw AS (SELECT DISTINCT case_id, unnest({_RUNS}) AS s FROM c WHERE len(w) >= 13),
dw AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS s FROM d WHERE len(w) >= 13)
SELECT DISTINCT case_id, doc_id FROM cw JOIN dw USING (s)""",
    "p8_shared_share": f"""
WITH {_SPANS}, p AS (SELECT DISTINCT doc_id, i FROM w JOIN s USING (h)),
g AS (SELECT doc_id, least(400, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 400)) AS n FROM p)
SELECT doc_id, any_value(length(text)) AS n_chars, CAST(sum(n) AS BIGINT) AS shared_chars FROM g JOIN t USING (doc_id) GROUP BY 1""",
    "p8_found": f"""
WITH {_SPANS}, m AS (SELECT DISTINCT doc_id, h FROM w JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id""",
}

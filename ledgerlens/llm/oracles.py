"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: crc32 over decimal digits, bit by bit, as DuckDB has no such function.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', CAST({value} AS VARCHAR)) END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
roots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, n, h FROM roots
  UNION ALL
  SELECT level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 8),
every AS (
  SELECT tree, level, idx, h FROM nodes WHERE n > 1 UNION ALL SELECT '', level, idx, h FROM tops WHERE n > 1),
runs AS (
  SELECT *, list(h) OVER run AS hs, row_number() OVER run AS nth, idx // 8 AS up FROM every
  WINDOW run AS (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sides AS (SELECT tree, level, idx, array_to_string(hs[1:nth - 1], '') AS l, array_to_string(hs[nth + 1:8], '') AS r FROM runs),
ways AS (
  SELECT p.doc_id, p.leaf, p.idx, s.level, s.l, s.r FROM placed p JOIN sides s ON s.tree = p.tree AND s.idx = p.idx // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT p.doc_id, p.leaf, p.idx, 1000 + s.level, s.l, s.r FROM placed p JOIN roots t ON p.tree = t.tree
  JOIN sides s ON s.tree = '' AND s.idx = t.idx // (8 ** s.level)::BIGINT),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf, idx ORDER BY level) AS k FROM ways),
folds AS (
  SELECT doc_id, leaf, idx, tree, 0::BIGINT AS k, coalesce(changed, leaf) AS h FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.idx, f.tree, s.k, sha256(s.l || f.h || s.r) FROM folds f
  JOIN steps s ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.leaf = f.leaf AND s.idx = f.idx AND s.k = f.k + 1),
folded AS (SELECT doc_id, leaf, idx, any_value(tree) AS tree, arg_max(h, k) AS h FROM folds GROUP BY doc_id, leaf, idx),
proofs AS (SELECT doc_id, leaf, idx, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM steps GROUP BY doc_id, leaf, idx)
SELECT f.doc_id, f.leaf, t.h AS subroot, o.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM folded f JOIN roots t ON f.tree = t.tree JOIN tops o ON o.n = 1
LEFT JOIN proofs p ON p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.leaf = f.leaf AND p.idx = f.idx"""


_TERMS = r"regexp_extract_all(translate(text, '%s', '%s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')" % (_UPPER, _UPPER.lower())

SEARCH = f"""
WITH occurrences AS (
  SELECT doc, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)),
counted AS (SELECT doc, doc_id, term, count(*) AS tf FROM occurrences GROUP BY doc, doc_id, term),
sizes AS (SELECT doc, sum(tf)::BIGINT AS n FROM counted GROUP BY doc),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS occ FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term),
damped AS (SELECT doc, 100 - 50 + (50 * n * docs) // occ AS m FROM sizes, totals),
asked AS (SELECT DISTINCT item, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
scores AS (
  SELECT item, item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN damped USING (doc) GROUP BY item, item_id, doc, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""

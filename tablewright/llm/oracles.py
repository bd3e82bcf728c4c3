"""SQL with the same results as the registered queries that SQL can express."""

from __future__ import annotations

#: The table of crc32 by its rule, for ``crc32 % n`` of a few bytes.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
)"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text, where ``t`` is the table."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


IMPORTANCE = f"""
WITH {_CRC_TABLE},
texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), words AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), features AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM words
), bucketed AS (
  SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc_table
), counts AS (
  SELECT side, doc_id, bucket, count(*) AS n FROM features JOIN bucketed USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counts GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM sums, totals
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counts JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

REPEATED_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated r USING (key) GROUP BY doc_id
"""


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode(CAST({name} AS VARCHAR))) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([*map(_field, ['doc_id', 'source', 'lang', 'n_chars']), _field(text)])})"


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged
  FROM documents, crc_table
), placed AS (
  SELECT *, coalesce(forged, leaf) AS start, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves
), inner_nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx)) FROM inner_nodes WHERE n > 1 GROUP BY tree, level, idx // 8
), subroots AS (
  SELECT tree, hash AS subroot FROM inner_nodes WHERE n = 1
), upper_nodes AS (
  SELECT -1::BIGINT AS tree, 0 AS level, tree AS idx, count(*) OVER () AS n, subroot AS hash FROM subroots
  UNION ALL
  SELECT tree, level + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1 GROUP BY tree, level, idx // 8
), nodes AS (
  SELECT * FROM inner_nodes UNION ALL SELECT * FROM upper_nodes
), runs AS (
  SELECT tree, level, idx // 8 AS up, list(hash ORDER BY idx) AS run FROM nodes WHERE n > 1 GROUP BY ALL
), climb AS (
  SELECT doc_id, tree AS own, tree, 0 AS level, idx, n, start AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, own, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.idx // 8 ELSE own END,
    CASE WHEN c.n > 1 THEN (c.n + 7) // 8 ELSE (SELECT count(*) FROM subroots) END,
    CASE WHEN c.n > 1 THEN sha256(array_to_string(r.run[:c.idx % 8] || [c.folded] || r.run[c.idx % 8 + 2:], '')) ELSE c.folded END,
    CASE WHEN c.n > 1 THEN c.proof || array_to_string(r.run[:c.idx % 8] || r.run[c.idx % 8 + 2:], '') ELSE c.proof END
  FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.up = c.idx // 8 AND c.n > 1
  WHERE c.n > 1 OR c.tree <> -1
)
SELECT p.doc_id, p.leaf, s.subroot, u.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = u.hash AS verified
FROM placed p JOIN subroots s USING (tree) JOIN climb c ON c.doc_id = p.doc_id AND c.tree = -1 AND c.n = 1, (SELECT hash FROM upper_nodes WHERE n = 1) u
"""

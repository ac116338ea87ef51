"""DuckDB statements for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

#: Order of a conversation's rows, as format_chats sorts them.
_TURNS = "turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

CHAT = f"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), turns AS (
  SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t,
    coalesce(lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY {_TURNS}), '') AS before
  FROM rows
), sized AS (
  SELECT *,
    (r IN ('system', 'user') AND before = '') OR (r = 'user' AND before IN ('system', 'assistant')) OR (r = 'assistant' AND before = 'user') AS ok,
    4 + CASE r WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
        ELSE 2 + length(regexp_replace(r, '(\\\\|###|</turn>|\\])', '\\\\\\1', 'g')) END + 2
      + length(regexp_replace(t, '(\\\\|###|</turn>)', '\\\\\\1', 'g')) + 8 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY {_TURNS})) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY {_TURNS}) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(ok) AS valid_order
FROM sized GROUP BY conv_id
"""

#: Pairs of different sets that share a shingle, then what is reachable by links.
JACCARD = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s
  FROM words
), firsts AS (
  SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (
  SELECT id, n, unnest(s) AS g FROM firsts
), links AS (
  SELECT a.id AS x, b.id AS y
  FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT id AS x, id AS y FROM firsts
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN firsts ON sets.s = firsts.s LEFT JOIN least ON least.x = firsts.id
"""

#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
    lambda r, b: list_reduce(list_concat([xor(r, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)"""


def _leaf(text: str) -> str:
    fields = " || ".join(f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({fields})"


#: Trees bottom up (t 0: of a lang, t 1: over langs), then each leaf's siblings, and a fold of each leaf.
MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC.format(x="doc_id")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), up AS (
  SELECT 0 AS k, lang, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT k + 1, lang, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY k, lang, place // 8, n
), tops AS (
  SELECT lang, k AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), over_langs AS (
  SELECT 0 AS k, place, subroot AS node, n FROM tops
  UNION ALL
  SELECT k + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8 FROM over_langs WHERE n > 1 GROUP BY k, place // 8, n
), steps AS (
  SELECT p.doc_id, p.leaf, u.k, coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (u.place < p.place // CAST(8 ** u.k AS BIGINT)), '') AS before,
    coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (u.place > p.place // CAST(8 ** u.k AS BIGINT)), '') AS after
  FROM placed p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.n > 1 AND u.place // 8 = p.place // CAST(8 ** (u.k + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.leaf, t.height + u.k, coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (u.place < t.place // CAST(8 ** u.k AS BIGINT)), ''),
    coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (u.place > t.place // CAST(8 ** u.k AS BIGINT)), '')
  FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang JOIN over_langs u ON u.n > 1 AND u.place // 8 = t.place // CAST(8 ** (u.k + 1) AS BIGINT) GROUP BY p.doc_id, p.leaf, t.height, u.k
), folded AS (
  SELECT doc_id, leaf, 0 AS k, coalesce(changed, leaf) AS node FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.k + 1, sha256(s.before || f.node || s.after) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.k = f.k
), proofs AS (
  SELECT doc_id, leaf, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY ALL
), ends AS (
  SELECT doc_id, leaf, arg_max(node, k) AS folded_root FROM folded GROUP BY ALL
), top AS (
  SELECT node AS root FROM over_langs WHERE n = 1
)
SELECT p.doc_id, p.leaf, t.subroot, top.root, coalesce(x.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang JOIN ends e ON e.doc_id = p.doc_id AND e.leaf = p.leaf
LEFT JOIN proofs x ON x.doc_id = p.doc_id AND x.leaf = p.leaf CROSS JOIN top
"""

WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM firsts
"""

ORACLES = {"op1_chat_formatting": CHAT, "op7_jaccard_join": JACCARD, "op11_merkle_manifest": MERKLE, "op12_warc": WARC}

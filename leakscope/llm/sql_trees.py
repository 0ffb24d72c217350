"""DuckDB statements of the operators on trees. SHA-256 is built in; CRC-32 is
restated as a table of the 256 bytes and a fold over the characters."""

from __future__ import annotations

SQL: dict[str, str] = {}

_TABLE = ("crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: "
          "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)")


def _crc(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text; ``t`` of ``crc`` must be in scope."""
    return (f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _tree(name: str, leaves: str) -> str:
    """All nodes (tree, lvl, idx, n, d) over leaves (tree, idx, n, d)."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, idx, n, d FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1
  GROUP BY tree, lvl, idx // 3, n)"""


SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE {_TABLE},
a AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
             {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
             coalesce({_crc("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) AS hit FROM documents, crc),
b AS (SELECT doc_id, tree, sha256(head || {_field("text")}) AS d,
             CASE WHEN hit THEN sha256(head || {_field("replace(text, chr(10), '')")}) ELSE sha256(head || {_field("text")}) END AS claim FROM a),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM b),
{_tree("nodes", "leaves")},
subroots AS (SELECT '' AS tree, tree AS source_tree, d, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree("tops", "subroots")},
path AS (SELECT doc_id, l.idx, l.tree, s.idx AS sidx, s.d AS subroot, l.d AS leaf, l.claim FROM leaves l JOIN subroots s ON s.source_tree = l.tree),
beside AS (
  SELECT p.tree, p.idx, x.lvl, string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx < p.idx // CAST(3 ** x.lvl AS BIGINT)) AS before,
         string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx > p.idx // CAST(3 ** x.lvl AS BIGINT)) AS after
  FROM (SELECT tree, idx FROM path) p JOIN nodes x ON x.tree = p.tree AND x.n > 1 AND x.idx // 3 = (p.idx // CAST(3 ** x.lvl AS BIGINT)) // 3
  GROUP BY p.tree, p.idx, x.lvl
  UNION ALL
  SELECT p.tree, p.idx, 1000 + x.lvl, string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx < p.sidx // CAST(3 ** x.lvl AS BIGINT)),
         string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx > p.sidx // CAST(3 ** x.lvl AS BIGINT))
  FROM path p JOIN tops x ON x.n > 1 AND x.idx // 3 = (p.sidx // CAST(3 ** x.lvl AS BIGINT)) // 3
  GROUP BY p.tree, p.idx, x.lvl),
steps AS (SELECT tree, idx, coalesce(before, '') AS before, coalesce(after, '') AS after,
                 row_number() OVER (PARTITION BY tree, idx ORDER BY lvl) AS k FROM beside),
proofs AS (SELECT tree, idx, sha256(string_agg(before || after, '' ORDER BY k)) AS proof, count(*) AS n_steps FROM steps GROUP BY tree, idx),
folds AS (SELECT tree, idx, 0 AS k, claim AS d FROM path
  UNION ALL SELECT f.tree, f.idx, s.k, sha256(s.before || f.d || s.after) FROM folds f JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.k = f.k + 1),
root AS (SELECT d AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, p.subroot, root, coalesce(q.proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM path p LEFT JOIN proofs q ON q.tree = p.tree AND q.idx = p.idx
JOIN folds f ON f.tree = p.tree AND f.idx = p.idx AND f.k = coalesce(q.n_steps, 0) CROSS JOIN root
"""

SQL["op13_prefix_trie"] = f"""
WITH {_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
             strlen(role) || ':' || role || strlen(text) || ':' || text AS x, CAST(length(text) AS BIGINT) AS chars FROM t),
n AS (SELECT conv_id, count(*) AS own FROM o GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM n, crc),
c AS (SELECT h.*, least(h.h, coalesce(n.own, 0)) AS given FROM h LEFT JOIN n ON n.conv_id = h.base),
r AS (SELECT c.conv_id, o.pos AS depth, x, chars FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.given
      UNION ALL SELECT c.conv_id, o.pos - c.h + c.given, x, chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
k AS (SELECT conv_id, depth, chars, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS len FROM k),
node AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) = depth AS leaf, (count(*) - 1) * min(chars) AS saved,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '') AS ends FROM m GROUP BY k, depth),
up AS (SELECT m.k, m.depth, sum(CAST(u.leaf AS BIGINT)) AS n_leaves, sum(u.saved) AS saved, count(*) FILTER (u.depth = m.depth + 1) AS n_children
       FROM node u JOIN m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.k, m.depth),
par AS (SELECT u.k, u.depth, v.conv_id FROM node u JOIN m ON m.conv_id = u.conv_id AND m.depth = u.depth - 1 JOIN node v ON v.k = m.k AND v.depth = m.depth)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, par.conv_id AS parent_conv_id, n_convs, n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM node JOIN up ON up.k = node.k AND up.depth = node.depth LEFT JOIN par ON par.k = node.k AND par.depth = node.depth
"""

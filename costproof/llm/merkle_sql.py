"""The manifest of ``merkle`` in SQL, for whole tables without repeated rows."""

from __future__ import annotations

_ENC = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384))))")


def _levels(name: str, leaves: str) -> str:
    """Levels of trees (tree, level, idx, digest, n nodes of the level), and for each node what stands left and right of it in its run."""
    run = "OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx ROWS BETWEEN {})"
    return f"""{name} AS (SELECT tree, 0 AS level, idx, digest, n FROM {leaves}
  UNION ALL SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 15) // 16) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 16),
{name}_steps AS (SELECT tree, level, idx, coalesce(string_agg(digest, '') {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l,
  coalesce(string_agg(digest, '') {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM {name} WHERE n > 1)"""


def _climb(name: str, start: str, levels: str) -> str:
    """Digest and proof of each row of ``start`` (rid, tree, idx, h, proof) on its way up."""
    return f"""{name} AS (SELECT rid, tree, 0 AS level, idx, h, proof FROM {start}
  UNION ALL SELECT w.rid, w.tree, w.level + 1, w.idx // 16, sha256(s.l || w.h || s.r), w.proof || s.l || s.r FROM {name} w JOIN {levels}_steps s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx),
{name}_end AS (SELECT rid, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM {name} GROUP BY rid, tree)"""


MANIFEST = f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS tree, {_LEAF.format(text='text')} AS digest,
  {_LEAF.format(text=f"(CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)")} AS found FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM base),
{_levels('inside', 'leaves')},
subroots AS (SELECT tree AS source_tree, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM inside WHERE n = 1),
{_levels('above', 'subroots')},
root AS (SELECT digest AS root FROM above WHERE n = 1),
low AS (SELECT rid, tree, idx, found AS h, '' AS proof FROM leaves),
{_climb('lower', 'low', 'inside')},
high AS (SELECT rid, s.tree, s.idx, h, proof FROM lower_end JOIN subroots s ON s.source_tree = lower_end.tree),
{_climb('upper', 'high', 'above')}
SELECT doc_id, b.digest AS leaf, s.digest AS subroot, root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = root AS verified
FROM base b JOIN subroots s ON s.source_tree = b.tree JOIN upper_end u ON u.rid = b.rid CROSS JOIN root
"""

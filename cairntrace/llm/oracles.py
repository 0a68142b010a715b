"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\l/turn>'), '### ', '\h## ') AS shown FROM rows)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown) + length(role) + length('### : </turn>') + 2) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text) || ',',
                    '(system,)?user,(assistant,user,)*(assistant,)?|system,') AS valid
FROM coded GROUP BY conv_id
"""

ORACLES["op4_exact_topk"] = r"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

#: Levels that the SQL of the manifest goes up inside a source and over the sources: 3^10 rows of a source.
_LEVELS = 10


def _tree_sql(leaves: str, name: str) -> str:
    """Tables over `leaves` (tree, pos, total, h): per level <name>_n0.. the nodes, <name>_r0.. the runs, and
    <name>_p0.. per leaf (tree, leaf, at, proof, before, after) of the way so far."""
    parts = [f"{name}_n0 AS (SELECT tree, pos, total, h FROM {leaves})"]
    for k in range(_LEVELS):
        parts.append(
            f"{name}_r{k} AS (SELECT tree, pos // 3 AS run, any_value(total) AS total, list(h ORDER BY pos) AS hs "
            f"FROM {name}_n{k} GROUP BY tree, pos // 3)"
        )
        parts.append(
            f"{name}_n{k + 1} AS (SELECT tree, run AS pos, (total + 2) // 3 AS total, "
            f"CASE WHEN total > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}_r{k})"
        )
    parts.append(
        f"{name}_p0 AS (SELECT tree, pos AS leaf, pos AS at, CAST([] AS VARCHAR[]) AS before, CAST([] AS VARCHAR[]) AS after "
        f"FROM {leaves})"
    )
    for k in range(_LEVELS):
        j = "(p.at % 3)"
        parts.append(
            f"{name}_p{k + 1} AS (SELECT p.tree, p.leaf, p.at // 3 AS at, "
            f"CASE WHEN r.total > 1 THEN list_append(p.before, array_to_string(hs[1:{j}], '')) ELSE p.before END AS before, "
            f"CASE WHEN r.total > 1 THEN list_append(p.after, array_to_string(hs[{j} + 2:], '')) ELSE p.after END AS after "
            f"FROM {name}_p{k} p JOIN {name}_r{k} r ON r.tree = p.tree AND r.run = p.at // 3)"
        )
    return ",\n".join(parts)


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# crc32 bit by bit: per character its code and eight shifts, marked -1.
_EVEN_CRC = (
    "list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), "
    "lambda c: CASE WHEN c = '' THEN CAST([] AS BIGINT[]) ELSE list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]) END))), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) & 1 = 1"
)

ORACLES["op13_merkle_manifest"] = f"""
WITH told AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf('text')} AS h,
    CASE WHEN {_EVEN_CRC} THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS seen
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS total FROM told),
{_tree_sql('placed', 'a')},
subroots AS (
  SELECT '' AS tree, tree AS source_key, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS total
  FROM a_n{_LEVELS}),
{_tree_sql('subroots', 'b')},
ways AS (
  SELECT l.doc_id, l.h AS leaf, l.seen, s.h AS subroot, r.h AS root,
    list_concat(p.before, q.before) AS before, list_concat(p.after, q.after) AS after
  FROM placed l JOIN a_p{_LEVELS} p ON p.tree = l.tree AND p.leaf = l.pos
  JOIN subroots s ON s.source_key = l.tree JOIN b_p{_LEVELS} q ON q.leaf = s.pos CROSS JOIN b_n{_LEVELS} r),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(range(1, len(before) + 1), lambda i: before[i] || after[i]), '')) AS proof_sha256,
    list_reduce(list_concat([seen], list_transform(range(1, len(before) + 1), lambda i: before[i] || '|' || after[i])),
      lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM ways)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

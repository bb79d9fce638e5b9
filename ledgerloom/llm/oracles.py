"""DuckDB SQL of the queries that SQL can express."""

#: crc32 over the decimal digits bit by bit, prefixes as lists of turn numbers.
PREFIX_TRIE = """
WITH digits AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)
), turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv, place, length(text) AS size, dense_rank() OVER (ORDER BY role, text) AS t FROM turns
), ids AS (
  SELECT conv, conv - conv % 100 AS base,
         xor(list_reduce(list_transform(range(length(conv::VARCHAR)), lambda k: ascii(substr(conv::VARCHAR, k + 1, 1))::BIGINT),
                         lambda c, x: xor(t[(xor(c, x) % 256) + 1], c // 256), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv FROM numbered), digits
), lent AS (
  SELECT ids.conv, n.place, n.t, n.size FROM ids JOIN numbered AS n ON n.conv = ids.base AND n.place < ids.h
), whole AS (
  SELECT conv, 0 AS part, place, t, size FROM lent
  UNION ALL SELECT n.conv, 1, n.place, n.t, n.size FROM numbered AS n JOIN ids USING (conv) WHERE n.place >= ids.h
), paths AS (
  SELECT conv, coalesce(list(t ORDER BY part, place) FILTER (t IS NOT NULL), []) AS path
  FROM ids LEFT JOIN whole USING (conv) GROUP BY conv
), sizes AS (
  SELECT DISTINCT t, size FROM numbered
), nodes AS (
  SELECT d AS depth, list_slice(path, 1, d) AS path, min(conv) AS conv_id, count(*) AS n_convs,
         string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (len(path) = d) AS ends
  FROM (SELECT conv, path, unnest(range(len(path) + 1)) AS d FROM paths) GROUP BY 1, 2
), own AS (
  SELECT nodes.*, c.n AS n_children, (n_convs - 1) * coalesce(s.size, 0) AS saved
  FROM nodes LEFT JOIN (SELECT depth - 1 AS depth, list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2) AS c USING (depth, path)
  LEFT JOIN sizes AS s ON s.t = nodes.path[nodes.depth]
), sums AS (
  SELECT d AS depth, list_slice(path, 1, d) AS path, sum((n_children IS NULL)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS d FROM own) GROUP BY 1, 2
)
SELECT own.conv_id::BIGINT AS conv_id, own.depth::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, own.n_convs::BIGINT AS n_convs,
       coalesce(own.n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sums USING (depth, path)
LEFT JOIN nodes AS up ON up.depth = own.depth - 1 AND up.path = list_slice(own.path, 1, own.depth - 1)
"""

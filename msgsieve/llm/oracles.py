"""SQL twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"""w AS (SELECT pos, unnest(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g')), lambda x: x <> ''))) AS word FROM combined),
  n AS (SELECT pos, count(*) AS c FROM w GROUP BY pos),
  s AS (SELECT a.pos AS pos_a, b.pos AS pos_b, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.pos < b.pos GROUP BY ALL),
  near AS (SELECT pos_a, pos_b FROM s JOIN n x ON x.pos = pos_a JOIN n y ON y.pos = pos_b WHERE s.c::DOUBLE / (x.c + y.c - s.c) >= 0.7)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_WORDS} SELECT pos_a, pos_b FROM near",
    "p1_classes": f"""WITH RECURSIVE {_WORDS}, e AS (SELECT pos_a AS a, pos_b AS b FROM near UNION ALL SELECT pos_b, pos_a FROM near), r AS (SELECT pos AS node, pos AS root FROM combined UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b),
  k AS (SELECT node, min(root) AS class_id FROM r GROUP BY node), o AS (SELECT e.a AS pos, count(*) AS links FROM e JOIN n x ON x.pos = e.a JOIN n y ON y.pos = e.b JOIN (SELECT pos_a, pos_b, c FROM s UNION ALL SELECT pos_b, pos_a, c FROM s) s2 ON s2.pos_a = e.a AND s2.pos_b = e.b WHERE s2.c < greatest(x.c, y.c) GROUP BY e.a)
  SELECT k.node AS pos, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows, coalesce(links, 0) AS links FROM k LEFT JOIN o ON o.pos = k.node""",
    "p4_found": f"WITH {_WORDS} SELECT pos_a, pos_b FROM near JOIN combined x ON x.pos = pos_a JOIN combined y ON y.pos = pos_b WHERE (x.split = 'train' AND y.split IN ('val', 'test')) OR (y.split = 'train' AND x.split IN ('val', 'test'))",
    "p6_found": f"WITH {_WORDS}, e AS (SELECT pos_a, pos_b FROM near UNION ALL SELECT pos_b, pos_a FROM near) SELECT DISTINCT x.pos FROM e JOIN combined x ON x.pos = pos_a JOIN combined y ON y.pos = pos_b WHERE y.ingest_no < x.ingest_no",
}

"""SQL fragments that several oracle queries share (DuckDB)."""

NEWEST = """newest AS (SELECT project_id, path, length, modification_time, content FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY modification_time DESC NULLS LAST, scanned_at DESC NULLS LAST, content DESC NULLS LAST, length DESC NULLS LAST) AS rn
  FROM files WHERE path IS NOT NULL) WHERE rn = 1)"""
LINES = NEWEST + """, cut AS (SELECT project_id, path, string_split(replace(regexp_replace(content, '^﻿', ''), chr(13), ''), chr(10)) AS a FROM newest WHERE content IS NOT NULL),
lines AS (SELECT project_id, path, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM cut)"""
PATHS = "paths AS (SELECT DISTINCT project_id, path FROM files WHERE path IS NOT NULL)"
NODES = "n AS (SELECT DISTINCT * FROM nodes)"
MEMBER = "member AS (SELECT DISTINCT id, CASE WHEN kind = 'module' THEN id ELSE module_id END AS module FROM nodes)"
MODULE_EDGES = MEMBER + """, dep AS (SELECT a.module AS f, b.module AS t, count(*) AS edge_count, CAST(coalesce(sum(weight), 0) AS BIGINT) AS w, CAST(coalesce(sum(support_count), 0) AS BIGINT) AS support_count
  FROM edges e JOIN member a ON e.from_id = a.id JOIN member b ON e.to_id = b.id
  WHERE e.kind IN ('includes', 'calls', 'inherits', 'uses_type', 'overrides') AND a.module IS NOT NULL AND b.module IS NOT NULL AND a.module <> b.module GROUP BY 1, 2)"""
COMMERCE = """commerce AS (SELECT s_nationkey AS f, c_nationkey AS t, count(*) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
DAG = COMMERCE + """, dag AS (SELECT f, t, w FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY w DESC, t) AS r FROM commerce WHERE f < t) WHERE r <= 3)"""


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def ext(path: str = "path") -> str:
    return f"lower(CASE WHEN contains({path}, '.') THEN '.' || regexp_extract({path}, '([^.]*)$', 1) ELSE '' END)"


def base(path: str = "path") -> str:
    return f"lower(regexp_extract({path}, '([^/]*)/*$', 1))"

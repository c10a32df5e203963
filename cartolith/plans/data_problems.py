"""Queries of the data-processing operators in the core: heavy keys (3) and hierarchies (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.hierarchy import hierarchy, with_ancestors
from cartolith.operators.skew import end_totals, heavy_ends
from cartolith.runtime import Staged, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_ends(table(spark, sf_dir, "edges")).select("side", "node_id")


def p3_end_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return end_totals(table(spark, sf_dir, "edges")).where("node_id IS NOT NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "semantic_symbols")).select("project_id", "identity_key", "root_key", "depth")


def _unwound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ancestors(Staged(hierarchy(table(spark, sf_dir, "semantic_symbols")), "tree").df)


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array_join(F.concat("ancestors", F.array("identity_key")), " > ")
    return _unwound(spark, sf_dir).select("project_id", "identity_key", "depth", path.alias("path"), "descendants")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unwound(spark, sf_dir).select("project_id", F.explode("ancestors").alias("ancestor_key"), F.col("identity_key").alias("descendant_key"))


QUERIES = {"p3_found": p3_found, "p3_end_totals": p3_end_totals, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_TREE = """
        WITH RECURSIVE s AS (SELECT project_id, identity_key, max(nullif(parent_identity_key, '')) AS parent_key FROM semantic_symbols GROUP BY project_id, identity_key),
        tree AS (SELECT project_id, identity_key, [identity_key] AS path FROM s
                 WHERE parent_key IS NULL OR NOT EXISTS (SELECT 1 FROM s AS p WHERE p.project_id = s.project_id AND p.identity_key = s.parent_key)
                 UNION ALL SELECT s.project_id, s.identity_key, list_append(t.path, s.identity_key)
                 FROM s JOIN tree AS t ON s.project_id = t.project_id AND s.parent_key = t.identity_key),
        pairs AS (SELECT project_id, unnest(path[1:len(path) - 1]) AS ancestor_key, identity_key AS descendant_key FROM tree)"""

SQL = {
    "p3_found": """
        WITH ends AS (SELECT 'from' AS side, from_id AS node_id FROM edges UNION ALL SELECT 'to', to_id FROM edges)
        SELECT side, node_id FROM ends WHERE node_id IS NOT NULL AND node_id <> 0
        GROUP BY side, node_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)""",
    "p3_end_totals": """
        WITH ends AS (SELECT 'from' AS side, from_id AS node_id, weight FROM edges UNION ALL SELECT 'to', to_id, weight FROM edges)
        SELECT side, node_id, count(*) AS row_count, CAST(coalesce(sum(weight), 0) AS BIGINT) AS total_weight
        FROM ends WHERE node_id IS NOT NULL GROUP BY side, node_id""",
    "p5_paths": _TREE + """
        SELECT t.project_id, t.identity_key, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, ' > ') AS path, coalesce(n, 0) AS descendants FROM tree t
        LEFT JOIN (SELECT project_id, ancestor_key, count(*) AS n FROM pairs GROUP BY 1, 2) d ON d.project_id = t.project_id AND d.ancestor_key = t.identity_key""",
    "p5_descendants": _TREE + " SELECT * FROM pairs",
    "p5_found": """
        WITH RECURSIVE s AS (SELECT project_id, identity_key, max(nullif(parent_identity_key, '')) AS parent_key
                             FROM semantic_symbols GROUP BY project_id, identity_key),
        tree AS (SELECT project_id, identity_key, identity_key AS root_key, 0 AS depth FROM s
                 WHERE parent_key IS NULL OR NOT EXISTS (SELECT 1 FROM s AS p WHERE p.project_id = s.project_id AND p.identity_key = s.parent_key)
                 UNION ALL SELECT s.project_id, s.identity_key, t.root_key, t.depth + 1
                 FROM s JOIN tree AS t ON s.project_id = t.project_id AND s.parent_key = t.identity_key)
        SELECT s.project_id, s.identity_key, coalesce(t.root_key, '') AS root_key, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth
        FROM s LEFT JOIN tree AS t ON s.project_id = t.project_id AND s.identity_key = t.identity_key""",
}

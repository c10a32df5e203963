"""Queries of the training-data operators and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import credentials, encoding, leakage, mixing, sourcefiles, syntax, topn
from cartolith.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcefiles.machine_files(table(spark, sf_dir, "files")).select("project_id", F.col("path").alias("file_path"))


def p1_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcefiles.hand_written(table(spark, sf_dir, "files"), table(spark, sf_dir, "nodes"), table(spark, sf_dir, "analysis_report"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = topn.strongest_targets(table(spark, sf_dir, "edges")).select(F.lit("edge").alias("group_type"), F.col("from_id").alias("group_id"), F.col("to_id").alias("item_id"))
    module = topn.best_candidates(table(spark, sf_dir, "nodes")).select(F.lit("module").alias("group_type"), F.col("module_id").alias("group_id"), F.col("id").alias("item_id"))
    return edge.unionByName(module)


def p2_strongest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.strongest_targets(table(spark, sf_dir, "edges"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.found(table(spark, sf_dir, "ai_requests"), table(spark, sf_dir, "ai_config"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = credentials.scan(table(spark, sf_dir, "ai_requests"), "request_id", "code_excerpt").withColumn("source_table", F.lit("ai_requests"))
    config = credentials.scan(table(spark, sf_dir, "ai_config"), "config_id", "api_key", key_field=True).withColumn("source_table", F.lit("ai_config"))
    return requests.unionByName(config).select("source_table", "record_id", F.array_join("kinds", ",").alias("kinds"), "redacted")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf_dir, "files")).select("project_id", F.col("path").alias("file_path"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, sf_dir, "files"), table(spark, sf_dir, "parse_results"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_hand_written": p1_hand_written,
    "p2_found": p2_found,
    "p2_strongest_targets": p2_strongest_targets,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_EDGE = """
    SELECT from_id, to_id, max(weight) AS weight, row_number() OVER (PARTITION BY from_id ORDER BY max(weight) DESC, to_id) AS place
    FROM edges WHERE from_id <> 0 AND to_id <> 0 AND from_id <> to_id AND weight IS NOT NULL GROUP BY from_id, to_id"""
_MODULE = """
    SELECT module_id, id, row_number() OVER (PARTITION BY module_id ORDER BY max(candidate_score) DESC, id) AS place
    FROM nodes WHERE module_id IS NOT NULL AND id IS NOT NULL AND candidate_score IS NOT NULL GROUP BY module_id, id"""

SQL = {
    "p2_found": f"""
        SELECT 'edge' AS group_type, from_id AS group_id, to_id AS item_id FROM ({_EDGE}) WHERE place <= 3
        UNION ALL SELECT 'module', module_id, id FROM ({_MODULE}) WHERE place <= 5""",
    "p2_strongest_targets": f"SELECT from_id, to_id, weight, CAST(place AS INTEGER) AS place FROM ({_EDGE}) WHERE place <= 3",
}

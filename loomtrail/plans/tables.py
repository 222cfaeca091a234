"""The driver's tables in the roles of the data model: tool calls, messages, runs, rewards.

``events`` are tool calls of a run (the user), in order of time and id; ``conversations`` are messages;
``documents`` with ``labels`` are runs with an outcome and a flag. Each view has its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"),
        (F.col("event_type") == "error").alias("is_error"), F.col("props").alias("input"), F.col("value").alias("weight"),
    )


CALLS = """calls AS (SELECT user_id AS run_id, ts, event_id AS call_id, event_type AS tool,
  event_type = 'error' AS is_error, props AS input, value AS weight FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("step"), "role", "text")


MESSAGES = "messages AS (SELECT conv_id AS run_id, turn + 1 AS step, role, text FROM conversations)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("run_id"), F.col("source").alias("collection"), F.col("lang").alias("model"), F.col("text").alias("instruction"),
            F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").otherwise("unknown").alias("outcome"),
            (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("flagged"), F.col("n_chars").alias("size"),
        )
    )


RUNS = """runs AS (SELECT d.doc_id AS run_id, d.source AS collection, d.lang AS model, d.text AS instruction,
  CASE WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'fail' ELSE 'unknown' END AS outcome,
  coalesce(toxic, 0) = 1 AS flagged, d.n_chars AS size FROM documents d LEFT JOIN labels l USING (doc_id))"""

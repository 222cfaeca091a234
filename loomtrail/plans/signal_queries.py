"""Queries of flags, changes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import changes, signals, tool_catalog
from .registry import Catalog
from .tables import MESSAGES, messages, table

catalog = Catalog()


@catalog.query()
def run_flags(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("thinking", F.lit(""))
    w = Window.partitionBy("run_id").orderBy("step")
    kind = F.when(F.col("step") % 3 == 0, "Write").when(F.col("step") % 3 == 1, "Bash").otherwise("Read")
    path = F.when(F.col("step") % 2 == 0, "tests/test_a.py").otherwise("src/a.py")
    calls = m.select("run_id", F.row_number().over(w).alias("call_index"), "step", kind.alias("tool"), kind.alias("raw_name"), F.to_json(F.struct(path.alias("file_path"), F.lit("pytest").alias("command"))).alias("input"), F.lit(False).alias("is_error"), F.col("text").alias("result_text"))
    runs = m.select("run_id").distinct().withColumn("outcome", F.lit("fail")).withColumn("role", F.lit("main"))
    return signals.flags(m, calls, runs).select("run_id", F.explode("flags").alias("f")).select("run_id", "f.key", "f.severity", F.size("f.steps").alias("steps"))


@catalog.query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS id, CAST(l_quantity * 100 AS BIGINT) AS s, CAST(l_quantity * 100 + 900 AS BIGINT) AS e FROM lineitem)
SELECT x.k AS order_key, CAST(x.id AS INTEGER) AS left_id, CAST(y.id AS INTEGER) AS right_id FROM a x JOIN a y ON x.k = y.k AND x.s <= y.e AND y.s <= x.e WHERE x.id < y.id""")
def overlapping_edits(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("l_quantity") * 100).cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("int").alias("id"), start.alias("start"), (start + 900).alias("end"))
    return changes.overlapping(rows, rows, ["order_key"], 1000).where("left_id < right_id").select("order_key", "left_id", "right_id")


@catalog.query()
def overlapping_edits_whole(spark: SparkSession, d: str) -> DataFrame:
    """``overlapping_edits``, tested against brute force."""
    start = (F.col("l_quantity") * 100).cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("int").alias("id"), start.alias("start"), (start + 900).alias("end"))
    return changes.overlapping(rows, rows, ["order_key"], 1000).where("left_id < right_id").select("order_key", "left_id", "right_id")


@catalog.query("""WITH c AS (SELECT o_orderkey AS position, o_orderpriority AS sample_id, o_orderstatus = 'F' AS gate_warning, o_custkey % 3 AS n, o_orderkey % 2 = 0 AS recorded FROM orders)
SELECT sample_id, position FROM c ORDER BY CASE WHEN gate_warning THEN 3 WHEN n > 0 THEN 2 WHEN NOT recorded THEN 1 ELSE 0 END DESC, sample_id, position LIMIT 100 OFFSET 50""")
def change_review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("sample_id"), (F.col("o_orderstatus") == "F").alias("gate_warning"), F.array_repeat(F.lit("w"), (F.col("o_custkey") % 3).cast("int")).alias("warnings"), (F.col("o_orderkey") % 2 == 0).alias("recorded"))
    return changes.review_order(rows, 100, 50).select("sample_id", "position")


@catalog.query(f"""WITH {MESSAGES}, s AS (SELECT run_id, step, text, lead(text) OVER (PARTITION BY run_id ORDER BY step) AS nxt FROM messages)
SELECT run_id, step, CASE WHEN nxt IS NULL THEN NULL WHEN nxt = text THEN 'same' ELSE 'other' END AS sync FROM s""")
def segment_summary_sync(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).select(F.col("run_id").alias("group_key"), F.col("step").alias("segment"), F.col("text").alias("opening_summary"), F.col("text").alias("closing_summary"))
    state = F.when(F.col("sync") == "same", "same").when(F.col("sync").isNotNull(), "other")
    return changes.summary_sync(m).select(F.col("group_key").alias("run_id"), F.col("segment").alias("step"), state.alias("sync"))


@catalog.query()
def requirement_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(texts.requirement_candidates(F.col("text"))).alias("candidates"))


@catalog.query("""WITH s AS (SELECT user_id AS run_id, CASE WHEN event_id % 11 = 0 THEN upper(event_type) ELSE event_type END AS name, 1 AS kind, event_id AS place FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT user_id, upper(event_type), 2, event_id FROM events WHERE event_id % 5 = 0 UNION ALL SELECT user_id, event_type || '!', 3, event_id FROM events WHERE event_id % 7 = 0),
f AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS folded FROM s),
k AS (SELECT run_id, folded, count(DISTINCT name) FILTER (WHERE kind = 1) AS called, arg_min(name, (kind, place, name)) AS first FROM f GROUP BY ALL)
SELECT run_id, CASE WHEN called > 1 THEN f.name ELSE first END AS name, count(*) FILTER (WHERE kind = 1) AS call_count, bool_or(kind = 2) AS available_in_session, bool_or(kind = 3) AS declared, string_agg(DISTINCT f.name, ',' ORDER BY f.name) AS raw_names
FROM f JOIN k USING (run_id, folded) GROUP BY 1, 2""")
def tools_by_alias(spark: SparkSession, d: str) -> DataFrame:
    """Event types as tools that are called in two spellings, listed in a third and declared in a fourth."""
    events = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_type", F.col("event_id").alias("place"))
    kind = lambda every, name, k: events.where(F.col("place") % every == 0).select("run_id", name.alias("raw_name"), F.lit("log").alias("source"), F.lit(k).alias("kind"), "place")
    called = F.when(F.col("place") % 11 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    seen = kind(3, called, "call").unionByName(kind(5, F.upper("event_type"), "session")).unionByName(kind(7, F.concat("event_type", F.lit("!")), "declared"))
    return tool_catalog.tool_catalog(seen).select("run_id", "name", "call_count", "available_in_session", "declared", F.array_join("raw_names", ",").alias("raw_names"))

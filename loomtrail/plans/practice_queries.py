"""Queries of what judges and reviewers said, and of episodes as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import episodes, joins, practice
from .registry import Catalog
from .tables import MESSAGES, messages, table

catalog = Catalog()


@catalog.query("""WITH s AS (SELECT doc_id, n_chars % 3 AS version, toxic, quality, length(text) % 4 AS loops FROM documents JOIN labels USING (doc_id)), v AS (SELECT * FROM s WHERE version = 1),
k AS (SELECT 'toxic' AS key FROM v WHERE toxic > 0 UNION ALL SELECT 'loop' FROM v WHERE loops > 0 UNION ALL SELECT 'claims_done_unverified' FROM v WHERE loops = 3 UNION ALL SELECT 'overclaim' FROM v WHERE quality = 0)
SELECT key, count(*) AS runs FROM k GROUP BY key""")
def judge_prevalence(spark: SparkSession, d: str) -> DataFrame:
    loops = F.length("text") % 4
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("run_id"), (F.col("n_chars") % 3).alias("version"), F.create_map(F.lit("toxic"), F.col("toxic").cast("int"), F.lit("loop"), loops.cast("int")).alias("flag_counts"),
        (loops == 3).alias("claims_unverified"), F.when(F.col("quality") == 0, "overclaim").alias("consistency"),
    )
    return practice.judge_prevalence(rows, F.lit(1))


@catalog.query("""WITH k AS (SELECT 'intervention' AS kind, o_orderpriority AS choice FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT 'attribution', CAST(o_custkey % 5 AS VARCHAR) FROM orders)
SELECT kind, choice, count(*) AS count FROM k GROUP BY kind, choice""")
def reviewer_choices(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return practice.choice_counts(orders.select(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).otherwise("").alias("intervention"), (F.col("o_custkey") % 5).alias("attribution")))


@catalog.query("SELECT source AS collection, count(*) AS runs, count(*) FILTER (WHERE quality IS NULL AND n_chars % 3 > 0) AS stale FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return practice.stale_runs(rows.select(F.col("source").alias("collection"), F.col("quality").alias("tool_stats"), (F.col("n_chars") % 3).alias("tool_calls")))


@catalog.query("WITH v AS (SELECT o_custkey AS batch_id, count(*) AS verdicts FROM orders GROUP BY ALL) SELECT c_custkey AS batch_id, coalesce(verdicts, 0) AS verdicts FROM customer LEFT JOIN v ON batch_id = c_custkey")
def verdicts_of_batches(spark: SparkSession, d: str) -> DataFrame:
    return practice.verdict_counts(table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id")), table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id")))


@catalog.query("""WITH r AS (SELECT CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END END AS p, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'unknown' END AS g FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT count(*) FILTER (WHERE p IS NOT NULL AND g <> 'unknown') AS blind, count(*) FILTER (WHERE p = g AND g <> 'unknown') AS correct FROM r) SELECT *, round(correct / nullif(blind, 0), 3) AS accuracy FROM s""")
def blind_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    guess = F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 2 == 0, "pass").otherwise("fail"))
    return practice.blind_accuracy(rows.select(guess.alias("predicted"), F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").otherwise("unknown").alias("grader")))


@catalog.query("""SELECT l_orderkey AS run_id, CAST(l_linenumber AS INTEGER) AS nth, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 5 END, CASE l_linestatus WHEN 'F' THEN 2 ELSE 5 END, l_linenumber) AS INTEGER) AS place FROM lineitem""")
def failures_in_order(spark: SparkSession, d: str) -> DataFrame:
    layer = F.when(F.col("l_returnflag") == "N", "L0").when(F.col("l_returnflag") == "R", "L1").otherwise("other")
    severity = F.when(F.col("l_linestatus") == "F", "high").otherwise("unknown")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("int").alias("nth"), layer.alias("layer"), severity.alias("severity"))
    return practice.failures_in_order(rows).select("run_id", "nth", "place")


@catalog.query(f"""WITH {MESSAGES}, m AS (SELECT run_id AS episode_key, step AS run_id, CASE WHEN step % 3 = 0 THEN 'subagent' WHEN step = 1 THEN 'main' ELSE 'segment' END AS role, CASE WHEN step % 3 = 0 OR step = 1 THEN 0 ELSE step END AS segment FROM messages),
g AS (SELECT episode_key, unnest(list_filter(range(1, max(segment) + 1), lambda x: NOT list_contains(list(CASE WHEN role = 'main' THEN 1 ELSE segment END), x))) AS segment FROM m WHERE role <> 'subagent' GROUP BY episode_key),
x AS (SELECT episode_key, 'thread' AS lane, role AS kind, segment, run_id, CAST(NULL AS BIGINT) AS launched_by, CAST(NULL AS BIGINT) AS launched_at, CASE role WHEN 'main' THEN 0 ELSE 1 END AS rank FROM m WHERE role <> 'subagent'
  UNION ALL SELECT episode_key, 'thread', 'missing', segment, NULL, NULL, NULL, 1 FROM g UNION ALL SELECT episode_key, 'subagent', 'subagent', segment, run_id, run_id - 1, (run_id * 7) % 5, 0 FROM m WHERE role = 'subagent')
SELECT episode_key, lane, kind, segment, run_id, launched_by, launched_at, CAST(row_number() OVER (PARTITION BY episode_key, lane ORDER BY rank, CASE WHEN lane = 'thread' THEN segment END, launched_at, run_id) AS INTEGER) AS place FROM x""")
def episode_tree(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("step").cast("long")
    role = F.when(step % 3 == 0, "subagent").when(step == 1, "main").otherwise("segment")
    # steps are the runs of an episode; their ids are made whole by the episode's
    rows = messages(spark, d).select(F.lit("all").alias("collection"), F.col("run_id").alias("episode_key"), F.concat_ws("/", "run_id", step).alias("run_id"), role.alias("role"), F.when(role == "segment", step).alias("segment"), step.alias("step"))
    launches = rows.where("role = 'subagent'").select("run_id", F.concat_ws("/", "episode_key", F.col("step") - 1).alias("launched_by"), (F.col("step") * 7 % 5).alias("launched_at"))
    tree = episodes.episode_tree(rows, launches)
    number = lambda c: F.element_at(F.split(c, "/"), -1).cast("long").alias(c)
    return tree.select("episode_key", "lane", "kind", "segment", number("run_id"), number("launched_by"), "launched_at", "place")


@catalog.query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Do it: ' || doc_id ELSE 'plain ' || doc_id || ' {' END AS task, CASE WHEN doc_id % 3 = 0 THEN 'Treat this JSON' || chr(10) || 'as told' || chr(10) || 'be ' || lang ELSE '' END AS harness FROM documents""")
def split_tasks(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.to_json(F.struct(F.concat(F.lit("Do it: "), "doc_id").alias("task"), F.concat(F.lit("be "), "lang").alias("rules")))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Treat this JSON "), wrapped, F.lit(" as told"))).otherwise(F.concat(F.lit(" plain "), "doc_id", F.lit(" {")))
    return table(spark, d, "documents").select("doc_id", texts.split_task(said).alias("t")).select("doc_id", "t.task", "t.harness")


@catalog.query("""WITH p AS (SELECT page_id AS run_id, split_part(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/', 1) AS host, split_part(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/', 2) AS lang, 'ns' || page_id % 3 || '/t' || page_id % 7 AS task_id FROM pages),
w AS (SELECT DISTINCT host AS root, 't' || page_number AS task_id, page_number AS imported_at, 'by name' AS label FROM p, range(5) r(page_number) UNION ALL SELECT DISTINCT host || '/' || lang, task_id, 9, 'whole' FROM p WHERE run_id % 2 = 0),
m AS (SELECT run_id, root, label, imported_at, row_number() OVER (PARTITION BY run_id ORDER BY imported_at DESC, label, root) AS nth FROM p JOIN w ON (p.host = w.root OR p.host || '/' || p.lang = w.root) AND (p.task_id = w.task_id OR ends_with(p.task_id, '/' || w.task_id)))
SELECT run_id, root, label, CAST(imported_at AS INTEGER) AS imported_at FROM m WHERE nth = 1""")
def reward_task_match(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    part = lambda n: F.split_part(path, F.lit("/"), F.lit(n))
    task = F.concat(F.lit("ns"), F.col("page_id") % 3, F.lit("/t"), F.col("page_id") % 7)
    rows = table(spark, d, "pages").select(F.col("page_id").alias("run_id"), part(1).alias("host"), F.concat_ws("/", part(1), part(2)).alias("path"), task.alias("task_id"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(4)))
    named = rows.select(F.col("host").alias("root"), numbers.alias("imported_at")).distinct().select("root", F.concat(F.lit("t"), "imported_at").alias("task_id"), "imported_at", F.lit("by name").alias("label"))
    whole = rows.where("run_id % 2 = 0").select(F.col("path").alias("root"), "task_id", F.lit(9).alias("imported_at"), F.lit("whole").alias("label")).distinct()
    return joins.latest_by_prefix(rows, named.unionByName(whole)).select("run_id", "root", "label", "imported_at")

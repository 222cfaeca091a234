"""Queries that sum up collections of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates as a
from .registry import Catalog
from .tables import CALLS, MESSAGES, RUNS, calls, messages, runs, table

catalog = Catalog()


@catalog.query(f"""WITH {CALLS}, r AS (SELECT run_id, tool, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors FROM calls GROUP BY ALL),
t AS (SELECT count(DISTINCT run_id) AS total FROM calls), u AS (SELECT tool, sum(calls) AS calls, sum(errors) AS errors, count(*) AS runs FROM r GROUP BY tool)
SELECT tool, CAST(calls AS BIGINT) AS calls, CAST(errors AS BIGINT) AS errors, runs, CAST(0 AS BIGINT) AS pass_runs, CAST(0 AS BIGINT) AS fail_runs, round(calls / runs, 3) AS calls_per_run, round(errors / calls, 3) AS error_rate, round(runs / total, 3) AS usage_share FROM u, t""")
def tool_usage_profile(spark: SparkSession, d: str) -> DataFrame:
    return a.tool_usage(calls(spark, d))


@catalog.query(f"""WITH {CALLS}, s AS (SELECT *, date_trunc('day', ts) < (SELECT date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) FROM calls) AS early FROM calls),
x AS (SELECT tool, count(*) AS calls, count(DISTINCT run_id) AS runs FROM s WHERE early GROUP BY tool), y AS (SELECT tool, count(*) AS calls, count(DISTINCT run_id) AS runs FROM s WHERE NOT early GROUP BY tool)
SELECT tool, coalesce(x.calls, 0) AS calls_left, coalesce(y.calls, 0) AS calls_right, coalesce(x.runs, 0) AS runs_left, coalesce(y.runs, 0) AS runs_right FROM x FULL JOIN y USING (tool)""")
def tool_usage_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import side_by_side

    rows = calls(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    middle = rows.agg(F.date_trunc("day", F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("middle"))
    marked = rows.join(F.broadcast(middle)).withColumn("early", F.date_trunc("day", "ts") < F.col("middle"))
    usage = lambda part: part.groupBy("tool").agg(F.count("*").alias("calls"), F.countDistinct("run_id").alias("runs"))
    return side_by_side(usage(marked.where("early")), usage(marked.where("NOT early")), ["tool"], ["calls", "runs"])


@catalog.query(f"""WITH {CALLS}, r AS (SELECT run_id, tool, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors FROM calls GROUP BY ALL)
SELECT run_id, string_agg(tool || '=' || calls || '/' || errors, ',' ORDER BY tool) AS stats FROM r GROUP BY run_id""")
def run_tool_stats(spark: SparkSession, d: str) -> DataFrame:
    entries = F.transform(F.map_entries("tool_stats"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["calls"], F.lit("/"), e["value"]["errors"]))
    return a.tool_stats(calls(spark, d)).select("run_id", F.array_join(entries, ",").alias("stats"))


@catalog.query(f"""WITH {RUNS} SELECT collection, count(*) AS runs, count(*) AS episodes, count(*) FILTER (WHERE outcome = 'pass') AS pass, count(*) FILTER (WHERE outcome = 'partial') AS partial,
  count(*) FILTER (WHERE outcome = 'fail') AS fail, count(*) FILTER (WHERE outcome = 'error') AS error, count(*) FILTER (WHERE outcome = 'unknown') AS unknown, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM runs GROUP BY collection""")
def collection_rollup(spark: SparkSession, d: str) -> DataFrame:
    return a.collection_rollup(runs(spark, d))


_FLAGS = "f AS (SELECT *, size > 3000 AS long, instruction LIKE '%!!%' AS shouting FROM runs)"


@catalog.query(f"""WITH {RUNS}, {_FLAGS}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'pass') AS passed, count(*) FILTER (WHERE outcome IN ('fail', 'error')) AS failed FROM f),
e AS (SELECT outcome, 'flagged' AS flag FROM f WHERE flagged UNION ALL SELECT outcome, 'long' FROM f WHERE long UNION ALL SELECT outcome, 'shouting' FROM f WHERE shouting),
g AS (SELECT n.flag, count(e.flag) AS n, count(*) FILTER (WHERE outcome = 'pass') AS p, count(*) FILTER (WHERE outcome IN ('fail', 'error')) AS q FROM (VALUES ('flagged'), ('long'), ('shouting'), ('never')) n(flag) LEFT JOIN e ON e.flag = n.flag GROUP BY n.flag)
SELECT flag, n AS count, round(n / total, 3) AS share, round(p / nullif(passed, 0), 3) AS pass_share, round(q / nullif(failed, 0), 3) AS fail_share FROM g, t""")
def signal_prevalence(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("flagged"), "flagged"), F.when(F.col("size") > 3000, "long"), F.when(F.col("instruction").contains("!!"), "shouting")))
    return a.flag_prevalence(runs(spark, d).withColumn("flags", flags), ["flagged", "long", "shouting", "never"])


_VERDICTS = """v AS (SELECT CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS grader, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unsure' ELSE CASE WHEN toxic = 1 THEN 'fail' WHEN doc_id % 7 = 0 THEN 'partial' ELSE 'pass' END END AS human FROM labels)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    human = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, "unsure").when(F.col("toxic") == 1, "fail").when(F.col("doc_id") % 7 == 0, "partial").otherwise("pass")
    return table(spark, d, "labels").select(F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("grader"), human.alias("human"))


@catalog.query(f"WITH {_VERDICTS} SELECT grader, human, count(*) AS count FROM v WHERE human IS NOT NULL GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return a.confusion(_verdicts(spark, d))


@catalog.query(f"""WITH {_VERDICTS}, s AS (SELECT count(*) FILTER (WHERE human IN ('pass', 'fail', 'partial')) AS comparable, count(*) FILTER (WHERE grader = 'pass' AND human IN ('fail', 'partial')) AS inflated,
  count(*) FILTER (WHERE grader = 'fail' AND human = 'pass') AS deflated, count(*) FILTER (WHERE grader = 'pass' AND human IS NOT NULL) AS judged_passes FROM v)
SELECT *, round((inflated + deflated) / nullif(comparable, 0), 3) AS disagreement, round(inflated / nullif(judged_passes, 0), 3) AS inflated_rate FROM s""")
def grader_agreement(spark: SparkSession, d: str) -> DataFrame:
    return a.agreement(_verdicts(spark, d))


@catalog.query("""WITH r AS (SELECT unnest([lang, source]) AS label, n_chars > 2000 AS decisive, n_chars > 5000 AS severe FROM documents)
SELECT label, count(*) AS count, count(*) FILTER (WHERE decisive) AS decisive, count(*) FILTER (WHERE severe) AS severe FROM r GROUP BY label""")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "documents").select(F.array("lang", "source").alias("labels"), (F.col("n_chars") > 2000).alias("decisive"), (F.col("n_chars") > 5000).alias("severe"))
    return a.label_counts(reviews)


@catalog.query(f"""WITH {MESSAGES}, t AS (SELECT run_id, count(*) AS steps, min(step) FILTER (WHERE length(text) > 200) AS turning_step FROM messages GROUP BY run_id)
SELECT CAST(least(9, floor(least(1.0, turning_step / steps) * 10)) AS INTEGER) AS bin, count(*) AS count FROM t WHERE turning_step IS NOT NULL GROUP BY 1""")
def turning_histogram(spark: SparkSession, d: str) -> DataFrame:
    turns = messages(spark, d).groupBy("run_id").agg(F.count("*").alias("steps"), F.min(F.when(F.length("text") > 200, F.col("step"))).alias("turning_step"))
    return a.turning_histogram(turns)


@catalog.query("""WITH l AS (SELECT CAST(max(ts) AS DATE) AS last FROM events), c AS (SELECT CAST(unnest(generate_series(CAST(last - INTERVAL 13 DAY AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM l)
SELECT CAST(c.day AS VARCHAR) AS day, count(e.event_id) AS count FROM c LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') e ON CAST(e.ts AS DATE) = c.day GROUP BY c.day""")
def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d)
    last = rows.agg(F.to_date(F.max("ts")).alias("day"))
    rare = rows.where("tool = 'signup'").select("ts")
    days = a.daily_activity(rare.join(F.broadcast(last)), "ts", F.max("day"))
    return days.select(F.col("day").cast("string").alias("day"), "count")


_REWARDS = """w AS (SELECT o_orderkey AS deck, o_orderstatus AS label, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round(least(1.0, o_totalprice / 400000), 6) END AS r, CAST(o_orderkey % 5 AS INTEGER) AS tier, n_name AS collection, o_orderpriority AS task
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    r = F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).otherwise(F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 400000), 6))
    return joined.select(F.col("o_orderkey").alias("deck"), F.col("o_orderstatus").alias("label"), r.alias("r"), (F.col("o_orderkey") % 5).cast("int").alias("tier"), F.col("n_name").alias("collection"), F.col("o_orderpriority").alias("task"))


@catalog.query(f"""WITH {_REWARDS} SELECT label, count(r) AS scored, count(*) - count(r) AS masked, round(avg(r), 4) AS r_mean, round(median(r), 4) AS r_median,
  {", ".join(f"count(*) FILTER (WHERE tier = {t} AND r IS NOT NULL) AS tier{t}" for t in range(5))} FROM w GROUP BY label""")
def reward_stats(spark: SparkSession, d: str) -> DataFrame:
    return a.reward_stats(_rewards(spark, d), ["label"])


@catalog.query(f"WITH {_REWARDS} SELECT CAST(least(9, floor(r * 10)) AS INTEGER) AS bin, count(*) AS count FROM w WHERE r IS NOT NULL GROUP BY 1")
def reward_histogram(spark: SparkSession, d: str) -> DataFrame:
    return a.reward_histogram(_rewards(spark, d))


@catalog.query(f"""WITH {_REWARDS}, k AS (SELECT l_orderkey AS deck, l_returnflag || l_linestatus AS "check", count(*) AS slides FROM lineitem GROUP BY ALL), t AS (SELECT count(*) AS n, sum(r) AS s FROM w WHERE r IS NOT NULL),
g AS (SELECT "check", count(*) AS decks, CAST(sum(slides) AS BIGINT) AS slides, sum(r) AS sw FROM k JOIN w USING (deck) WHERE r IS NOT NULL GROUP BY "check")
SELECT "check", decks, slides, round(sw / decks, 4) AS r_with, round((s - sw) / nullif(n - decks, 0), 4) AS r_without, n - decks AS n_without, round(decks / n, 3) AS share FROM g, t""")
def failed_check_effect(spark: SparkSession, d: str) -> DataFrame:
    checks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("deck"), F.concat("l_returnflag", "l_linestatus").alias("check"), F.lit(1).cast("long").alias("slides"))
    return a.failed_check_effect(_rewards(spark, d), checks)


@catalog.query("""SELECT source, count(*) AS n, list_sort(list(n_chars))[1 + CAST(floor(0.5 * (count(*) - 1)) AS BIGINT)] AS p50, list_sort(list(n_chars))[1 + CAST(floor(0.9 * (count(*) - 1)) AS BIGINT)] AS p90, max(n_chars) AS p100 FROM documents GROUP BY source""")
def floor_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return a.floor_quantiles(table(spark, d, "documents"), ["source"], "n_chars")


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    homes = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", F.col("r_name").alias("region"))
    return _rewards(spark, d).join(homes, F.col("collection") == F.col("n_name")).select("task", "region", "r", "collection")


@catalog.query(f"""WITH {_REWARDS}, t AS (SELECT task, r_name AS region, r FROM w JOIN nation ON n_name = collection JOIN region ON n_regionkey = r_regionkey)
SELECT task, {", ".join(f'round(max(r) FILTER (WHERE region = $${x}$$), 4) AS "{x}"' for x in _REGIONS)} FROM t GROUP BY task""")
def task_collection_matrix(spark: SparkSession, d: str) -> DataFrame:
    return a.task_matrix(_attempts(spark, d), "task", "region", columns=_REGIONS)


@catalog.query(f"""WITH {_REWARDS}, b AS (SELECT task, collection, max(r) AS best, count(*) AS attempts FROM w GROUP BY ALL)
SELECT task, count(best) AS scored, CAST(sum(attempts) AS BIGINT) AS attempts, round(max(best) - min(best), 4) AS spread FROM b GROUP BY task HAVING count(best) >= 2""")
def matrix_spread(spark: SparkSession, d: str) -> DataFrame:
    return a.matrix_spread(_rewards(spark, d), "task", "collection")


_TOKENS = "CAST(round_even((length(text) - (strlen(text) - length(text)) / 2) / 4 + ((strlen(text) - length(text)) / 2) / 1.5, 0) AS BIGINT)"


@catalog.query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.estimate_tokens(F.col("text")).alias("tokens"))


@catalog.query(f"""WITH {MESSAGES}, t AS (SELECT run_id, CAST(coalesce(sum({_TOKENS}) FILTER (WHERE role IN ('assistant', 'tool')), 0) AS BIGINT) AS trained_tokens, CAST(coalesce(sum({_TOKENS}) FILTER (WHERE role NOT IN ('assistant', 'tool')), 0) AS BIGINT) AS context_tokens FROM messages GROUP BY run_id)
SELECT *, coalesce(round(trained_tokens / nullif(trained_tokens + context_tokens, 0), 3), 0) AS trained_share FROM t""")
def trained_context_tokens(spark: SparkSession, d: str) -> DataFrame:
    return a.trained_tokens(messages(spark, d), scalars.estimate_tokens(F.col("text")))


@catalog.query(f"""WITH {MESSAGES}, t AS (SELECT run_id, arg_max(role, step) AS role, max(step) AS step FROM messages WHERE role NOT IN ('system', 'result') GROUP BY run_id), a AS (SELECT DISTINCT run_id FROM messages)
SELECT run_id, step, role FROM a LEFT JOIN t USING (run_id) WHERE role IS NULL OR role NOT IN ('assistant', 'tool')""")
def truncated_endings(spark: SparkSession, d: str) -> DataFrame:
    return a.truncated_endings(messages(spark, d))


@catalog.query(f"""WITH {RUNS} SELECT 'all' AS facet, NULL AS value, count(*) AS count FROM runs UNION ALL SELECT 'collection', collection, count(*) FROM runs GROUP BY collection
UNION ALL SELECT 'model', model, count(*) FROM runs GROUP BY model UNION ALL SELECT 'outcome', outcome, count(*) FROM runs GROUP BY outcome""")
def data_card(spark: SparkSession, d: str) -> DataFrame:
    return a.data_card(runs(spark, d), ["collection", "model", "outcome"])


@catalog.query("""WITH p AS (SELECT page_id AS run_id, CASE page_id % 6 WHEN 0 THEN 'error: <url>' WHEN 1 THEN 'ValueError: bad value <n>' WHEN 2 THEN 'cannot open <path>' WHEN 3 THEN 'connection refused by <str> at <hex>' WHEN 4 THEN 'denied: <file>' ELSE '(empty error output)' END AS template,
  CASE page_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'error' END AS outcome FROM pages)
SELECT 'fetch' AS tool, template, count(*) AS occurrences, count(*) AS runs, count(*) FILTER (WHERE outcome = 'pass') AS pass_runs, count(*) FILTER (WHERE outcome <> 'pass') AS fail_runs, array_to_string(list(run_id ORDER BY run_id)[1:5], ',') AS examples FROM p GROUP BY template""")
def error_templates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    kinds = (
        F.concat(F.lit("error: "), F.split_part("url", F.lit(" "), F.lit(1))),
        F.concat(F.lit('Traceback (most recent call last):\n  File "x.py", line 3\nValueError: bad value '), n),
        F.concat(F.lit("reading\nProcess exited with code 2\ncannot open /data/run"), n, F.lit("/part.bin\nbye")),
        F.concat(F.lit('{"content": [{"type": "text", "text": "connection refused by \'host'), n, F.lit("' at 0x1f"), n, F.lit('"}]}')),
        F.concat(F.lit("Exit code: 1\nWall time: 2 s\ndenied: part-"), n, F.lit(".json")),
        F.lit("Exit code 1\nOutput:\n"),
    )
    text = F.coalesce(*[F.when(n % 6 == i, kind) for i, kind in enumerate(kinds)])
    outcome = F.when(n % 3 == 0, "pass").when(n % 3 == 1, "fail").otherwise("error")
    failures = table(spark, d, "pages").select(n.alias("run_id"), F.lit("fetch").alias("tool"), scalars.error_template(text).alias("template"), outcome.alias("outcome"), F.lit(1).alias("step"))
    return a.error_template_usage(failures).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@catalog.query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE 'h:' || substr(sha1(substr(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 1500)), 1, 16) END AS task_key FROM documents""")
def task_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.task_key(F.lit(None).cast("string"), F.col("text")).alias("task_key"))


@catalog.query("""SELECT o_orderkey, CASE WHEN o_totalprice / 200000 >= 1 THEN 'pass' WHEN o_totalprice / 200000 <= 0 THEN 'fail' ELSE 'partial' END AS status FROM orders""")
def score_statuses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", scalars.score_status(F.col("o_totalprice") / 200000).alias("status"))


@catalog.query("""WITH r AS (SELECT o_orderstatus AS label, o_orderkey % 9 = 0 AS masked, o_custkey AS imported_at, '/runs/' || CASE WHEN o_orderstatus = 'P' THEN 'only' ELSE o_orderpriority END AS root FROM orders)
SELECT label, count(*) AS decks, count(*) FILTER (WHERE masked) AS masked, max(imported_at) AS imported_at, CASE WHEN count(DISTINCT root) = 1 THEN min(root) ELSE regexp_replace(min(root), '/[^/]*$', '') END AS root FROM r GROUP BY label""")
def reward_labels(spark: SparkSession, d: str) -> DataFrame:
    root = F.concat(F.lit("/runs/"), F.when(F.col("o_orderstatus") == "P", "only").otherwise(F.col("o_orderpriority")))
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("label"), (F.col("o_orderkey") % 9 == 0).alias("masked"), F.col("o_custkey").alias("imported_at"), root.alias("root"))
    return a.reward_labels(rows)


@catalog.query(f"""WITH {CALLS}, t AS (SELECT run_id, tool, bool_or(weight > 90) AS c, bool_or(is_error) AS m FROM calls GROUP BY ALL)
SELECT 'tool' AS kind, tool AS name, count(*) AS present, count(*) FILTER (WHERE c) AS called, count(*) FILTER (WHERE m) AS named, count(*) FILTER (WHERE c OR m) AS any_use FROM t GROUP BY tool""")
def component_usage(spark: SparkSession, d: str) -> DataFrame:
    some = lambda when: F.when(when, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return a.component_usage(calls(spark, d).select("run_id", F.lit("tool").alias("kind"), F.col("tool").alias("name"), some(F.col("weight") > 90).alias("calls"), some(F.col("is_error")).alias("mentions")))


@catalog.query(f"""WITH {CALLS}, c AS (SELECT run_id, tool AS phase, count(*) AS steps FROM calls WHERE tool <> 'click' GROUP BY ALL)
SELECT run_id, phase, steps, round(steps / sum(steps) OVER (PARTITION BY run_id), 3) AS share FROM c""")
def phase_shares(spark: SparkSession, d: str) -> DataFrame:
    return a.phase_shares(calls(spark, d).select("run_id", F.when(F.col("tool") != "click", F.col("tool")).alias("phase")))

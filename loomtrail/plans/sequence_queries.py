"""Queries over ordered calls and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequences as s
from .registry import Catalog
from .tables import CALLS, MESSAGES, calls, messages, table

catalog = Catalog()
_W = "OVER (PARTITION BY run_id ORDER BY ts, call_id)"
_WT = "OVER (PARTITION BY run_id, tool ORDER BY ts, call_id"
_NUMBERED = f"n AS (SELECT *, row_number() {_W} AS call_index FROM calls)"


@catalog.query(f"""WITH {CALLS}, c AS (SELECT *, row_number() {_W} AS i,
  CASE WHEN lag(tool) {_W} IS NOT DISTINCT FROM tool AND lag(input) {_W} IS NOT DISTINCT FROM input AND lag(call_id) {_W} IS NOT NULL THEN 0 ELSE 1 END AS changed FROM calls),
k AS (SELECT *, sum(changed) OVER (PARTITION BY run_id ORDER BY i) AS island FROM c),
g AS (SELECT run_id, island, count(*) AS streak, min(i) AS first_index, min(tool) AS tool FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY streak DESC, first_index) AS nth FROM g)
SELECT run_id, streak, CAST(first_index AS INTEGER) AS first_index, tool FROM r WHERE nth = 1""")
def longest_identical_streak(spark: SparkSession, d: str) -> DataFrame:
    return s.longest_identical_streak(calls(spark, d))


@catalog.query(f"""WITH {CALLS}, c AS (SELECT *, lead(call_id) {_WT}) AS retry_id, lead(input) {_WT}) AS retry_input FROM calls)
SELECT run_id, call_id, retry_id FROM c WHERE is_error AND retry_id IS NOT NULL AND retry_input IS NOT DISTINCT FROM input""")
def blind_retries(spark: SparkSession, d: str) -> DataFrame:
    return s.blind_retries(calls(spark, d))


_FLAKY = "c AS (SELECT run_id, ts, call_id, CASE WHEN tool IN ('click', 'view') THEN 'browse' ELSE 'act' END AS tool, is_error OR weight < 10 AS is_error FROM calls)"


def _flaky(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("tool").isin("click", "view"), "browse").otherwise("act")
    return calls(spark, d).withColumn("is_error", F.col("is_error") | (F.col("weight") < 10)).withColumn("tool", kind)


@catalog.query(f"""WITH {CALLS}, {_FLAKY}
SELECT a.run_id, a.call_id, any_value(a.tool) AS tool, arg_min(b.call_id, (b.ts, b.call_id)) FILTER (WHERE NOT b.is_error) AS recovered_by, count(b.call_id) AS attempts_later
FROM c a LEFT JOIN c b ON a.run_id = b.run_id AND a.tool = b.tool AND (b.ts, b.call_id) > (a.ts, a.call_id) WHERE a.is_error GROUP BY a.run_id, a.call_id""")
def error_recovery(spark: SparkSession, d: str) -> DataFrame:
    return s.error_recovery(_flaky(spark, d))


@catalog.query(f"""WITH {CALLS}, {_FLAKY}, e AS (SELECT a.run_id, a.call_id, bool_or(coalesce(NOT b.is_error, false)) AS good
FROM c a LEFT JOIN c b ON a.run_id = b.run_id AND a.tool = b.tool AND (b.ts, b.call_id) > (a.ts, a.call_id) WHERE a.is_error GROUP BY a.run_id, a.call_id)
SELECT run_id, count(*) AS errors, round(avg(CAST(good AS DOUBLE)), 3) AS recovery_rate FROM e GROUP BY run_id""")
def recovery_rates(spark: SparkSession, d: str) -> DataFrame:
    return s.recovery_rates(_flaky(spark, d))


@catalog.query(f"""WITH {CALLS}, c AS (SELECT *, lag(call_id) OVER (PARTITION BY run_id, tool, input ORDER BY ts, call_id) AS repeat_of FROM calls)
SELECT run_id, call_id, repeat_of FROM c WHERE repeat_of IS NOT NULL""")
def repeat_of_earlier_call(spark: SparkSession, d: str) -> DataFrame:
    return s.repeat_of(calls(spark, d))


@catalog.query(f"""WITH {CALLS}, i AS (SELECT *, CAST(floor(weight) AS BIGINT) AS t, CASE WHEN tool = 'purchase' THEN CAST(floor(weight * 2) AS BIGINT) END AS m,
  sum(CASE WHEN tool = 'signup' THEN 1 ELSE 0 END) {_W} AS island FROM calls),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY run_id, island ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running FROM i),
o AS (SELECT *, m - running AS off FROM r)
SELECT run_id, call_id, CAST(greatest(0, running + coalesce(last_value(off IGNORE NULLS) OVER (PARTITION BY run_id, island ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS BIGINT) AS estimate FROM o""")
def context_running_total(spark: SparkSession, d: str) -> DataFrame:
    measured = F.when(F.col("tool") == "purchase", F.floor(F.col("weight") * 2))
    tracked = s.context_track(calls(spark, d), F.floor("weight"), F.col("tool") == "signup", measured, s.ORDER)
    return tracked.select("run_id", "call_id", F.col("estimate").cast("long").alias("estimate"))


@catalog.query(f"""WITH {CALLS}, c AS (SELECT run_id, call_id, epoch_us(lead(ts) {_W}) / 1e6 - epoch_us(ts) / 1e6 AS seconds FROM calls)
SELECT run_id, call_id, round(seconds, 3) AS seconds, CASE WHEN seconds < 10 THEN 0 WHEN seconds < 60 THEN 1 WHEN seconds < 300 THEN 2 WHEN seconds IS NOT NULL THEN 3 END AS heat FROM c""")
def time_to_next_step(spark: SparkSession, d: str) -> DataFrame:
    return s.time_to_next(calls(spark, d)).select("run_id", "call_id", F.round("seconds", 3).alias("seconds"), "heat")


@catalog.query(f"""WITH {CALLS}, c AS (SELECT run_id, (epoch_us(ts) - lag(epoch_us(ts)) {_W}) / 1e6 AS gap FROM calls)
SELECT run_id, max(gap) AS longest_gap FROM c GROUP BY run_id""")
def longest_gap(spark: SparkSession, d: str) -> DataFrame:
    return s.longest_gap(calls(spark, d))


@catalog.query(f"""WITH {CALLS}, {_NUMBERED}, l AS (SELECT run_id, max(call_index) AS last_change FROM n WHERE tool = 'purchase' GROUP BY run_id)
SELECT l.run_id, CAST(last_change AS INTEGER) AS last_change, CAST(min(call_index) FILTER (WHERE tool = 'view' AND call_index > last_change) AS INTEGER) AS verified_at
FROM l JOIN n USING (run_id) GROUP BY l.run_id, last_change""")
def verification_after_last_change(spark: SparkSession, d: str) -> DataFrame:
    return s.verification_after_last_change(calls(spark, d), F.col("tool") == "purchase", F.col("tool") == "view")


@catalog.query(f"""WITH {CALLS}, k AS (SELECT run_id, ts, call_id, CASE WHEN tool = 'purchase' THEN 'change' ELSE 'look' END AS k FROM calls WHERE tool IN ('purchase', 'view')),
p AS (SELECT *, lag(k) {_W} AS p1, lag(k, 2) {_W} AS p2 FROM k)
SELECT run_id, count(*) FILTER (WHERE k = 'change') AS changes, count(*) FILTER (WHERE k = 'look') AS looks, count(*) FILTER (WHERE k = 'look' AND p1 = 'change') AS checked_changes,
  count(*) FILTER (WHERE k = 'change' AND p1 = 'look' AND p2 = 'change') AS cycles FROM p GROUP BY run_id""")
def change_look_cycles(spark: SparkSession, d: str) -> DataFrame:
    return s.change_look_cycles(calls(spark, d), F.col("tool") == "purchase", F.col("tool") == "view")


@catalog.query(f"""WITH {CALLS}, c AS (SELECT *, last_value(CASE WHEN tool = 'purchase' THEN 'implement' WHEN tool = 'view' THEN 'verify' END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM calls)
SELECT run_id, call_id FROM c WHERE tool = 'signup' AND last = 'implement'""")
def unverified_claims(spark: SparkSession, d: str) -> DataFrame:
    return s.unverified_claims(calls(spark, d), F.col("tool") == "signup", F.col("tool") == "purchase", F.col("tool") == "view")


@catalog.query(f"""WITH {CALLS}, {_NUMBERED}, o AS (SELECT run_id, coalesce(max(call_index) FILTER (WHERE tool NOT IN ('view', 'click')), 0) AS last_other, count(*) AS calls FROM n GROUP BY run_id),
f AS (SELECT run_id, calls, min(call_index) AS tail_from FROM n JOIN o USING (run_id) WHERE call_index > last_other AND tool = 'view' GROUP BY ALL),
t AS (SELECT run_id, calls, tail_from, count(*) FILTER (WHERE call_index >= tail_from AND tool = 'view') AS polish_calls, max(epoch_us(ts)) FILTER (WHERE call_index = tail_from) AS b, arg_max(epoch_us(ts), call_index) AS e, arg_min(epoch_us(ts), call_index) AS s FROM n JOIN f USING (run_id) GROUP BY ALL)
SELECT run_id, CAST(tail_from AS INTEGER) AS tail_from, CAST(nullif(tail_from - 1, 0) AS INTEGER) AS milestone, calls - tail_from + 1 AS tail_calls, round((calls - tail_from + 1) / calls, 3) AS tail_share, polish_calls,
  CAST(floor((e - b) / 1000) AS BIGINT) AS tail_ms, CASE WHEN e > s THEN round((e - b) / (e - s), 3) END AS time_share FROM t""")
def closing_tail(spark: SparkSession, d: str) -> DataFrame:
    return s.closing_tail(calls(spark, d), F.col("tool") == "click", F.col("tool") == "view")


@catalog.query(f"""WITH {CALLS}, {_NUMBERED}, a AS (SELECT run_id // 2 AS pair_id, call_index, tool FROM n WHERE run_id % 2 = 0), b AS (SELECT run_id // 2 AS pair_id, call_index, tool FROM n WHERE run_id % 2 = 1)
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, CAST(min(coalesce(a.call_index, b.call_index)) FILTER (WHERE a.tool IS DISTINCT FROM b.tool) AS INTEGER) AS diverges_at, count(*) FILTER (WHERE a.tool = b.tool) AS same
FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.call_index = b.call_index GROUP BY 1""")
def first_divergence(spark: SparkSession, d: str) -> DataFrame:
    paired = calls(spark, d).withColumn("pair_id", F.floor(F.col("run_id") / 2)).withColumn("signature", F.col("tool"))
    return s.first_divergence(paired.where("run_id % 2 = 0"), paired.where("run_id % 2 = 1"))


@catalog.query(f"""WITH {CALLS}, p AS (SELECT run_id, call_id, max(CASE WHEN tool = 'purchase' THEN call_id END) OVER (PARTITION BY run_id ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reacts_to FROM calls)
SELECT run_id, call_id AS step, reacts_to FROM p""")
def previous_tool_step(spark: SparkSession, d: str) -> DataFrame:
    steps = calls(spark, d).withColumn("step", F.col("call_id"))
    return s.previous_tool_step(steps, F.col("tool") == "purchase").select("run_id", "step", "reacts_to")


@catalog.query(f"""WITH {CALLS}, c AS (SELECT run_id, tool, call_id AS step, is_error, CASE WHEN weight >= 50 THEN 'completed' ELSE 'pending' END AS status FROM calls),
w AS (SELECT *, lag(status) OVER (PARTITION BY run_id, tool ORDER BY step) AS b, min(CASE WHEN status = 'completed' THEN step END) OVER (PARTITION BY run_id, tool) AS done FROM c),
k AS (SELECT * FROM w WHERE b IS DISTINCT FROM status)
SELECT run_id, tool, step, status, done AS completed_step FROM k""")
def plan_status_changes(spark: SparkSession, d: str) -> DataFrame:
    items = calls(spark, d).select("run_id", "tool", F.col("call_id").alias("step"), F.when(F.col("weight") >= 50, "completed").otherwise("pending").alias("status"))
    return s.status_changes(items, "tool")


@catalog.query(f"""WITH {CALLS}, c AS (SELECT run_id, date_trunc('day', ts) AS step, list_sort(list(DISTINCT tool)) AS items FROM calls GROUP BY ALL),
w AS (SELECT *, lag(items) OVER (PARTITION BY run_id ORDER BY step) AS b FROM c)
SELECT run_id, CAST(step AS TIMESTAMP) AS step, item, 'removed' AS status FROM (SELECT run_id, step, items, unnest(b) AS item FROM w) WHERE NOT list_contains(items, item)""")
def plan_removed_items(spark: SparkSession, d: str) -> DataFrame:
    lists = calls(spark, d).groupBy("run_id", F.date_trunc("day", "ts").alias("step")).agg(F.array_sort(F.collect_set("tool")).alias("items"))
    return s.removed_items(lists)


@catalog.query(r"""WITH p AS (SELECT source AS run_id, doc_id AS step, unnest(regexp_split_to_array(text, '\n\s*\n|\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\n\s*\n|\n'), 1) - 1 AS nth FROM documents),
f AS (SELECT run_id, step, nth, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS paragraph FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, paragraph ORDER BY step, nth) AS occurrence FROM f WHERE length(paragraph) >= 60)
SELECT run_id, step, CAST(nth AS INTEGER) AS nth, paragraph, CAST(occurrence AS INTEGER) AS occurrence FROM r WHERE occurrence > 1""")
def duplicate_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("step"), F.regexp_replace("text", r"\n\s*\n|\n", "\n\n").alias("text"))
    return s.duplicate_paragraphs(docs)


@catalog.query(r"""WITH v AS (SELECT source AS run_id, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) / 2.5 AS cjk, len(regexp_extract_all(text, '[A-Za-z]{2,}')) AS latin
  FROM (SELECT source, regexp_replace(text, '(?s)```.*?```|`[^`]*`|https?://\S+|(?:/[\w.-]+){2,}', ' ', 'g') AS text FROM documents)),
c AS (SELECT run_id, count(*) FILTER (WHERE cjk >= latin) AS cjk_steps, count(*) FILTER (WHERE cjk < latin) AS latin_steps FROM v WHERE cjk + latin >= 10 GROUP BY run_id)
SELECT *, round(least(cjk_steps, latin_steps) / (cjk_steps + latin_steps), 3) AS mix_share,
  least(cjk_steps, latin_steps) >= 2 AND least(cjk_steps, latin_steps) / (cjk_steps + latin_steps) >= 0.15 AS mixed FROM c""")
def language_mix(spark: SparkSession, d: str) -> DataFrame:
    return s.language_mix(table(spark, d, "documents").select(F.col("source").alias("run_id"), "text"))

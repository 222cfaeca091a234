"""Queries of rewriting, replay, judging, exports and event sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import diffs, scalars
from ..operators import components, judge, ownership, replay, rewrites, summaries
from ..operators import delegations as handed
from ..operators.lineage import fresh_folder
from ..sources import sinks
from ..streaming import imports
from .registry import Catalog
from .tables import MESSAGES, calls, messages, table

catalog = Catalog()


@catalog.query()
def word_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).withColumn("before", F.lag("text").over(Window.partitionBy("run_id").orderBy("step"))).where("before IS NOT NULL")
    parts = rows.withColumn("parts", diffs.word_diff_of("before", "text"))
    return parts.select("run_id", "step", F.size("parts").alias("parts"), F.size(F.filter("parts", lambda p: p["op"] == "same")).alias("same"))


@catalog.query()
def line_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).withColumn("before", F.lag("text").over(Window.partitionBy("run_id").orderBy("step"))).where("before IS NOT NULL")
    return rows.withColumn("delta", diffs.line_delta("before", "text")).select("run_id", "step", "delta.added", "delta.removed")


def rewritten_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns with two runs of words replaced, in every third conversation with more than the records tell, and the records."""
    words = F.split("text", " ")
    rows = messages(spark, d).select(F.col("run_id").alias("sample_id"), F.col("step").alias("row"), "step", F.lit("text").alias("field"), F.col("text").alias("old"), words.alias("w")).where(F.size("w") > 8)
    some = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    more = F.when(F.col("sample_id") % 3 == 0, " and more").otherwise("")
    new = F.concat(some(1, 1), F.lit(" rewritten "), some(4, 2), F.lit(" also "), F.array_join(F.slice("w", F.lit(8), F.size("w")), " "), more)
    edit = lambda n, begin, gap, said: F.struct(F.lit(n).alias("n"), F.concat_ws(":", "step", F.lit(n)).alias("edit"), F.array_join(F.slice("w", begin, 2), gap).alias("old"), F.lit(said).alias("new"))
    records = rows.select("sample_id", "step", "field", F.inline(F.array(edit(1, 2, " ", "rewritten"), edit(2, 6, "  ", "also"))))
    return rows.withColumn("new", new).drop("w"), records


@catalog.query()
def owned_changes(spark: SparkSession, d: str) -> DataFrame:
    fields, records = rewritten_texts(spark, d)
    changes = ownership.owned_changes(fields, records)
    return changes.select("sample_id", "step", "id", "removed", "added", F.array_join("owners", "+").alias("owners"))


@catalog.query()
def unplaced_edits(spark: SparkSession, d: str) -> DataFrame:
    fields, records = rewritten_texts(spark, d)
    return ownership.unplaced_edits(records, ownership.owned_changes(fields, records)).select("sample_id", "step", "edit", "old", "new")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = messages(spark, d).withColumn("sample_id", F.col("run_id"))
    ids = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("c"), "step"))).otherwise(F.array().cast("array<string>"))
    original = rows.select("sample_id", "step", "text", ids.alias("call_ids"))
    return original, original.where("step <> 2").withColumn("step", F.when(F.col("step") > 2, F.col("step") - 1).otherwise(F.col("step")))


@catalog.query(f"""WITH {MESSAGES} SELECT run_id AS sample_id, step AS old_step, CASE WHEN step = 2 THEN NULL WHEN step > 2 THEN step - 1 ELSE step END AS new_step,
  CASE WHEN step = 2 THEN 'removed' WHEN role = 'assistant' THEN 'call' ELSE 'content' END AS how FROM messages""")
def step_alignment(spark: SparkSession, d: str) -> DataFrame:
    return rewrites.align_steps(*_sides(spark, d))


@catalog.query("""WITH a AS (SELECT user_id AS sample_id, event_id AS call_id, event_type AS tool, props AS input FROM events WHERE event_id % 5 <> 0),
b AS (SELECT user_id AS sample_id, event_id AS call_id, event_type AS tool, CASE WHEN event_id % 3 = 0 THEN props || ' ' ELSE props END AS input FROM events WHERE event_id % 7 <> 0)
SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, CASE WHEN b.call_id IS NULL THEN 'removed' WHEN a.call_id IS NULL THEN 'added' WHEN a.tool IS NOT DISTINCT FROM b.tool AND a.input IS NOT DISTINCT FROM b.input THEN 'same' ELSE 'changed' END AS change, count(*) AS n
FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.call_id = b.call_id GROUP BY ALL""")
def tool_call_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d).select(F.col("run_id").alias("sample_id"), "call_id", "tool", "input")
    after = rows.where("call_id % 7 <> 0").withColumn("input", F.when(F.col("call_id") % 3 == 0, F.concat("input", F.lit(" "))).otherwise(F.col("input")))
    return rewrites.tool_changes(rows.where("call_id % 5 <> 0"), after).groupBy("sample_id", "change").agg(F.count("*").alias("n"))


@catalog.query("""WITH a AS (SELECT DISTINCT doc_id % 50 AS sample_id, source AS name, lang AS digest FROM documents WHERE doc_id % 4 < 3), k AS (SELECT sample_id, name, min(digest) AS digest FROM a GROUP BY ALL),
b AS (SELECT doc_id % 50 AS sample_id, source AS name, min(lang) AS digest FROM documents WHERE doc_id % 4 > 0 GROUP BY ALL)
SELECT coalesce(k.sample_id, b.sample_id) AS sample_id, coalesce(k.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' WHEN k.name IS NULL THEN 'added' WHEN k.digest IS NOT DISTINCT FROM b.digest THEN 'kept' ELSE 'redefined' END AS change
FROM k FULL JOIN b ON k.sample_id = b.sample_id AND k.name = b.name""")
def component_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("sample_id"), F.lit("tool").alias("kind"), F.col("source").alias("name"), F.col("lang").alias("digest"), (F.col("doc_id") % 4).alias("part"))
    side = lambda rows: rows.groupBy("sample_id", "kind", "name").agg(F.min("digest").alias("digest"))
    return rewrites.component_changes(side(docs.where("part < 3")), side(docs.where("part > 0"))).drop("kind")


@catalog.query("""WITH g AS (SELECT doc_id, quality IS NOT NULL AS compared, CASE WHEN doc_id % 23 = 0 THEN 'failed' END AS status, doc_id % 5 % 2 AS errors, doc_id % 11 // 9 AS misses, doc_id % 7 // 6 AS confirmed, toxic AS unanswered,
  doc_id % 4 = 0 AS out_of_sync, doc_id % 3 AS flagged, CASE WHEN doc_id % 17 = 0 THEN 'include' WHEN doc_id % 19 = 0 THEN 'exclude' WHEN doc_id % 13 = 0 THEN 'later' END AS told FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, coalesce(told IN ('include', 'exclude'), false) AS decided, list_filter([CASE WHEN NOT compared THEN 'not compared' END, CASE WHEN status IS NOT NULL THEN 'pipeline status' END, CASE WHEN errors > 0 THEN 'changes judged wrong ' || errors END,
  CASE WHEN misses > 0 THEN 'changes missed ' || misses END, CASE WHEN confirmed > 0 THEN 'residue confirmed ' || confirmed END], lambda x: x IS NOT NULL) AS out,
  list_filter([CASE WHEN unanswered > 0 THEN 'residue without an answer ' || unanswered END, CASE WHEN out_of_sync THEN 'summary out of sync' END, CASE WHEN flagged > 0 THEN 'flagged changes without a verdict ' || flagged END], lambda x: x IS NOT NULL) AS ask FROM g)
SELECT doc_id, CASE WHEN decided THEN told WHEN len(out) > 0 THEN 'exclude' WHEN len(ask) > 0 THEN 'review' ELSE 'include' END AS decision, array_to_string(list_concat(CASE WHEN decided THEN ['decided'] ELSE [] END, out, ask), ', ') AS reasons FROM r""")
def rewrite_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    told = F.when(k % 17 == 0, "include").when(k % 19 == 0, "exclude").when(k % 13 == 0, "later")
    decided = rewrites.gate(F.col("quality").isNotNull(), F.when(k % 23 == 0, "failed"), k % 5 % 2, F.floor(k % 11 / 9), F.floor(k % 7 / 6), F.col("toxic"), k % 4 == 0, k % 3, told)
    reasons = F.transform("g.reasons", lambda r: F.concat_ws(" ", r["reason"], r["n"].cast("string")))
    return rows.select("doc_id", decided.alias("g")).select("doc_id", "g.decision", F.array_join(reasons, ", ").alias("reasons"))


@catalog.query("""WITH c AS (SELECT l_returnflag AS kind, l_linestatus AS status, CASE l_linenumber % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'error' WHEN 2 THEN 'uncertain' END AS verdict FROM lineitem),
e AS (SELECT 'kind' AS facet, kind AS value, verdict FROM c UNION ALL SELECT 'status', status, verdict FROM c)
SELECT facet, value, count(*) AS total, count(verdict) AS judged, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'error') AS error, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain FROM e GROUP BY facet, value""")
def rewrite_overview(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("l_linenumber") % 4 == 0, "correct").when(F.col("l_linenumber") % 4 == 1, "error").when(F.col("l_linenumber") % 4 == 2, "uncertain")
    return rewrites.overview(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), verdict.alias("verdict")), ["kind", "status"])


def _edits(spark: SparkSession, d: str) -> DataFrame:
    """Turns as calls that write a file and edit it."""
    m = messages(spark, d).withColumn("before", F.lag("text").over(Window.partitionBy("run_id").orderBy("step")))
    path = F.lit("out/index.html")
    write = F.to_json(F.struct(path.alias("file_path"), F.col("text").alias("content")))
    edit = F.to_json(F.struct(path.alias("file_path"), F.col("before").alias("old_string"), F.col("text").alias("new_string")))
    first = F.col("before").isNull()
    return m.select(F.col("run_id").cast("string").alias("run_id"), F.col("step").alias("call_index"), "step", F.when(first, "Write").otherwise("Edit").alias("tool"), F.when(first, write).otherwise(edit).alias("input"), F.lit(False).alias("is_error"))


@catalog.query(f"""WITH {MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS version FROM messages)
SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(version AS INTEGER) AS version, CASE WHEN version = 1 THEN 'write' ELSE 'edit' END AS action, true AS exact, text AS content FROM n""")
def artifact_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.file_versions(_edits(spark, d)).select("run_id", "version", "action", "exact", "content")


@catalog.query(f"""WITH {MESSAGES} SELECT CAST(run_id AS VARCHAR) AS run_id, 'out/index.html' AS path, CAST(count(*) AS INTEGER) AS versions FROM messages GROUP BY run_id""")
def main_deliverables(spark: SparkSession, d: str) -> DataFrame:
    return replay.main_deliverable(replay.file_versions(_edits(spark, d)))


@catalog.query(f"""WITH {MESSAGES}, w AS (SELECT * FROM (VALUES ('the'), ('thing')) w(name))
SELECT run_id, name, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS mentions FROM messages, w WHERE role IN ('assistant', 'tool') AND regexp_matches(lower(text), '(^|[^a-z0-9_-])' || name || '($|[^a-z0-9_-])') GROUP BY ALL""")
def component_trace(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("thinking", F.lit(""))
    added = m.select("run_id").distinct().select("run_id", F.lit("tool").alias("kind"), F.explode(F.array(F.lit("the"), F.lit("thing"))).alias("name"))
    found = replay.component_trace(added, m, tool_turns(spark, d)).where(F.size("mentions") > 0)
    return found.select("run_id", "name", F.array_join(F.transform("mentions", lambda x: x.cast("string")), ",").alias("mentions"))


_WORDS = ("thtion", "thing", "thble")


def tool_turns(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as calls: in some steps of a tool that returns the path of a file, in some of others that read it."""
    path, step = F.concat(F.lit("out/page-"), F.col("run_id"), F.lit(".html")), F.col("step")
    rows = messages(spark, d).where("role = 'assistant'")
    return rows.select(
        "run_id", "step", step.alias("call_index"), F.when(step % 3 == 0, "find").otherwise("Read").alias("tool"), F.when(step % 3 == 0, "mcp__shopping__find").otherwise("Read").alias("raw_name"),
        F.concat(F.col("text"), F.when(step % 5 == 0, F.concat(F.lit(" "), path)).otherwise("")).alias("input"), F.when(step % 3 == 0, F.concat(F.lit("made "), path)).otherwise("").alias("result_text"),
    )


@catalog.query(f"""WITH {MESSAGES}, m AS (SELECT * FROM messages WHERE role = 'assistant'), w AS (SELECT * FROM (VALUES {", ".join(f"('{w}')" for w in _WORDS)}) w(name)), r AS (SELECT DISTINCT run_id FROM messages),
n AS (SELECT run_id, name, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS steps FROM m, w WHERE regexp_matches(text, '(^|[^a-zA-Z0-9_.\\-])' || name || '($|[^a-zA-Z0-9_\\-])') GROUP BY ALL),
c AS (SELECT run_id, min(step) AS made, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS steps FROM m WHERE step % 3 = 0 GROUP BY run_id),
s AS (SELECT m.run_id, min(m.step) AS seen FROM m WHERE step % 5 = 0 GROUP BY m.run_id),
o AS (SELECT m.run_id, string_agg(CAST(m.step AS VARCHAR), ',' ORDER BY m.step) AS steps FROM m JOIN c ON c.run_id = m.run_id JOIN s ON s.run_id = m.run_id WHERE m.step % 5 = 0 AND m.step > c.made AND s.seen > c.made GROUP BY m.run_id)
SELECT r.run_id, w.name, '' AS calls, coalesce(n.steps, '') AS mentions, '' AS outputs FROM r CROSS JOIN w LEFT JOIN n ON n.run_id = r.run_id AND n.name = w.name
UNION ALL SELECT r.run_id, 'shopping', coalesce(c.steps, ''), '', coalesce(o.steps, '') FROM r LEFT JOIN c ON c.run_id = r.run_id LEFT JOIN o ON o.run_id = r.run_id""".replace("\\\\-", "\\-"))
def component_uses(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("thinking", F.lit(""))
    kind = lambda k, name, tools: F.struct(F.lit(k).alias("kind"), F.lit(name).alias("name"), F.array(*map(F.lit, tools)).cast("array<string>").alias("tools"))
    added = m.select("run_id").distinct().select("run_id", F.inline(F.array(kind("mcp", "shopping", ["mcp__shopping__find"]), *[kind("skill", w, []) for w in _WORDS])))
    found = components.component_uses(added, m, tool_turns(spark, d))
    steps = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("run_id", "name", steps("calls"), steps("mentions"), steps("outputs"))


@catalog.query(f"""WITH {MESSAGES}, c AS (SELECT run_id, step, step % 2 = 0 AS later, regexp_extract(text, '[a-z]+') AS handle, text FROM messages WHERE role = 'assistant'),
r AS (SELECT *, CASE WHEN NOT later THEN step WHEN handle <> '' THEN (SELECT min(u.step) FROM messages u WHERE u.run_id = c.run_id AND u.step > c.step AND u.role IN ('system', 'user') AND contains(u.text, c.handle)) END AS result_step FROM c)
SELECT r.run_id, r.step, r.later, r.result_step, CASE WHEN NOT later THEN length(r.text) ELSE coalesce((SELECT length(u.text) FROM messages u WHERE u.run_id = r.run_id AND u.step = r.result_step), 0) END AS chars,
  (SELECT coalesce(string_agg(CAST(a.step AS VARCHAR), ',' ORDER BY a.step), '') FROM (SELECT step FROM messages a WHERE a.run_id = r.run_id AND a.role = 'assistant' AND a.step > r.result_step ORDER BY step LIMIT 2) a) AS reactions FROM r""")
def delegations(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as calls that hand over work, every second with a report that comes later under its first word."""
    m, word = messages(spark, d), F.regexp_extract("text", "[a-z]+", 0)
    later = F.col("step") % 2 == 0
    launched = F.when(word != "", F.concat(F.lit("Async agent launched, agentId: "), word)).otherwise("Async agent launched")
    calls = m.where("role = 'assistant'").select("run_id", "step", F.col("step").alias("call_id"), F.lit("Task").alias("tool"), F.lit('{"prompt": "do it"}').alias("input"), F.when(later, launched).otherwise(F.col("text")).alias("result_text"), F.lit(None).cast("string").alias("spawned"))
    found = handed.delegations(calls, m)
    return found.select("run_id", "step", later.alias("later"), "result_step", F.length("result").alias("chars"), F.array_join(F.transform("next_steps", lambda x: x.cast("string")), ",").alias("reactions"))


@catalog.query("""SELECT CAST(doc_id AS VARCHAR) AS record, CASE WHEN doc_id % 20 = 0 THEN 'new' ELSE 'old' END || ' ' || lang || ' ' || length(text) AS summary FROM documents WHERE doc_id % 33 <> 1""")
def refreshed_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all documents, refreshed after every twentieth has changed and every thirty-third has gone."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record"), "lang", "text", F.length("text").alias("fingerprint"))
    say = lambda word: lambda rows: rows.select("record", F.concat_ws(" ", F.lit(word), "lang", F.length("text")).alias("summary"))
    kept = summaries.Summaries(spark, fresh_folder(spark, "summaries"), 8)
    kept.refresh(docs, ["fingerprint"], say("old"))
    now = docs.where("record % 33 <> 1").withColumn("fingerprint", F.when(F.col("record") % 20 == 0, -1).otherwise(F.col("fingerprint")))
    return kept.refresh(now, ["fingerprint"], say("new")).select("record", "summary")


@catalog.query(f"WITH {MESSAGES} SELECT run_id, count(*) FILTER (WHERE role <> 'result') + count(*) FILTER (WHERE role = 'assistant' AND step % 2 = 0) AS messages FROM messages GROUP BY run_id")
def chat_export(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("thinking", F.lit(""))
    calls = m.where("role = 'assistant'").select("run_id", "step", F.lit(1).alias("call_index"), F.concat(F.lit("c"), "step").alias("call_id"), F.lit("Bash").alias("raw_name"), F.lit('{"command": "ls"}').alias("input"), F.when(F.col("step") % 2 == 0, F.lit("listing")).alias("result_text"))
    lines = sinks.chat_samples(m, calls)
    return lines.select("run_id", F.size(F.try_variant_get(F.parse_json("line"), "$.messages", "array<variant>")).cast("long").alias("messages"))


@catalog.query()
def judged_steps(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("thinking", F.lit(""))
    made = tool_turns(spark, d).select("run_id", "step", "call_index", (F.col("step") % 4 == 0).alias("is_error"), F.concat("result_text", F.lit(" "), "input").alias("result_text"))
    return judge.flagged_steps(judge.ask(judge.step_states(m, made, scalars.clip), judge.offline_client))


@catalog.query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM g)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS events FROM s GROUP BY user_id, nth""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return imports.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("string").alias("start"), "events")


@catalog.query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS calls FROM events GROUP BY ALL")
def hourly_tool_counts(spark: SparkSession, d: str) -> DataFrame:
    return imports.tool_counts(table(spark, d, "events")).select(F.col("start").cast("string").alias("start"), "event_type", "calls")

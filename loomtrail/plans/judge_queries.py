"""Queries of what a judge finds in windows of steps, of prompts by section and of data cards as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, judge, prompts
from ..sources import sinks
from .registry import Catalog
from .tables import MESSAGES, messages, runs, table

catalog = Catalog()

WINDOWS = f"""{MESSAGES}, w AS (SELECT run_id, step, coalesce(text, '') AS summary, (row_number() OVER (PARTITION BY run_id ORDER BY step) - 1) // 60 AS win FROM messages)"""


def _answers(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    summaries = messages(spark, d).withColumnRenamed("text", "summary")
    return judge.ask_choices(judge.step_windows(summaries, questions), judge.offline_choices)


@catalog.query(f"""WITH {WINDOWS}, h AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY run_id, win) AS p FROM w WHERE contains(lower(summary), 'the')),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, CAST(step AS VARCHAR) DESC) AS place FROM h WHERE p >= 0.05)
SELECT run_id, CAST(place AS INTEGER) AS place, step, round(CAST(p AS DOUBLE), 3) AS p FROM r WHERE place <= 8""")
def step_search(spark: SparkSession, d: str) -> DataFrame:
    asked = messages(spark, d).select("run_id").distinct().select("run_id", F.lit("match").alias("question"), F.lit("the").alias("what"))
    return judge.found_steps(_answers(spark, d, asked)).drop("question")


@catalog.query(f"""WITH {WINDOWS}, q AS (SELECT * FROM (VALUES ('r0', 'the'), ('r1', 'thing'), ('r2', 'zebra')) q(question, what)),
h AS (SELECT w.run_id, question, step, 1.0 / count(*) OVER (PARTITION BY w.run_id, win, question) AS p FROM w JOIN q ON contains(lower(summary), what)),
b AS (SELECT run_id, question, max(p) AS p FROM h GROUP BY ALL), f AS (SELECT b.*, min(step) AS step FROM b JOIN h USING (run_id, question, p) GROUP BY ALL),
a AS (SELECT run_id, question, coalesce(p, 0) AS p, step FROM (SELECT DISTINCT run_id FROM messages) CROSS JOIN q LEFT JOIN f USING (run_id, question))
SELECT run_id, question, CASE WHEN p >= 0.3 THEN step END AS step, round(CAST(p AS DOUBLE), 3) AS p_step FROM a""")
def requirement_coverage(spark: SparkSession, d: str) -> DataFrame:
    asked = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("r0", "r1", "r2"))), F.array(*map(F.lit, ("the", "thing", "zebra"))))).alias("question", "what")
    requirements = messages(spark, d).select("run_id").distinct().select("run_id", asked)
    return judge.covered(requirements, _answers(spark, d, requirements))


@catalog.query("""WITH a AS (SELECT l_orderkey AS run_id, l_linenumber % 2 AS compaction, 'r' || l_linenumber AS question, l_discount * 10 AS p FROM lineitem)
SELECT run_id, CAST(compaction AS INTEGER) AS compaction, coalesce(string_agg(DISTINCT question, ',' ORDER BY question) FILTER (WHERE p < 0.5), '') AS dropped FROM a GROUP BY ALL""")
def dropped_requirements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") % 2).cast("int").alias("compaction"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("question"), (F.col("l_discount") * 10).alias("p"))
    return judge.dropped_requirements(rows).withColumn("dropped", F.array_join("dropped", ","))


@catalog.query(f"""WITH {MESSAGES}, t AS (SELECT run_id, step, CASE WHEN step % 2 = 0 THEN 'before' || chr(10) ELSE '' END || '# ' || role || ' ' || chr(10) || text || chr(10) || '  ```sh' || chr(10) || '# not of the first' || chr(10) || '```' || chr(10) || '# # level' || chr(10) || '# end' || chr(10) || 'tail' AS text FROM messages),
l AS (SELECT run_id, step, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
f AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, step ORDER BY n) AS fences FROM l),
o AS (SELECT *, fences % 2 = 0 AND starts_with(line, '# ') AND NOT starts_with(line, '# #') AS opens FROM f),
s AS (SELECT *, CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY run_id, step ORDER BY n) AS INTEGER) AS section FROM o)
SELECT run_id, step, section, coalesce(max(trim(line[3:])) FILTER (WHERE opens), '') AS heading, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT opens), '') AS body FROM s GROUP BY ALL
UNION ALL SELECT run_id, step, 0, '', '' FROM s WHERE n = 1 AND opens""")
def prompt_sections(spark: SparkSession, d: str) -> DataFrame:
    before = F.when(F.col("step") % 2 == 0, "before\n").otherwise("")
    text = F.concat(before, F.lit("# "), "role", F.lit(" \n"), "text", F.lit("\n  ```sh\n# not of the first\n```\n# # level\n# end\ntail"))
    return prompts.sections(messages(spark, d).withColumn("text", text), ("run_id", "step"))


@catalog.query("""WITH c AS (SELECT 'collection' AS facet, 'Collections' AS title, source AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'model', 'Models', lang, count(*) FROM documents GROUP BY ALL),
h AS (SELECT DISTINCT facet, title FROM c)
SELECT facet, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) + 3 AS INTEGER) AS place, '| ' || value || ' | ' || n || ' |' AS line FROM c
UNION ALL SELECT facet, CAST(n AS INTEGER), [ '### ' || title, '', '| | count |', '| --- | ---: |' ][n + 1] FROM h, range(4) x(n)""")
def data_card_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.card_lines(aggregates.data_card(runs(spark, d), ["collection", "model"]), {"collection": "Collections", "model": "Models"})

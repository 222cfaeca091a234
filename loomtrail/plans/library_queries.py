"""Queries of the run library: joins, predicates, listings, episodes and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import episodes, joins, library, sampling, search, text_index, upserts
from ..operators.lineage import fresh_folder
from .registry import Catalog
from .tables import CALLS, MESSAGES, RUNS, calls, messages, runs, table

catalog = Catalog()


@catalog.query("""SELECT d.doc_id, d.source, l.quality, l.quality IS NOT NULL AS reviewed FROM documents d LEFT JOIN (SELECT * FROM labels WHERE doc_id % 3 = 0) l ON d.doc_id = l.doc_id""")
def reviewed_left_join(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "labels").select(F.col("doc_id").alias("run_id"), (F.col("doc_id") % 3).alias("reviewer"), F.col("quality").alias("human_status"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), "source")
    return joins.with_reviews(docs, reviews, 0).select(F.col("run_id").alias("doc_id"), "source", F.col("human_status").alias("quality"), "reviewed")


@catalog.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@catalog.query(f"WITH {RUNS} SELECT run_id, collection FROM runs r WHERE EXISTS (SELECT 1 FROM runs m WHERE m.flagged AND m.collection = r.collection AND m.model = r.model)")
def flagged_semi(spark: SparkSession, d: str) -> DataFrame:
    members = runs(spark, d).withColumn("episode_key", F.col("model"))
    return library.with_member_flag(members, members, F.col("flagged")).select("run_id", "collection")


@catalog.query("""WITH r AS (SELECT d.source AS collection, d.lang AS episode_key, l.doc_id AS run_id, l.quality AS human_status, n_chars AS updated_at FROM labels l JOIN documents d USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY collection, episode_key ORDER BY updated_at DESC, run_id DESC) AS nth, count(*) OVER (PARTITION BY collection, episode_key) AS reviews FROM r),
g AS (SELECT collection, episode_key, string_agg(DISTINCT 'q' || human_status, ',' ORDER BY 'q' || human_status) AS labels FROM r GROUP BY ALL)
SELECT collection, episode_key, updated_at, human_status, reviews, labels FROM k JOIN g USING (collection, episode_key) WHERE nth = 1""")
def latest_review_per_head(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.col("source").alias("collection"), F.col("lang").alias("episode_key"), "n_chars")
    reviews = table(spark, d, "labels").join(docs.select("run_id", "n_chars"), F.col("doc_id") == F.col("run_id")).select("run_id", F.col("n_chars").alias("updated_at"), F.col("quality").alias("human_status"), F.array(F.concat(F.lit("q"), "quality")).alias("labels"))
    return joins.latest_review(docs, reviews).withColumn("labels", F.array_join("labels", ","))


_ROOTS = """p AS (SELECT page_id AS run_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
w AS (SELECT DISTINCT split_part(path, '/', 1) AS root, 'host' AS label, 1 AS imported_at FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'lang', 2 FROM p WHERE run_id % 2 = 0)"""


@catalog.query(f"""WITH {_ROOTS}, m AS (SELECT run_id, root, label, row_number() OVER (PARTITION BY run_id ORDER BY imported_at DESC, label, root) AS nth FROM p JOIN w ON p.path = w.root OR starts_with(p.path, w.root || '/'))
SELECT run_id, root, label FROM m WHERE nth = 1""")
def reward_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    paths = table(spark, d, "pages").select(F.col("page_id").alias("run_id"), path.alias("path"))
    part = lambda n: F.split_part("path", F.lit("/"), F.lit(n))
    hosts = paths.select(part(1).alias("root"), F.lit("host").alias("label"), F.lit(1).alias("imported_at"))
    langs = paths.where("run_id % 2 = 0").select(F.concat(part(1), F.lit("/"), part(2)).alias("root"), F.lit("lang").alias("label"), F.lit(2).alias("imported_at"))
    return joins.latest_by_prefix(paths, hosts.unionByName(langs).distinct()).select("run_id", "root", "label")


@catalog.query("""WITH f AS (SELECT l_orderkey, count(*) AS records FROM lineitem GROUP BY l_orderkey), s AS (SELECT *, sum(records) OVER (ORDER BY l_orderkey) AS end_row FROM f)
SELECT c_custkey, l_orderkey FROM customer JOIN s ON c_custkey * 2 >= end_row - records AND c_custkey * 2 < end_row""")
def manifest_span_join(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("records"))
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 2).alias("row"))
    return joins.span_join(rows, joins.spans_of(files, ["l_orderkey"])).select("c_custkey", "l_orderkey")


@catalog.query()
def manifest_span_join_whole(spark: SparkSession, d: str) -> DataFrame:
    """``manifest_span_join``, tested against brute force."""
    files = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("records"))
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 2).alias("row"))
    return joins.span_join(rows, joins.spans_of(files, ["l_orderkey"])).select("c_custkey", "l_orderkey")


@catalog.query(f"""WITH {CALLS} SELECT a.run_id, a.call_id, arg_min(b.call_id, (b.ts, b.call_id)) AS matched FROM calls a LEFT JOIN calls b ON b.run_id = a.run_id AND b.tool = 'purchase' AND (b.ts, b.call_id) > (a.ts, a.call_id)
WHERE a.is_error GROUP BY a.run_id, a.call_id""")
def first_match_after(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_after(calls(spark, d), F.col("is_error"), F.col("tool") == "purchase")


@catalog.query(f"""WITH {CALLS}, e AS (SELECT run_id, ts, call_id FROM calls WHERE is_error), p AS (SELECT run_id, ts, weight FROM calls WHERE tool = 'purchase')
SELECT e.run_id, e.call_id, p.weight AS weight_as_of FROM e ASOF LEFT JOIN p ON e.run_id = p.run_id AND e.ts >= p.ts""")
def last_value_before(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d)
    left = rows.where("is_error").select("run_id", "ts", "call_id")
    right = rows.where("tool = 'purchase'").select("run_id", "ts", "weight")
    return joins.last_before(left, right, "run_id", "ts", "weight").select("run_id", "call_id", "weight_as_of")


@catalog.query("""WITH k AS (SELECT doc_id, source, sha1(lower(text)) AS task FROM documents), s AS (SELECT task FROM k GROUP BY task HAVING count(DISTINCT source) > 1) SELECT doc_id, source, task FROM k WHERE task IN (SELECT task FROM s)""")
def task_key_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha1(F.lower("text").cast("binary")).alias("task"))
    return joins.crossing_keys(rows, "task", "source").select("doc_id", "source", "task")


@catalog.query(f"""WITH {RUNS} SELECT run_id FROM runs WHERE collection = 'src3' AND outcome = 'pass' AND contains(lower(instruction), 'the') AND model IN ('en', 'de')""")
def filtered_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).withColumn("role", F.col("model"))
    wanted = library.RunFilter(collection="src3", outcome="pass", search="the", roles=("en", "de"))
    return rows.where(wanted.condition(rows.columns)).select("run_id")


@catalog.query(f"""WITH {RUNS} SELECT run_id, size FROM runs ORDER BY size DESC NULLS LAST, run_id LIMIT 50 OFFSET 20""")
def listing_page(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).withColumn("tokens", F.col("size"))
    return library.page(rows, library.orderings()["tokens"], 50, 20).select("run_id", "size")


@catalog.query(f"""WITH {MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS nth, count(*) OVER (PARTITION BY run_id) AS n FROM messages)
SELECT run_id, step, role FROM n WHERE nth > least(4, n - 1) AND nth <= least(4, n - 1) + 2""")
def message_page(spark: SparkSession, d: str) -> DataFrame:
    return library.message_page(messages(spark, d), 4, 2).select("run_id", "step", "role")


@catalog.query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thnd of')")
def literal_substring_search(spark: SparkSession, d: str) -> DataFrame:
    return search.literal_search(table(spark, d, "documents"), ["text"], "Thnd of").select("doc_id")


_TREE = """t AS (SELECT c_custkey AS run_id, 'k' || c_custkey AS self_key, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'gone' || c_custkey ELSE 'k' || (c_custkey - c_custkey % 7 // 2 - 1) END AS parent_key FROM customer)"""


@catalog.query(f"""WITH RECURSIVE {_TREE}, r(run_id, self_key, root) AS (
  SELECT run_id, self_key, coalesce(parent_key, self_key) FROM t WHERE parent_key IS NULL OR parent_key NOT IN (SELECT self_key FROM t)
  UNION ALL SELECT t.run_id, t.self_key, r.root FROM t JOIN r ON t.parent_key = r.self_key)
SELECT run_id, root AS episode_key FROM r""")
def episode_roots(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    parent = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.concat(F.lit("gone"), key)).otherwise(F.concat(F.lit("k"), key - F.floor(key % 7 / 2) - 1))
    rows = table(spark, d, "customer").select(key.alias("run_id"), F.concat(F.lit("k"), key).alias("self_key"), parent.alias("parent_key"), F.lit(None).cast("string").alias("group_key"))
    return episodes.episode_roots(rows, 1024).select("run_id", "episode_key")


@catalog.query(f"""WITH {MESSAGES}, s AS (SELECT *, step * 2 - 1 AS segment FROM messages WHERE step <> 2),
g AS (SELECT run_id, count(*) AS members, max(segment) AS top, list(segment) AS have, CAST(sum(length(text)) AS BIGINT) AS steps FROM s GROUP BY run_id)
SELECT run_id AS episode_key, members, steps, array_to_string(list_filter(range(1, top + 1), lambda x: NOT list_contains(have, x)), ',') AS missing FROM g""")
def episode_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).where("step <> 2").select(
        F.lit("all").alias("collection"), F.col("run_id").alias("episode_key"), F.col("step").alias("run_id"), F.lit("main").alias("role"), (F.col("step") * 2 - 1).alias("segment"),
        F.length("text").alias("steps"), F.lit(0).alias("tool_calls"), F.lit(0).alias("tool_errors"), F.lit(0).alias("tokens"), F.lit(0).alias("duration_ms"), F.array().cast("array<string>").alias("flags"),
    )
    return episodes.episode_summary(rows).select("episode_key", "members", "steps", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@catalog.query(f"""WITH {RUNS}, p AS (SELECT * FROM runs WHERE outcome = 'pass'), f AS (SELECT * FROM runs WHERE outcome = 'fail'), k AS (SELECT p.collection, p.model, min(p.run_id) AS passed FROM p GROUP BY ALL), q AS (SELECT collection, model, min(run_id) AS failed FROM f GROUP BY ALL)
SELECT collection, model AS task_key, passed, failed FROM k JOIN q USING (collection, model)""")
def same_task_pass_fail_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pass_fail_pairs(runs(spark, d).withColumn("task_key", F.col("model")))


@catalog.query()
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).withColumn("task_key", F.col("model")).withColumn("suspicious", F.col("flagged") & (F.col("outcome") == "pass"))
    return sampling.daily_queue(rows, "2024-01-01", 20)


_TERMS = r"regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+')"


@catalog.query(rf"""WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM t),
f AS (SELECT doc_id, len(w) AS size, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'of')) AS tf1, len(list_filter(w, lambda x: x = 'and')) AS tf2 FROM t),
c AS (SELECT count(*) FILTER (WHERE tf1 > 0) AS d1, count(*) FILTER (WHERE tf2 > 0) AS d2 FROM f),
k AS (SELECT doc_id, -(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * size / av)) + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * size / av))) AS score FROM f, c, s WHERE tf1 > 0 AND tf2 > 0)
SELECT doc_id AS run_id, round(score, 6) AS score FROM k ORDER BY score, doc_id LIMIT 50""")
def phrase_search_bm25(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), "text")
    return search.search_text(steps, '"the of" and', ("run_id",), digits=6)


@catalog.query(rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN text || ' the of and' ELSE text END AS text FROM documents WHERE doc_id % 50 <> 7), t AS (SELECT doc_id, {_TERMS} AS w FROM d), s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM t),
f AS (SELECT doc_id, len(w) AS size, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'of')) AS tf1, len(list_filter(w, lambda x: x = 'and')) AS tf2 FROM t),
c AS (SELECT count(*) FILTER (WHERE tf1 > 0) AS d1, count(*) FILTER (WHERE tf2 > 0) AS d2 FROM f),
k AS (SELECT doc_id, -(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * size / av)) + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * size / av))) AS score FROM f, c, s WHERE tf1 > 0 AND tf2 > 0)
SELECT doc_id AS run_id, round(score, 6) AS score FROM k ORDER BY score, doc_id LIMIT 50""")
def indexed_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """The kept index over all documents, after every fiftieth got more text and another fiftieth went."""
    steps = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), "text")
    index = text_index.TextIndex(spark, fresh_folder(spark, "index"), ("run_id",))
    index.build(steps, parts=4, buckets=8)
    longer = steps.where("run_id % 50 = 0").withColumn("text", F.concat("text", F.lit(" the of and")))
    index.replace(longer, steps.where("run_id % 50 = 7"))
    return index.search('"the of" and', digits=6)


@catalog.query("""WITH o AS (SELECT doc_id, source AS collection, n_chars AS value, 1 AS version FROM documents UNION ALL SELECT doc_id, source, n_chars + 1, 2 FROM documents WHERE doc_id % 4 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS nth FROM o) SELECT doc_id, collection, value, CAST(version AS INTEGER) AS version FROM k WHERE nth = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").select("doc_id", F.col("source").alias("collection"), F.col("n_chars").alias("value"), F.lit(1).alias("version"))
    new = old.where("doc_id % 4 = 0").withColumn("value", F.col("value") + 1).withColumn("version", F.lit(2))
    return upserts.upsert(old, new, ["doc_id"])


@catalog.query("""SELECT source AS collection, count(*) AS runs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS size FROM documents WHERE source IN ('src0', 'src3') GROUP BY source""")
def removal_preview(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("source", "collection")
    return upserts.removal_preview(docs, ["src0", "src3"], {"size": "n_chars"})


@catalog.query(r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, CASE WHEN html LIKE 'Traceback%' THEN 'raised' WHEN regexp_matches(html, '^\s*[Ee]rror:') THEN 'error' ELSE 'none' END AS kind FROM pages""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    kind = F.when(html.startswith("Traceback"), "raised").when(scalars.tool_error(html), "error").otherwise("none")
    return table(spark, d, "pages").select("page_id", F.regexp_count(html, F.lit("<p>")).cast("long").alias("paragraphs"), kind.alias("kind"))


@catalog.query("""WITH r AS (SELECT doc_id AS run_id, lang AS task_key, source AS episode_key FROM documents)
SELECT a.run_id AS of_run, b.run_id FROM r a JOIN r b ON a.task_key = b.task_key AND a.episode_key <> b.episode_key WHERE a.run_id % 100 = 0""")
def related_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.col("lang").alias("task_key"), F.col("source").alias("episode_key"))
    return joins.related_runs(rows.where("run_id % 100 = 0"), rows).select("of_run", "run_id")


@catalog.query()
def related_runs_each_hundredth(spark: SparkSession, d: str) -> DataFrame:
    """Every row with an id divisible by 100 against all rows, tested against brute force."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.col("lang").alias("task_key"), F.col("source").alias("episode_key"))
    return joins.related_runs(rows.where("run_id % 100 = 0"), rows).select("of_run", "run_id")


@catalog.query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) = 1 AS first, length(text) AS size FROM (SELECT doc_id, text, 0 AS part FROM documents UNION ALL SELECT doc_id, text, 1 FROM documents WHERE doc_id % 10 = 0)""")
def samples_by_offset(spark: SparkSession, d: str) -> DataFrame:
    """All documents as chat samples in JSON lines, every tenth twice in its file, read by byte ranges."""
    from ..sources import ranges

    docs = table(spark, d, "documents")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), turns.alias("messages")))
    folder = fresh_folder(spark, "samples")
    docs.select(F.explode(F.array_repeat(line, F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1)))).write.text(folder)
    found = ranges.read_samples(spark, folder, split=1_000_000)
    return found.select(F.col("sample_id").cast("long").alias("doc_id"), (F.col("key") == F.col("sample_id")).alias("first"), F.length(F.try_variant_get("value", "$.messages[0].content", "string")).alias("size"))

"""Episodes: the forest of segments and subagents, summed up by root."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def episode_roots(runs: DataFrame, max_depth: int = 1 << 16) -> DataFrame:
    """Adds episode_key: the root reached by parent_key → self_key.

    A parent that wasn't imported keeps its key; a run without one has its group, self key, or ``row:`` id. Of runs
    that share a self key the one with the largest id counts. Links are halved in each round (pointer
    jumping), so depth d takes log2(d) joins; runs on a cycle keep their parent key. The lineage is cut in every round,
    since each reads the links of the one before twice.
    """
    own = F.coalesce("group_key", "self_key", F.concat(F.lit("row:"), F.col("run_id").cast("string")))
    named = runs.where(F.col("self_key").isNotNull()).groupBy("self_key").agg(F.max_by(F.struct(F.col("parent_key").alias("parent"), own.alias("own")), "run_id").alias("n")).select("self_key", "n.*")
    links = cut(named.select(F.col("self_key").alias("key"), F.col("parent").alias("next"), "own"))
    for _ in range(max(1, math.ceil(math.log2(max_depth)))):
        moving = links.where(F.col("next").isNotNull())
        if moving.isEmpty():
            break
        after = links.select(F.col("key").alias("next"), F.col("next").alias("_next2"), F.col("own").alias("_own2"), F.lit(True).alias("_known"))
        jumped = links.join(after, "next", "left")
        # an unknown parent ends the chain with its key; a parent without a parent gives its own
        ended = F.col("next").isNotNull() & F.col("_known").isNull()
        arrived = F.col("_known") & F.col("_next2").isNull()
        jumped = jumped.select(
            "key",
            F.when(ended | arrived, F.lit(None)).otherwise(F.coalesce("_next2", "next")).alias("next"),
            F.when(ended, F.col("next")).when(arrived, F.col("_own2")).otherwise(F.col("own")).alias("own"),
        )
        links = cut(jumped)
    roots = links.select(F.col("key").alias("parent_key"), F.when(F.col("next").isNull(), F.col("own")).alias("_root"))
    joined = runs.join(roots, "parent_key", "left")
    return joined.withColumn("episode_key", F.when(F.col("parent_key").isNull(), own).otherwise(F.coalesce("_root", "parent_key"))).drop("_root").select(*runs.columns, "episode_key")


def missing_numbers(numbers: Column) -> Column:
    """The numbers from 1 to the largest that a set of numbers lacks."""
    top = F.array_max(numbers)
    return F.when(top >= 1, F.array_except(F.sequence(F.lit(1).cast("long"), top.cast("long")), F.transform(numbers, lambda x: x.cast("long")))).otherwise(F.array().cast("array<long>"))


def episode_summary(runs: DataFrame) -> DataFrame:
    """For each episode: head, sums of steps, calls and errors, tokens and duration (null when nothing is known),
    segments present and missing. Duration counts threads only, not subagents."""
    thread = F.coalesce("role", F.lit("main")) != "subagent"
    order = F.struct((~thread).alias("sub"), F.coalesce("segment", F.lit(0)).alias("segment"), "run_id")
    segments = F.array_sort(F.collect_set(F.when(thread, F.col("segment"))))
    return runs.groupBy("collection", "episode_key").agg(
        F.min_by("run_id", order).alias("head"), F.count("*").alias("members"), F.count_if(~thread).alias("subagents"),
        F.sum("steps").alias("steps"), F.sum("tool_calls").alias("tool_calls"), F.sum("tool_errors").alias("tool_errors"),
        F.nullif(F.sum("tokens"), F.lit(0)).alias("tokens"), F.nullif(F.sum(F.when(thread, F.col("duration_ms"))), F.lit(0)).alias("duration_ms"),
        segments.alias("segments"), F.array_distinct(F.flatten(F.collect_list("flags"))).alias("flags"),
    ).withColumn("missing", missing_numbers(F.col("segments"))).withColumn("head_missing", F.array_contains("missing", F.lit(1).cast("long")))


def suppress_continued(runs: DataFrame, end_flag: str = "no_verify", end_issue: str = "truncated_end") -> DataFrame:
    """On threads that a later segment continues, drops the end-only flag and makes the end-only issue an information;
    ready is decided again. issues: array of struct(key, severity)."""
    w = Window.partitionBy("collection", "episode_key").orderBy(F.coalesce("segment", F.lit(0)).desc(), F.desc("run_id"))
    thread = F.coalesce("role", F.lit("main")) != "subagent"
    later = F.max(F.when(thread, F.lit(True))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_continued", thread & F.coalesce(later, F.lit(False)))
    flags = F.when(F.col("_continued"), F.array_remove("flags", end_flag)).otherwise(F.col("flags"))
    soft = F.transform("issues", lambda x: F.when(x["key"] == end_issue, F.struct(x["key"].alias("key"), F.lit("info").alias("severity"))).otherwise(F.struct(x["key"].alias("key"), x["severity"].alias("severity"))))
    marked = marked.withColumn("flags", flags).withColumn("issues", F.when(F.col("_continued"), soft).otherwise(F.transform("issues", lambda x: F.struct(x["key"].alias("key"), x["severity"].alias("severity")))))
    return marked.withColumn("ready", ~F.exists("issues", lambda x: x["severity"] == "block")).drop("_continued")


def inherit_title(runs: DataFrame) -> DataFrame:
    """Segments without an instruction get title and task of the first run with one in their group."""
    w = Window.partitionBy("source_id", "group_key").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.when((F.col("instruction") != "") & (F.coalesce("role", F.lit("main")) != "subagent"), F.struct("title", "task_key"))
    first = F.first(told, ignorenulls=True).over(w)
    needs = F.coalesce("instruction", F.lit("")) == ""
    out = runs.withColumn("_first", first)
    return out.withColumn("title", F.when(needs, F.coalesce("_first.title", "title")).otherwise(F.col("title"))).withColumn("task_key", F.when(needs, F.coalesce("_first.task_key", "task_key")).otherwise(F.col("task_key"))).drop("_first")


def episode_tree(members: DataFrame, launches: DataFrame | None = None, current: Column | None = None) -> DataFrame:
    """(collection, episode_key, lane, place, kind, segment, run_id, launched_by, launched_at, current) of each episode.

    Lane ``thread`` has the main run and its segments in order, and a row of the kind ``missing`` for each number that a
    later segment shows to be missing (a main run without a number is the first); lane ``subagent`` has the others by the step that launched them. ``launches``
    (run_id, launched_by, launched_at) tells of that, ``current`` which run is shown.
    """
    keys = ["collection", "episode_key"]
    thread = F.coalesce("role", F.lit("main")) != "subagent"
    number = F.coalesce("segment", F.lit(0)).cast("long")
    rank = F.when(F.coalesce("role", F.lit("main")) == "main", 0).otherwise(1)
    shown = F.coalesce(current, F.lit(False)) if current is not None else F.lit(False)
    rows = members.select(*keys, "run_id", "role", number.alias("segment"), thread.alias("_thread"), rank.alias("_rank"), shown.alias("current"))
    have = rows.where("_thread").groupBy(*keys).agg(F.collect_set(F.when(F.col("segment") > 0, F.col("segment")).when(F.col("_rank") == 0, 1)).alias("_have"))
    blank = {"run_id": members.schema["run_id"].dataType, "role": members.schema["role"].dataType}
    gaps = have.select(*keys, F.explode(missing_numbers(F.col("_have"))).alias("segment")).select(
        *keys, *[F.lit(None).cast(t).alias(c) for c, t in blank.items()], "segment", F.lit(True).alias("_thread"), F.lit(1).alias("_rank"), F.lit(False).alias("current")
    )
    rows = rows.withColumn("_gap", F.lit(False)).unionByName(gaps.withColumn("_gap", F.lit(True)))
    if launches is not None:
        rows = rows.join(launches.select("run_id", "launched_by", "launched_at"), "run_id", "left")
    else:
        rows = rows.withColumns({"launched_by": F.lit(None).cast(blank["run_id"]), "launched_at": F.lit(None).cast("int")})
    kind = F.when(F.col("_gap"), "missing").when(~F.col("_thread"), "subagent").when(F.col("segment") > 0, "segment").otherwise("main")
    lane = F.when(F.col("_thread"), "thread").otherwise("subagent")
    order = [F.when(F.col("_thread"), F.col("_rank")), F.when(F.col("_thread"), F.col("segment")), F.col("launched_at").asc_nulls_last(), F.col("segment"), F.col("run_id")]
    place = F.row_number().over(Window.partitionBy(*keys, "_thread").orderBy(*order))
    return rows.select(*keys, lane.alias("lane"), place.alias("place"), kind.alias("kind"), "segment", "run_id", "launched_by", "launched_at", "current")

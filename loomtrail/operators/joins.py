"""Joins of runs with reviews, rewards, spans and later events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .sequences import backwards


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two summaries side by side, 0 where one lacks a key."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values])
    b = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values])
    joined = a.join(b, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(f"{v}_{s}", F.lit(0)).alias(f"{v}_{s}") for v in values for s in ("left", "right")])


def with_reviews(runs: DataFrame, reviews: DataFrame, reviewer: str | None = None) -> DataFrame:
    """Runs with their review, or one reviewer's; whether there is one."""
    own = reviews.where(F.col("reviewer") == reviewer) if reviewer is not None else reviews
    return runs.join(own, "run_id", "left").withColumn("reviewed", F.col("human_status").isNotNull())


def latest_review(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """For each episode (collection, episode_key) the latest review of any member, and all labels given (in order, once
    each) if reviews have ``labels``."""
    joined = reviews.join(runs.select("run_id", "collection", "episode_key"), "run_id")
    labels = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels")] if "labels" in reviews.columns else []
    return joined.groupBy("collection", "episode_key").agg(
        F.max("updated_at").alias("updated_at"), F.max_by("human_status", F.struct("updated_at", "run_id")).alias("human_status"), F.count("*").alias("reviews"), *labels
    )


def prefixes(path: Column, separator: str = "/") -> Column:
    """A path and all its ancestors."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def suffixes(name: Column, separator: str = "/") -> Column:
    """A name and all its suffixes after a separator."""
    parts = F.split(name, separator)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), separator))


def latest_by_prefix(runs: DataFrame, rewards: DataFrame, id_col: str = "run_id", path_col: str = "path", root_col: str = "root", stamp: str = "imported_at", tie: Sequence[str] = ("label",)) -> DataFrame:
    """Each run with the latest reward whose root is its path or an ancestor of it, and, if both have ``task_id``, whose
    task is its own or what is left of that after a namespace.

    Both conditions are equalities with one of the path's ancestors and one of the task's suffixes, so that Spark hashes
    both sides instead of comparing every pair. Latest wins, then the smallest of ``tie`` and the root.
    """
    candidates = runs.withColumn("_root", F.explode(F.array_distinct(prefixes(F.col(path_col)))))
    keys = [root_col]
    if "task_id" in runs.columns and "task_id" in rewards.columns:
        keys.append("task_id")
        candidates = candidates.select(id_col, F.col("_root").alias(root_col), F.explode(F.array_distinct(suffixes(F.col("task_id")))).alias("task_id"))
    else:
        candidates = candidates.select(id_col, F.col("_root").alias(root_col))
    matched = candidates.join(rewards, keys)
    best = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(stamp), *tie, root_col))
    return matched.withColumn("_nth", best).where("_nth = 1").drop("_nth")


def spans_of(files: DataFrame, order: Sequence[str], records: str = "records") -> DataFrame:
    """Files with the half-open span of rows [start_row, end_row) that they hold, by running sums of their
    records: sums within range partitions, then offsets from the one sum of each partition joined back. The
    partitions are cut once, since they could be dealt otherwise when they are computed again."""
    by_order = [F.col(c) for c in order]
    dealt = cut(files.repartitionByRange(*by_order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*by_order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("_part").agg(F.sum(records).alias("_sum"))
    # one row for each partition
    # sums before a partition: those of its block of partitions, and those of the blocks before, of which there are few
    sums = sums.withColumn("_block", F.floor(F.col("_part") / 256))
    in_block = Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("_block").agg(F.sum("_sum").alias("_all"))
    earlier = blocks.alias("p").join(blocks.alias("o"), F.col("o._block") < F.col("p._block"), "left").groupBy("p._block").agg(F.coalesce(F.sum("o._all"), F.lit(0)).alias("_earlier"))
    offsets = sums.withColumn("_own", F.coalesce(F.sum("_sum").over(in_block), F.lit(0))).join(earlier, "_block").select("_part", (F.col("_own") + F.col("_earlier")).alias("_offset"))
    spans = dealt.withColumn("end_row", F.sum(records).over(within)).join(F.broadcast(offsets), "_part")
    return spans.withColumn("end_row", F.col("end_row") + F.col("_offset")).withColumn("start_row", F.col("end_row") - F.col(records)).drop("_part", "_offset")


def span_join(rows: DataFrame, spans: DataFrame, at: str = "row", bucket: int = 1024) -> DataFrame:
    """Rows with the span that holds them. Spans are dealt to the buckets that they touch, which makes an
    equality of the range condition."""
    dealt = spans.where("end_row > start_row").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_row") / bucket), F.floor((F.col("end_row") - 1) / bucket))))
    marked = rows.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return marked.join(dealt, "_bucket").where((F.col(at) >= F.col("start_row")) & (F.col(at) < F.col("end_row"))).drop("_bucket")


def first_after(events: DataFrame, opens: Column, closes: Column, order: Sequence[str] = ("ts", "call_id"), partition: Sequence[str] = ("run_id",)) -> DataFrame:
    """For each opening event the first closing one after it in its partition (null: none)."""
    later = backwards(partition[0], order, *partition[1:])
    matched = F.last(F.when(closes, F.col(order[-1])), ignorenulls=True).over(later)
    return events.withColumn("matched", matched).where(opens).select(*partition, order[-1], "matched")


def last_before(left: DataFrame, right: DataFrame, on: str, stamp: str, value: str) -> DataFrame:
    """As-of join: each left row with the latest right value at or before its stamp, by one sort of both."""
    both = left.select(on, stamp, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = right.select(on, stamp, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    w = Window.partitionBy(on).orderBy(stamp, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(other).withColumn("_as_of", F.last("_value", ignorenulls=True).over(w))
    return found.where("_side = 1").select("_row.*", F.col("_as_of").alias(f"{value}_as_of"))


def crossing_keys(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose key occurs under several values of ``column``."""
    shared = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(column).alias("_n")).where("_n > 1").select(key)
    return rows.join(shared, key, "left_semi")


def spawning_calls(children: DataFrame, calls: DataFrame) -> DataFrame:
    """Children with the step that launched them: by the call they name as parent, else by the call that names them.

    children: (run_id, episode_key, parent_call_id, self_key); calls: (run_id, episode_key, call_id, spawned, step).
    """
    made = calls.select(F.col("run_id").alias("parent_run"), "episode_key", F.col("call_id").alias("parent_call_id"), "spawned", "step")
    by_call = made.groupBy("episode_key", "parent_call_id").agg(F.min(F.struct("step", "parent_run")).alias("by_call"))
    by_name = made.where(F.col("spawned").isNotNull()).groupBy("episode_key", F.col("spawned").alias("self_key")).agg(F.min(F.struct("step", "parent_run")).alias("by_name"))
    joined = children.join(by_call, ["episode_key", "parent_call_id"], "left").join(by_name, ["episode_key", "self_key"], "left")
    launch = F.when(F.col("by_call.parent_run") != F.col("run_id"), F.col("by_call"))
    named = F.when(F.col("by_name.parent_run") != F.col("run_id"), F.col("by_name"))
    return joined.withColumn("launch", F.coalesce(launch, named)).select(*children.columns, F.col("launch.parent_run").alias("launched_by"), F.col("launch.step").alias("launched_at"))


def related_runs(wanted: DataFrame, runs: DataFrame, block: int = 256) -> DataFrame:
    """For a stated set of runs those of other episodes with the same task.

    There are as many rows as pairs, which grow with the product of both sides. So that a frequent task isn't the work of one
    task of Spark, both sides are dealt to blocks of about ``block`` rows of one task and episode, pairs of blocks are dealt
    out evenly, and each is written out where it lies. Spark holds the rows of one pair of blocks at a time.
    """
    mine = _blocks(wanted.select(F.col("run_id").alias("of_run"), "task_key", F.col("episode_key").alias("_own")), "of_run", ["task_key", "_own"], "_of", block)
    theirs = _blocks(runs, "run_id", ["task_key", "episode_key"], "_rows", block)
    pairs = theirs.join(mine, "task_key").where(F.col("episode_key") != F.col("_own")).drop("_own")
    # a stated number, since adaptive execution would put blocks together by their size, which is small beside what comes of them
    dealt = pairs.repartition(max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.sparkSession.sparkContext.defaultParallelism))
    others = [c for c in runs.columns if c not in ("task_key", "episode_key")]
    each = dealt.select("task_key", "episode_key", "_rows", F.explode("_of.of_run").alias("of_run")).select("task_key", "episode_key", "of_run", F.explode("_rows").alias("_row"))
    return each.select("task_key", *[F.col("_row")[c].alias(c) if c in others else F.col(c) for c in runs.columns if c != "task_key"], "of_run")


def _blocks(rows: DataFrame, id_col: str, keys: Sequence[str], into: str, block: int) -> DataFrame:
    """For each value of the keys, none of them null, its other columns in arrays of about ``block`` rows by a hash of the id."""
    rows = rows.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())
    others = F.struct(*[c for c in rows.columns if c not in keys])
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = rows.select(*keys, F.col(id_col).alias("_id"), others.alias("_row")).join(blocks, list(keys)).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    return dealt.groupBy(*keys, "_block").agg(F.collect_list("_row").alias(into)).drop("_block")

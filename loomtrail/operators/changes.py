"""Changes of rewritten samples: who owns them, in what order they are reviewed, what is left of removed components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = 4096) -> DataFrame:
    """Pairs of intervals with start <= other end and other start <= end, both inclusive, each pair once.

    Intervals are dealt to the buckets that they touch; a pair is taken in the first bucket that both touch.
    """
    deal = lambda rows, p: rows.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in keys], F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_bucket"))
    j = deal(left, "left").join(deal(right, "right"), [*keys, "_bucket"])
    met = (F.col("left_start") <= F.col("right_end")) & (F.col("right_start") <= F.col("left_end"))
    first = F.floor(F.greatest("left_start", "right_start") / bucket) == F.col("_bucket")
    return j.where(met & first).drop("_bucket")


def risk(gate_warning: Column, warnings: Column, recorded: Column) -> Column:
    """3 for a warning that decides, 2 for others, 1 for text that no record explains, else 0."""
    return F.when(gate_warning, 3).when(warnings > 0, 2).when(~recorded, 1).otherwise(0)


def review_order(changes: DataFrame, limit: int = 200, offset: int = 0, **facets: str) -> DataFrame:
    """Changes of the given facets, the riskiest first, then as they stand in the sample."""
    for column, wanted in facets.items():
        changes = changes.where(F.col(column) == wanted)
    ordered = changes.orderBy(F.desc(risk(F.col("gate_warning"), F.size("warnings"), F.col("recorded"))), "sample_id", "position")
    return ordered.offset(max(0, offset)).limit(min(200, max(1, limit)))


def residue(removed: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Removed components (run_id, kind, name) that the rewritten sample still calls or names, with the steps."""
    from .replay import component_trace

    left = component_trace(removed, messages, calls)
    return left.where((F.size("calls") > 0) | (F.size("mentions") > 0))


def merged_steps(removed: DataFrame, kept: DataFrame, share: float = 0.3) -> DataFrame:
    """Removed steps of which at least ``share`` of the distinct words stand in the next kept step: merged into it."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) > 3)
    both = removed.select("sample_id", "step", "text", F.lit(0).alias("_kept")).unionByName(kept.select("sample_id", "step", "text", F.lit(1).alias("_kept")))
    # from the end, a removed step before a kept one of its number
    w = Window.partitionBy("sample_id").orderBy(F.desc("step"), "_kept").rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("_kept") == 1, F.struct(F.col("step").alias("into"), "text")), ignorenulls=True).over(w)
    nearest = both.withColumn("n", following).where("_kept = 0 AND n IS NOT NULL")
    have = F.size(F.array_intersect(words(F.col("text")), words(F.col("n.text"))))
    return nearest.select("sample_id", "step", F.when(have >= share * F.greatest(F.size(words(F.col("text"))), F.lit(1)), F.col("n.into")).alias("merged_into"))


def compaction_points(messages: DataFrame, look_ahead: int = 5) -> DataFrame:
    """Compactions with their summary, which stands up to five messages later; one that repeats the summary before it is
    left out."""
    w = Window.partitionBy("run_id").orderBy("step")
    summary = F.first(F.when(F.col("is_summary"), F.col("text")), ignorenulls=True).over(w.rowsBetween(0, look_ahead))
    points = messages.withColumn("summary", summary).where("compaction OR (is_summary AND NOT coalesce(compaction, false))")
    before = F.lag("summary").over(w)
    return points.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("summary"))).select("run_id", "step", "summary")


def summary_sync(segments: DataFrame) -> DataFrame:
    """Segments with whether the summary that the next one begins with is the one that this one ends with."""
    w = Window.partitionBy("group_key").orderBy("segment")
    following = segments.withColumn("next_summary", F.lead("opening_summary").over(w))
    fold = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    tokens = lambda c: F.split(fold(c), " ")
    shared = F.size(F.array_intersect(tokens("closing_summary"), tokens("next_summary")))
    every = F.size(F.array_union(tokens("closing_summary"), tokens("next_summary")))
    state = F.when(F.col("next_summary").isNull(), F.lit(None)).when(fold("closing_summary") == fold("next_summary"), "same").when(shared / every >= 0.99, "near").otherwise("differs")
    return following.withColumn("sync", state)

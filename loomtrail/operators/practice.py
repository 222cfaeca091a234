"""Counts of what judges and reviewers said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judge_prevalence(summaries: DataFrame, version: Column | None = None) -> DataFrame:
    """(key, runs): in how many runs the judge raised each flag, found a claim without verification, or an outcome that
    doesn't fit. summaries: (run_id, version, flag_counts: map of counts, claims_unverified, consistency); those of another
    version than ``version`` don't count."""
    rows = summaries if version is None else summaries.where(F.col("version") == version)
    flags = F.map_keys(F.map_filter(F.coalesce("flag_counts", F.create_map().cast("map<string,int>")), lambda _, n: n > 0))
    claims = F.when(F.coalesce(F.col("claims_unverified").cast("int"), F.lit(0)) > 0, F.lit("claims_done_unverified"))
    keys = F.concat(flags, F.array_compact(F.array(claims, F.nullif("consistency", F.lit("")))))
    return rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("runs"))


def choice_counts(reviews: DataFrame, columns: Sequence[str] = ("intervention", "attribution")) -> DataFrame:
    """(kind, choice, count): how often reviewers chose each value of some columns, in one pass; none is not a choice."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("choice")) for c in columns])).alias("t")
    return reviews.select(told).select("t.*").where("choice IS NOT NULL AND choice <> ''").groupBy("kind", "choice").agg(F.count("*").alias("count"))


def stale_runs(runs: DataFrame, group: Sequence[str] = ("collection",)) -> DataFrame:
    """Runs of each group that called tools but were imported before their statistics were kept."""
    stale = F.col("tool_stats").isNull() & (F.coalesce("tool_calls", F.lit(0)) > 0)
    return runs.groupBy(*group).agg(F.count("*").alias("runs"), F.count_if(stale).alias("stale"))


def verdict_counts(batches: DataFrame, verdicts: DataFrame, key: str = "batch_id") -> DataFrame:
    """Batches with the number of verdicts on them, 0 too. Verdicts are counted before the join."""
    counts = verdicts.groupBy(key).agg(F.count("*").alias("verdicts"))
    return batches.join(counts, key, "left").fillna(0, ["verdicts"])


def blind_accuracy(reviews: DataFrame, predicted: str = "predicted", grader: str = "grader") -> DataFrame:
    """One row: predictions made before the grader's verdict was shown, how many of them were right, their share."""
    counts = F.col(predicted).isNotNull() & F.col(grader).isin("pass", "fail", "partial")
    sums = reviews.agg(F.count_if(counts).alias("blind"), F.count_if(counts & (F.col(predicted) == F.col(grader))).alias("correct"))
    return sums.withColumn("accuracy", F.when(F.col("blind") > 0, F.round(F.col("correct") / F.col("blind"), 3)))


def failures_in_order(items: DataFrame, layers: Sequence[str] = ("L0", "L1", "L2", "L3"), severities: Sequence[str] = ("block", "high", "medium", "low")) -> DataFrame:
    """Failed checks of each run by layer, within it by severity, then as they came (``nth``): adds ``place`` from 1. What
    isn't in a list comes last."""
    rank = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0).cast("long")), F.lit(len(names) + 1))
    return items.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(rank("layer", layers), rank("severity", severities), "nth")))

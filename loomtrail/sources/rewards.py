"""Reward files of graded runs, and annotations of rewritten samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from .lines import get, read_documents, read_lines


def read_rewards(spark: SparkSession, root: str, label: str, runs_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rewards, errors) of ``root``/work/<task>/reward.json; folders that begin with _ are left out.

    A file that isn't an object or lacks a ledger is an error row, not a failure. A masked reward has r null.
    """
    docs = read_documents(spark, f"{root}/work/*/reward.json").withColumn("task_id", F.regexp_extract("file", "([^/]+)/reward\\.json$", 1)).where("NOT startswith(task_id, '_')")
    ledger = get("value", "ledger", "array<variant>")
    good = docs.where(ledger.isNotNull())
    masked = F.coalesce(get("value", "masked", "boolean"), F.lit(False))
    tier, r = get("value", "tier", "int"), get("value", "R", "double")
    rewards = good.select(
        F.lit(label).alias("label"), "task_id", F.lit(runs_root or root).alias("root"), masked.alias("masked"), tier.alias("tier"), F.when(~masked, r).alias("r"),
        scalars.reward_status(masked, tier, r).alias("status"), get("value", "failed_stage").alias("failed_stage"), get("value", "deck_fault").alias("deck_fault"), get("value", "seconds", "double").alias("seconds"),
        failed_items(ledger).alias("failed"), (get("value", "failed_stage").isNotNull() | (F.size(F.coalesce(get("value", "unknown", "array<variant>"), F.array().cast("array<variant>"))) > 0)).alias("has_errors"),
    )
    errors = docs.where(ledger.isNull()).select("file", "task_id", F.when(F.col("value").isNull(), "not JSON").otherwise("no ledger").alias("error"))
    return rewards, errors


def failed_items(ledger: Column) -> Column:
    """Failed checks but for those that only monitor: id, layer, severity, slides."""
    failed = F.filter(ledger, lambda x: ~F.coalesce(F.try_variant_get(x, "$.pass", "boolean"), F.lit(True)) & (F.coalesce(F.try_variant_get(x, "$.severity", "string"), F.lit("")) != "monitor"))
    field = lambda x, n, k="string": F.try_variant_get(x, f"$.{n}", k).alias(n)
    return F.transform(failed, lambda x: F.struct(field(x, "id"), field(x, "layer"), field(x, "severity"), field(x, "slides", "array<int>")))


def rl_episodes(paths: DataFrame, group_size: int = 16) -> DataFrame:
    """Paths ``…/episodes/g<group>_i<index>_a<attempt>/…`` with step = group // group_size; the latest attempt counts."""
    number = lambda n: F.regexp_extract("path", r"/g(\d+)_i(\d+)_a(\d+)", n).try_cast("long")
    rows = paths.select("*", number(1).alias("group"), number(2).alias("index"), number(3).alias("attempt")).where("group IS NOT NULL")
    latest = rows.groupBy("group", "index").agg(F.max_by(F.struct(*rows.columns), F.struct("attempt", "path")).alias("r")).select("r.*")
    return latest.withColumn("step", F.floor(F.col("group") / group_size))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each annotated sample: status, reason, index map, and its changes as an array. Strict: a bad line raises."""
    rows = read_lines(spark, path, strict=True).where(get("value", "sample_id").isNotNull())
    changes = F.transform(
        F.coalesce(get("value", "changes", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: F.struct(
            F.coalesce(F.try_variant_get(c, "$.message", "int"), F.try_variant_get(c, "$.step", "int")).alias("step"),
            *[F.try_variant_get(c, f"$.{n}", "string").alias(n) for n in ("field", "old", "new", "category", "source", "reason")],
            F.coalesce(F.try_variant_get(c, "$.warnings", "array<string>"), F.array().cast("array<string>")).alias("warnings"),
            F.coalesce(F.try_variant_get(c, "$.refs", "array<string>"), F.array().cast("array<string>")).alias("refs"),
        ),
    )
    return rows.select(get("value", "sample_id").alias("sample_id"), get("value", "status").alias("status"), get("value", "reason").alias("reason"), get("value", "index_map", "array<int>").alias("index_map"), changes.alias("changes"))

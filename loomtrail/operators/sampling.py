"""The daily review queue: a deterministic stratified sample of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: places of each bucket in a queue of twenty, in order of precedence
QUOTAS = (("pair", 6), ("checkpoint", 6), ("suspicious_pass", 4), ("failure", 2), ("random", 2))


def draw(day: str, scope: str = "", id_col: str = "run_id") -> Column:
    """A hash of day, scope and id that orders runs anew every day."""
    return F.xxhash64(F.lit(day), F.lit(scope), F.col(id_col))


def pass_fail_pairs(runs: DataFrame, order: Column | None = None) -> DataFrame:
    """(collection, task_key, passed, failed): of each task with both outcomes the first run of each."""
    key = order if order is not None else F.col("run_id")
    first = lambda outcome: F.min_by(F.when(F.col("outcome").isin(*outcome), F.col("run_id")), F.when(F.col("outcome").isin(*outcome), key))
    paired = runs.where(F.col("task_key").isNotNull()).groupBy("collection", "task_key").agg(first(["pass"]).alias("passed"), first(["fail", "error"]).alias("failed"))
    return paired.where("passed IS NOT NULL AND failed IS NOT NULL")


def daily_queue(runs: DataFrame, day: str, size: int = 20, scope: str = "") -> DataFrame:
    """(run_id, bucket, place): at most ``size`` runs, the same for one day and scope however rows are partitioned.

    Pairs of a task come together, then one run of every collection, suspicious passes, failures in turn by
    outcome, and any others. Each bucket gets its share of the places, unused ones go to the rest. Order is by
    hash, so that it isn't that of a seeded shuffle elsewhere. Only ``size`` rows of each bucket are ranked
    together; nothing is collected.
    """
    known = runs.where(F.coalesce(F.col("role"), F.lit("main")) != "subagent") if "role" in runs.columns else runs
    known = known.withColumn("_draw", draw(day, scope))
    share = {b: max(1, round(size * q / sum(x for _, x in QUOTAS))) for b, q in QUOTAS}
    pairs = pass_fail_pairs(known, F.col("_draw")).orderBy(F.xxhash64(F.lit(day), "collection", "task_key")).limit(share["pair"] // 2)
    parts = [pairs.select(F.explode(F.array("passed", "failed")).alias("run_id"), F.lit("pair").alias("bucket"), F.xxhash64(F.lit(day), "collection", "task_key").alias("rank"))]
    by_collection = known.groupBy("collection").agg(F.min_by("run_id", "_draw").alias("run_id"), F.min("_draw").alias("rank"))
    parts.append(by_collection.orderBy("rank").limit(share["checkpoint"]).select("run_id", F.lit("checkpoint").alias("bucket"), "rank"))
    parts.append(known.where("suspicious").orderBy("_draw", "run_id").limit(share["suspicious_pass"]).select("run_id", F.lit("suspicious_pass").alias("bucket"), F.col("_draw").alias("rank")))
    failed = known.where(F.col("outcome").isin("fail", "error", "partial"))
    kinds = [failed.where(F.col("outcome") == o).orderBy("_draw", "run_id").limit(share["failure"]) for o in ("fail", "error", "partial")]
    in_turn = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("_turn", F.row_number().over(Window.partitionBy("outcome").orderBy("_draw", "run_id")))
    parts.append(in_turn.orderBy("_turn", "outcome").limit(share["failure"]).select("run_id", F.lit("failure").alias("bucket"), F.col("_turn").cast("long").alias("rank")))
    parts.append(known.orderBy("_draw", "run_id").limit(2 * size).select("run_id", F.lit("random").alias("bucket"), F.col("_draw").alias("rank")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    before = F.coalesce(*[F.when(F.col("bucket") == b, i) for i, (b, _) in enumerate(QUOTAS)])
    once = rows.withColumn("_bucket", before).groupBy("run_id").agg(F.min(F.struct("_bucket", "rank", "bucket")).alias("b"))
    w = Window.orderBy("b._bucket", "b.rank", "run_id")  # a few times ``size`` rows
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size).select("run_id", F.col("b.bucket").alias("bucket"), "place")

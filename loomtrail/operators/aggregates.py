"""Aggregations over collections of runs: usage, prevalence, agreement, histograms, rewards, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED = ("fail", "error")
OUTCOMES = ("pass", "partial", "fail", "error", "unknown")


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """a / b rounded, null where b is 0."""
    return F.round(F.when(b != 0, a / b), digits)


def tool_stats(calls: DataFrame) -> DataFrame:
    """(run_id, tool_stats): for each run a map from tool to (calls, errors)."""
    each = calls.groupBy("run_id", "tool").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))
    return each.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", F.struct("calls", "errors"))))).alias("tool_stats"))


def tool_usage(calls: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Usage of each tool: calls, errors, runs, runs that passed and failed, calls a run, error rate, share of
    all runs. ``outcomes`` (run_id, outcome) has all runs; without it those with calls are all."""
    by_run = calls.groupBy("run_id", "tool").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))
    all_runs = outcomes if outcomes is not None else calls.select("run_id").distinct().withColumn("outcome", F.lit("unknown"))
    total = all_runs.agg(F.count("*").alias("total"))
    joined = by_run.join(all_runs, "run_id")
    used = joined.groupBy("tool").agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.count("*").alias("runs"),
        F.count_if(F.col("outcome") == "pass").alias("pass_runs"), F.count_if(F.col("outcome").isin(*FAILED)).alias("fail_runs"),
    )
    return used.join(F.broadcast(total)).select(
        "tool", "calls", "errors", "runs", "pass_runs", "fail_runs",
        ratio(F.col("calls"), F.col("runs")).alias("calls_per_run"), ratio(F.col("errors"), F.col("calls")).alias("error_rate"), ratio(F.col("runs"), F.col("total")).alias("usage_share"),
    )


def error_template_usage(failures: DataFrame, examples: int = 5, top: int = 200) -> DataFrame:
    """(tool, template): occurrences, runs, runs that passed and failed, first examples; the top by runs, then count."""
    by_run = failures.groupBy("tool", "template", "run_id").agg(F.count("*").alias("n"), F.min("outcome").alias("outcome"), F.min("step").alias("step"))
    each = by_run.groupBy("tool", "template").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("runs"), F.count_if(F.col("outcome") == "pass").alias("pass_runs"),
        F.count_if(F.col("outcome").isin(*FAILED)).alias("fail_runs"),
    )
    # a few first runs of each template, ranked in their groups only after runs were summed up
    w = Window.partitionBy("tool", "template").orderBy("run_id")
    first = by_run.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= examples).groupBy("tool", "template").agg(F.sort_array(F.collect_list("run_id")).alias("examples"))
    return each.join(first, ["tool", "template"]).orderBy(F.desc("runs"), F.desc("occurrences"), "tool", "template").limit(top)


def collection_rollup(runs: DataFrame) -> DataFrame:
    """Runs of each collection, heads by outcome, distinct models and episodes."""
    heads = F.col("is_head") if "is_head" in runs.columns else F.lit(True)
    counts = [F.count_if(heads & (F.col("outcome") == o)).alias(o) for o in OUTCOMES]
    return runs.groupBy("collection").agg(F.count("*").alias("runs"), F.count_if(heads).alias("episodes"), *counts, F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def flag_prevalence(runs: DataFrame, flags: Sequence[str], column: str = "flags") -> DataFrame:
    """For each flag, also those never seen: count, share, share of it in passed and in failed runs."""
    all_flags = runs.sparkSession.createDataFrame([(f,) for f in flags], "flag string")
    totals = runs.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "pass").alias("passed"), F.count_if(F.col("outcome").isin(*FAILED)).alias("failed"))
    seen = runs.select("outcome", F.explode(F.array_distinct(column)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "pass").alias("p"), F.count_if(F.col("outcome").isin(*FAILED)).alias("f"))
    joined = all_flags.join(seen, "flag", "left").fillna(0, ["n", "p", "f"]).join(F.broadcast(totals))
    return joined.select("flag", F.col("n").alias("count"), F.coalesce(ratio(F.col("n"), F.col("total")), F.lit(0.0)).alias("share"), ratio(F.col("p"), F.col("passed")).alias("pass_share"), ratio(F.col("f"), F.col("failed")).alias("fail_share"))


def confusion(rows: DataFrame, grader: str = "grader", human: str = "human") -> DataFrame:
    """Counts of grader by human verdicts; rows that no human judged are left out."""
    return rows.where(F.col(human).isNotNull()).groupBy(grader, human).agg(F.count("*").alias("count"))


def agreement(rows: DataFrame, grader: str = "grader", human: str = "human") -> DataFrame:
    """One row: comparable pairs, inflated and deflated ones, disagreement, and the rate of inflated passes among
    all passes that a human judged."""
    g, h = F.col(grader), F.col(human)
    comparable = g.isin("pass", "fail") & h.isin("pass", "fail", "partial")
    sums = rows.agg(
        F.count_if(comparable).alias("comparable"), F.count_if(comparable & (g == "pass") & (h != "pass")).alias("inflated"),
        F.count_if(comparable & (g == "fail") & (h == "pass")).alias("deflated"), F.count_if((g == "pass") & h.isNotNull()).alias("judged_passes"),
    )
    return sums.withColumn("disagreement", ratio(F.col("inflated") + F.col("deflated"), F.col("comparable"))).withColumn("inflated_rate", ratio(F.col("inflated"), F.col("judged_passes")))


def label_counts(reviews: DataFrame, labels: str = "labels", decisive: str = "decisive", severe: str = "severe") -> DataFrame:
    """Labels by how often they are given, and how often decisively and severely."""
    return reviews.select(F.explode(labels).alias("label"), decisive, severe).groupBy("label").agg(F.count("*").alias("count"), F.count_if(F.col(decisive)).alias("decisive"), F.count_if(F.col(severe)).alias("severe"))


def turning_histogram(rows: DataFrame, step: str = "turning_step", steps: str = "steps", bins: int = 10) -> DataFrame:
    """Rows in each of ``bins`` equal parts of a run at which it turns."""
    share = F.least(F.lit(1.0), F.col(step) / F.col(steps))
    return rows.where((F.col(steps) > 0) & F.col(step).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def daily_activity(rows: DataFrame, stamp: str, last_day: Column, days: int = 14) -> DataFrame:
    """Rows a day over the last ``days`` days up to ``last_day``, days without any too. ``last_day`` aggregates rows."""
    calendar = rows.agg(last_day.alias("_last")).select(F.explode(F.sequence(F.date_sub("_last", days - 1), F.col("_last"))).alias("day"))
    counts = rows.groupBy(F.to_date(stamp).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("count"))


def floor_quantile(ordered: Column, q: float) -> Column:
    """The element of a sorted array at floor(q * (n - 1)); null of an empty one."""
    return F.get(ordered, F.floor(F.lit(q) * (F.size(ordered) - 1)).cast("int"))


def floor_quantiles(rows: DataFrame, group: Sequence[str], value: str, quantiles: Sequence[float] = (0.5, 0.9, 1.0)) -> DataFrame:
    """Quantiles by rank, exact at any size: values are counted first, and ranks come from running sums, so that
    no group's values are gathered in one place but for its distinct ones in order."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(value)
    ranked = counted.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    picks = [F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_all") - 1)), F.col(value))).alias(f"p{round(100 * q)}") for q in quantiles]
    return ranked.groupBy(*group).agg(F.max("_all").alias("n"), *picks)


def reward_stats(rewards: DataFrame, group: Sequence[str], r: str = "r", tier: str = "tier") -> DataFrame:
    """Rewards of each group: scored and masked (null, never 0), mean and exact median of those scored, by tier.

    The median is that of ranks over counted values, so that no group's values are gathered in one row."""
    counted = rewards.where(F.col(r).isNotNull()).groupBy(*group, r).agg(F.count("*").alias("_n"))
    ranked = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*group).orderBy(r))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    middle = [F.min(F.when(F.col("_upto") > F.floor((F.col("_all") + more) / 2), F.col(r))) for more in (-1, 0)]
    medians = ranked.groupBy(*group).agg(F.round((middle[0] + middle[1]) / 2, 4).alias("r_median"))
    tiers = [F.count_if((F.col(tier) == t) & F.col(r).isNotNull()).alias(f"tier{t}") for t in range(5)]
    stats = rewards.groupBy(*group).agg(F.count(r).alias("scored"), F.count_if(F.col(r).isNull()).alias("masked"), F.round(F.avg(r), 4).alias("r_mean"), *tiers)
    same = [stats[g].eqNullSafe(medians[g]) for g in group]
    return stats.join(medians, same, "left").select(*[stats[c] for c in stats.columns], "r_median")


def reward_histogram(rewards: DataFrame, r: str = "r", bins: int = 10) -> DataFrame:
    return rewards.where(F.col(r).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(r) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def failed_check_effect(rewards: DataFrame, checks: DataFrame, key: str = "deck", r: str = "r") -> DataFrame:
    """For each failed check: decks (once each), slides, mean reward with and without it, share of scored decks."""
    once = checks.groupBy(key, "check").agg(F.sum("slides").alias("slides"))
    scored = rewards.where(F.col(r).isNotNull()).select(key, r)
    totals = scored.agg(F.count("*").alias("_n"), F.sum(r).alias("_sum"))
    each = once.join(scored, key).groupBy("check").agg(F.count("*").alias("decks"), F.sum("slides").alias("slides"), F.sum(r).alias("_with"))
    n_without = F.col("_n") - F.col("decks")
    return each.join(F.broadcast(totals)).select(
        "check", "decks", "slides", ratio(F.col("_with"), F.col("decks"), 4).alias("r_with"), ratio(F.col("_sum") - F.col("_with"), n_without, 4).alias("r_without"),
        n_without.alias("n_without"), ratio(F.col("decks"), F.col("_n")).alias("share"),
    )


def task_matrix(attempts: DataFrame, task: str = "task_key", column: str = "collection", r: str = "r", columns: Sequence[str] | None = None) -> DataFrame:
    """Task by collection: the best reward of each cell. Attempts without a task are not matched."""
    best = attempts.where(F.col(task).isNotNull()).groupBy(task)
    best = best.pivot(column, list(columns)) if columns else best.pivot(column)
    return best.agg(F.round(F.max(r), 4))


def matrix_spread(attempts: DataFrame, task: str = "task_key", column: str = "collection", r: str = "r") -> DataFrame:
    """For each task that two or more collections scored: best minus worst of their best rewards."""
    best = attempts.where(F.col(task).isNotNull()).groupBy(task, column).agg(F.max(r).alias("best"), F.count("*").alias("attempts"))
    return best.groupBy(task).agg(F.count("best").alias("scored"), F.sum("attempts").alias("attempts"), F.round(F.max("best") - F.min("best"), 4).alias("spread")).where("scored >= 2")


def trained_tokens(messages: DataFrame, tokens: Column, trained: Sequence[str] = ("assistant", "tool")) -> DataFrame:
    """Tokens that a run trains on and gives as context, and the share of the first."""
    is_trained = F.col("role").isin(*trained)
    sums = messages.withColumn("_t", tokens).groupBy("run_id").agg(F.coalesce(F.sum(F.when(is_trained, F.col("_t"))), F.lit(0)).alias("trained_tokens"), F.coalesce(F.sum(F.when(~is_trained, F.col("_t"))), F.lit(0)).alias("context_tokens"))
    total = F.col("trained_tokens") + F.col("context_tokens")
    return sums.withColumn("trained_share", F.coalesce(ratio(F.col("trained_tokens"), total), F.lit(0.0)))


def truncated_endings(messages: DataFrame, trained: Sequence[str] = ("assistant", "tool"), ends_with_call: Column | None = None) -> DataFrame:
    """Runs whose last message but for system and result ones isn't a model turn, or ends with a tool call."""
    turns = messages.where(~F.col("role").isin("system", "result")).withColumn("_call", ends_with_call if ends_with_call is not None else F.lit(False))
    last = messages.select("run_id").distinct().join(turns.groupBy("run_id").agg(F.max_by(F.struct("role", "_call", "step"), "step").alias("last")), "run_id", "left")
    return last.where(F.col("last").isNull() | ~F.col("last.role").isin(*trained) | F.col("last._call")).select("run_id", F.col("last.step").alias("step"), F.col("last.role").alias("role"))


def data_card(runs: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Counts of runs by each facet and in all, in one pass over grouping sets: (facet, value, count)."""
    columns = [F.col(f).cast("string").alias(f) for f in facets]
    picked = runs.select(*columns)
    grouped = picked.groupingSets([[], *[[F.col(f)] for f in facets]], *[F.col(f) for f in facets]).agg(F.count("*").alias("count"), F.grouping_id().alias("_set"))
    facet, value = F.lit("all"), F.lit(None).cast("string")
    n = len(facets)
    for i, f in enumerate(facets):
        own = F.col("_set") == (1 << n) - 1 - (1 << (n - 1 - i))
        facet, value = F.when(own, F.lit(f)).otherwise(facet), F.when(own, F.col(f)).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "count")


def reward_labels(rewards: DataFrame) -> DataFrame:
    """Imported reward sets: decks, masked ones, latest import, and the one root or else the folder above the first."""
    roots = F.when(F.countDistinct("root") == 1, F.min("root")).otherwise(F.regexp_replace(F.min("root"), "/[^/]*$", ""))
    return rewards.groupBy("label").agg(F.count("*").alias("decks"), F.count_if("masked").alias("masked"), F.max("imported_at").alias("imported_at"), roots.alias("root"))


def component_usage(traces: DataFrame, top: int = 60) -> DataFrame:
    """Components (kind, name) over runs: runs that have one, call one, name one or do either; one count a run."""
    used, named = F.size("calls") > 0, F.size("mentions") > 0
    each = traces.groupBy("kind", "name", "run_id").agg(F.bool_or(used).alias("c"), F.bool_or(named).alias("m"))
    sums = each.groupBy("kind", "name").agg(F.count("*").alias("present"), F.count_if("c").alias("called"), F.count_if("m").alias("named"), F.count_if(F.col("c") | F.col("m")).alias("any_use"))
    return sums.orderBy(F.desc("any_use"), F.desc("present"), "kind", "name").limit(top)


def phase_shares(steps: DataFrame, phase: str = "phase") -> DataFrame:
    """(run_id, phase, steps, share) of steps by the phase that they are in."""
    total = F.sum("steps").over(Window.partitionBy("run_id"))
    return steps.where(F.col(phase).isNotNull()).groupBy("run_id", F.col(phase).alias("phase")).agg(F.count("*").alias("steps")).withColumn("share", F.round(F.col("steps") / total, 3))

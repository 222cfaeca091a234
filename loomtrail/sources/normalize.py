"""From the parts of transcripts to the tables messages, tool_calls and runs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.sequences import context_track

# fixed values: how a compaction summary and a reminder begin
COMPACTION_PREFIXES = ("This session is being continued from a previous conversation", "<conversation_summary>", "<summary>")
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>"


class Transcripts(NamedTuple):
    """messages (run_id, step, role, text, thinking, ...), tool_calls (run_id, call_index, step, call_id, tool, input,
    result_text, is_error, ...) and runs (run_id, ...)."""

    messages: DataFrame
    tool_calls: DataFrame
    runs: DataFrame


def number_steps(messages: DataFrame, order: list[str]) -> DataFrame:
    return messages.withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))


def merge_results(results: DataFrame) -> DataFrame:
    """Several results of one call as one: texts joined in order, an error if any is one."""
    place = F.struct("place", "text")
    return results.groupBy("run_id", "call_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), "\n").alias("result_text"), F.bool_or("is_error").alias("told_error")
    )


def pair_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results by id, in whatever order both come. Without a told flag the text decides whether
    the call failed; a call without a result has null text and no error."""
    joined = calls.join(merge_results(results), ["run_id", "call_id"], "left")
    inferred = F.when(F.col("told_error").isNull(), scalars.tool_error(F.col("result_text")))
    return joined.withColumn("is_error", F.coalesce("told_error", inferred, F.lit(False))).withColumn("error_inferred", F.coalesce(inferred, F.lit(False))).drop("told_error")


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """How many results each run has without a call."""
    return results.join(calls.select("run_id", "call_id").distinct(), ["run_id", "call_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("orphan_results"))


def promote_roles(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """User turns of nothing but reminders become system ones; assistant turns with nothing but calls become tool turns."""
    with_calls = calls.select("run_id", "step").distinct().withColumn("_calls", F.lit(True))
    reminder = (F.col("role") == "user") & F.col("text").rlike("<system-reminder>") & (F.trim(F.regexp_replace("text", REMINDER, "")) == "")
    silent = (F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) == "") & F.col("_calls")
    joined = messages.join(with_calls, ["run_id", "step"], "left")
    return joined.withColumn("role", F.when(reminder, "system").when(silent, "tool").otherwise(F.col("role"))).drop("_calls")


def instructions(messages: DataFrame) -> DataFrame:
    """(run_id, instruction): the first user text that is more than reminders and no compaction summary."""
    said = F.trim(F.regexp_replace("text", REMINDER, ""))
    summary = F.lit(False)
    for prefix in COMPACTION_PREFIXES:
        summary = summary | said.startswith(prefix)
    users = messages.where(F.col("role") == "user").withColumn("_said", said).where(F.col("_said") != "").where(~summary)
    return users.groupBy("run_id").agg(F.min_by("_said", "step").alias("instruction"))


def title(instruction: Column) -> Column:
    """The first line of four characters or more, without heading marks, up to 120."""
    lines = F.transform(F.split(instruction, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[#\s]+", "")))
    return F.substring(F.get(F.filter(lines, lambda x: F.length(x) >= 4), F.lit(0)), 1, 120)


def offsets(messages: DataFrame) -> DataFrame:
    """offset_ms from the run's first stamp, never below 0."""
    origin = F.min("stamp_ms").over(Window.partitionBy("run_id"))
    return messages.withColumn("offset_ms", F.when(F.col("stamp_ms").isNotNull(), F.greatest(F.lit(0), F.col("stamp_ms") - origin)))


def metrics(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Counts of steps, calls, errors and turns by role, longest gap between adjacent stamped steps, wall time."""
    gap = F.col("offset_ms") - F.lag("offset_ms").over(Window.partitionBy("run_id").orderBy("step"))
    by_run = messages.withColumn("_gap", gap).groupBy("run_id").agg(
        F.count("*").alias("steps"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role").isin("assistant", "tool")).alias("model_turns"),
        F.max("_gap").alias("longest_gap_ms"), F.max("offset_ms").alias("duration_ms"),
    )
    by_calls = calls.groupBy("run_id").agg(F.count("*").alias("tool_calls"), F.count_if("is_error").alias("tool_errors"), F.countDistinct("tool").alias("tools"))
    return by_run.join(by_calls, "run_id", "left").fillna(0, ["tool_calls", "tool_errors", "tools"])


def context_estimates(messages: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Messages with the estimated tokens before them; context_tokens measures, compaction empties the context. A message
    weighs its text, thinking and images, and with ``calls`` also the arguments and results of its calls."""
    tokens = lambda c: scalars.estimate_tokens(F.coalesce(c, F.lit("")))
    images = lambda d: scalars.IMAGE_TOKENS * F.coalesce("images", F.lit(0)) if "images" in d.columns else F.lit(0)
    size = tokens("text") + tokens("thinking") + images(messages)
    if calls is None:
        return context_track(messages, size, F.coalesce("compaction", F.lit(False)), F.col("context_tokens"))
    of_calls = calls.groupBy("run_id", "step").agg(F.sum(tokens("input") + tokens("result_text") + images(calls)).alias("_of_calls"))
    weighed = messages.join(of_calls, ["run_id", "step"], "left")
    return context_track(weighed, size + F.coalesce("_of_calls", F.lit(0)), F.coalesce("compaction", F.lit(False)), F.col("context_tokens")).drop("_of_calls")


def context_summary(estimates: DataFrame) -> DataFrame:
    """(run_id, context_peak, measured_steps, compactions): the peak is of measured sizes where there are, else of estimates;
    null if nothing was ever in the context."""
    peak = F.max(F.coalesce("context_tokens", "estimate"))
    return estimates.groupBy("run_id").agg(F.when(peak > 0, peak).alias("context_peak"), F.count("context_tokens").alias("measured_steps"), F.count_if(F.coalesce("compaction", F.lit(False))).alias("compactions"))


def readiness(messages: DataFrame, calls: DataFrame, orphans: DataFrame | None = None, max_tokens: int = 262_144) -> DataFrame:
    """Whether a run can be trained on: trained and context tokens, and the issues with their steps.

    Trained are assistant and tool turns (text, thinking, arguments); anything else is context. Blocking are runs
    that are too long, end in a call or in no model turn, have calls without results, results without calls, or
    arguments that aren't JSON. A final call without a result is the truncated ending only.
    """
    tokens = lambda c: scalars.estimate_tokens(F.coalesce(c, F.lit("")))
    trained = F.col("role").isin("assistant", "tool")
    images = scalars.IMAGE_TOKENS * F.coalesce("images", F.lit(0)) if "images" in messages.columns else F.lit(0)
    turns = ~F.col("role").isin("system", "result")
    of_messages = messages.groupBy("run_id").agg(
        F.sum(F.when(trained, tokens("text") + tokens("thinking") + images).otherwise(0)).alias("_trained"),
        F.sum(F.when(~trained, tokens("text") + images).otherwise(0)).alias("_context"),
        F.max_by(F.struct("step", "role"), F.when(turns, F.col("step"))).alias("_last"),
    )
    bad = F.ltrim("input").rlike(r"^[{\[]") & F.try_parse_json("input").isNull()
    last_step = of_messages.select("run_id", F.col("_last.step").alias("_last_step"))
    of_calls = calls.join(last_step, "run_id").groupBy("run_id").agg(
        F.sum(tokens("input")).alias("_arguments"), F.sum(tokens("result_text")).alias("_results"),
        F.array_sort(F.collect_set(F.when(bad, F.col("step")))).alias("_bad"),
        F.array_sort(F.collect_set(F.when(F.col("result_text").isNull() & (F.col("step") != F.col("_last_step")), F.col("step")))).alias("_unpaired"),
        F.bool_or(F.col("step") == F.col("_last_step")).alias("_ends_in_call"),
    )
    empty = F.array().cast("array<int>")
    j = of_messages.join(of_calls, "run_id", "left")
    j = j.join(orphans, "run_id", "left") if orphans is not None else j.withColumn("orphan_results", F.lit(0))
    j = j.withColumn("trained_tokens", F.col("_trained") + F.coalesce("_arguments", F.lit(0))).withColumn("context_tokens", F.col("_context") + F.coalesce("_results", F.lit(0)))
    total = F.col("trained_tokens") + F.col("context_tokens")
    j = j.withColumn("tokens", total).withColumn("trained_share", F.coalesce(F.round(F.when(total > 0, F.col("trained_tokens") / total), 3), F.lit(0.0)))
    ends_badly = F.col("_last").isNull() | ~F.col("_last.role").isin("assistant", "tool") | F.coalesce("_ends_in_call", F.lit(False))

    def issue(when: Column, key: str, steps: Column, severity: str = "block") -> Column:
        return F.when(when, F.struct(F.lit(key).alias("key"), F.slice(steps, 1, 50).alias("steps"), F.lit(severity).alias("severity")))

    last = F.when(F.col("_last").isNotNull(), F.array(F.col("_last.step").cast("int"))).otherwise(empty)
    issues = F.array_compact(
        F.array(
            issue(total > max_tokens, "too_long", empty),
            issue(ends_badly, "truncated_end", last),
            issue(F.size("_unpaired") > 0, "unpaired_calls", F.col("_unpaired").cast("array<int>")),
            issue(F.coalesce("orphan_results", F.lit(0)) > 0, "orphan_results", empty),
            issue(F.size("_bad") > 0, "bad_arguments", F.col("_bad").cast("array<int>")),
            issue((total > 0) & (F.col("trained_share") < 0.05), "low_trained_share", empty, "warn"),
        )
    )
    j = j.withColumn("issues", issues).withColumn("ready", ~F.exists("issues", lambda x: x["severity"] == "block"))
    return j.select("run_id", "tokens", "trained_tokens", "context_tokens", "trained_share", "ready", "issues")


def request_times(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages without a stamp get that of the request that they answer: the one sent with as many messages as stand
    before them. requests: (run_id, message_count, stamp_ms)."""
    answered = requests.select("run_id", (F.col("message_count") + 1).alias("step"), F.col("stamp_ms").alias("_asked")).groupBy("run_id", "step").agg(F.min("_asked").alias("_asked"))
    joined = messages.join(answered, ["run_id", "step"], "left")
    return joined.withColumn("stamp_ms", F.coalesce("stamp_ms", "_asked")).drop("_asked")

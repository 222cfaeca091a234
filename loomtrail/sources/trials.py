"""Trials: documents of steps, dialogs with results, runs with attempts, and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import chat, normalize
from .lines import content_images, content_text, get, read_documents, read_lines, run_id
from .normalize import Transcripts

# fixed values: why a run ended without a score, as name: (status, kind)
FAILURES = {
    "evaluation_failed": ("fail", "agent"), "artifact_invalid": ("fail", "agent"), "failed": ("fail", "agent"), "reward_zero": ("fail", "agent"),
    "agent_execution_failed": ("error", "agent"), "agent_timeout": ("fail", "budget"), "timeout": ("fail", "budget"), "output_limit": ("fail", "budget"),
    "direct_execution_failed": ("error", "agent"), "cancelled": ("error", "infra"), "config_invalid": ("error", "infra"), "promotion_failed": ("error", "infra"),
    "process_failed": ("error", "infra"), "orchestration_failed": ("error", "infra"), "worker_launch_failed": ("error", "infra"), "runtime_setup_failed": ("error", "infra"),
    "runtime_cleanup_failed": ("error", "infra"), "runtime_record_failed": ("error", "infra"), "workspace_commit_uncertain": ("error", "infra"),
    "candidate_failure": ("fail", "agent"), "candidate_contract_violation": ("fail", "agent"), "evaluator_failure": ("error", "grader"), "infrastructure_failure": ("error", "infra"),
    "NonZeroAgentExitCodeError": ("error", "agent"), "AgentTimeoutError": ("fail", "budget"), "ContextLengthExceededError": ("fail", "budget"), "ContextWindowExceededError": ("fail", "budget"),
    "OutputLengthExceededError": ("fail", "budget"), "OutputTokenExceededError": ("fail", "budget"), "VerifierTimeoutError": ("error", "grader"), "VerifierOutputParseError": ("error", "grader"),
    "RewardFileNotFoundError": ("error", "grader"), "RewardFileEmptyError": ("error", "grader"), "DownloadVerifierDirError": ("error", "grader"), "AddTestsDirError": ("error", "grader"),
    "AgentSetupTimeoutError": ("error", "infra"), "EnvironmentStartTimeoutError": ("error", "infra"), "SandboxBuildFailedError": ("error", "infra"), "SandboxLikelyOutOfMemoryError": ("error", "infra"),
    "MemoryLimitExceededError": ("error", "infra"), "GKEExecStreamClosedError": ("error", "infra"), "HealthcheckError": ("error", "infra"), "RuntimeRequestError": ("error", "infra"),
    "NetworkConnectionError": ("error", "infra"), "ModelNotFoundError": ("error", "infra"), "AgentAuthenticationError": ("error", "infra"), "AuthenticationError": ("error", "infra"),
    "AgentSafetyRefusalError": ("error", "agent"),
}


def classify_failure(*names: Column) -> Column:
    """struct(name, status, kind, infra): what names of exceptions or classifications mean, the most telling given first; null if all
    are null or blank.

    The first that is known decides, an error of an API among them. If none is, a classification that stands in one of them names the
    failure, else the shortest one does, and what they say tells whether the infrastructure is to blame. infra is null where a crashed
    agent may be either's doing, or where nothing is known.
    """
    table = F.create_map(*[x for k, (s, kind) in FAILURES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("status"), F.lit(kind).alias("kind")))])
    told = F.filter(F.array(*[F.trim(n) for n in names]), lambda n: n.isNotNull() & (n != ""))
    embedded = lambda n: F.regexp_extract(n, r"classification=['\"]?([a-z_]+)", 1)
    keys = F.transform(told, lambda n: F.when(embedded(n) != "", embedded(n)).otherwise(n))
    key = F.get(F.filter(keys, lambda k: F.map_contains_key(table, k) | k.rlike("^Api.*Error$")), F.lit(0))
    classified = F.get(F.filter(F.transform(told, embedded), lambda e: e != ""), F.lit(0))
    shortest = F.array_min(F.transform(told, lambda n, at: F.struct(F.length(n).alias("size"), at.alias("at"), n.alias("name"))))["name"]
    name = F.coalesce(key, classified, shortest)
    known = F.when(key.isNotNull(), table[name])
    status = F.coalesce(known["status"], F.lit("error"))
    unknown = F.when(key.isNull() & classified.isNull() & F.exists(told, lambda n: scalars.infra_failure(n)), "infra")
    kind = F.coalesce(known["kind"], F.when(key.isNotNull(), "infra"), unknown)
    infra = F.when(kind.isin("infra", "grader"), True).when((kind == "budget") | ((kind == "agent") & (status == "fail")), False)
    return F.when(F.size(told) > 0, F.struct(F.substring(name, 1, 120).alias("name"), status.alias("status"), kind.alias("kind"), infra.alias("infra")))


def trial_outcome(score: Column, failure: Column) -> Column:
    """struct(status, score, reason, infra): a score of 0 beside a crash is no score."""
    crashed = failure.isNotNull() & ~F.coalesce(failure["kind"] == "budget", F.lit(False))
    valid = F.when(crashed & (F.coalesce(score, F.lit(0.0)) <= 0), F.lit(None).cast("double")).otherwise(score)
    status = F.when(valid.isNotNull(), scalars.score_status(valid)).otherwise(F.coalesce(failure["status"], F.lit("unknown")))
    return F.struct(status.alias("status"), valid.alias("score"), failure["name"].alias("reason"), failure["infra"].alias("infra"))


def read_step_documents(spark: SparkSession, path: str | list[str], results: DataFrame | None = None) -> Transcripts:
    """Documents with a list of steps; embedded documents of subagents are runs of their own.

    ``results`` (folder, reward, exception) of ``read_verifier_results`` give outcomes to documents of their folder.
    """
    docs = read_documents(spark, path).where(get("value", "steps", "array<variant>").isNotNull())
    own = docs.select("file", F.lit(None).cast("string").alias("parent_key"), "value")
    inner = docs.select("file", get("value", "trajectory_id").alias("parent_key"), F.explode(get("value", "subagent_trajectories", "array<variant>")).alias("value"))
    every = own.unionByName(inner).withColumn("self_key", F.coalesce(get("value", "trajectory_id"), get("value", "session_id")))
    every = every.withColumn("run_id", run_id(F.col("file"), F.when(F.col("parent_key").isNotNull(), F.col("self_key"))))
    steps = every.select("run_id", F.posexplode(get("value", "steps", "array<variant>")).alias("at", "s")).withColumn("step", F.col("at") + 1)
    source = get("s", "source")
    content = get("s", "message", "variant")
    messages = steps.select(
        "run_id", "step", F.when(source == "agent", "assistant").otherwise(source).alias("role"), content_text(content).alias("text"), F.coalesce(get("s", "reasoning_content"), F.lit("")).alias("thinking"),
        F.size(content_images(content)).alias("images"), scalars.timestamp_ms(get("s", "timestamp")).alias("stamp_ms"), get("s", "metrics.prompt_tokens", "long").alias("context_tokens"), F.lit(False).alias("compaction"),
    )
    made = steps.select("run_id", "step", F.posexplode(get("s", "tool_calls", "array<variant>")).alias("nth", "c"))
    calls = made.select(
        "run_id", "step", get("c", "tool_call_id").alias("call_id"), F.element_at(F.split(get("c", "function_name"), "__"), -1).alias("tool"), get("c", "function_name").alias("raw_name"),
        F.coalesce(F.to_json(get("c", "arguments", "variant")), F.lit("")).alias("input"), F.row_number().over(Window.partitionBy("run_id").orderBy("step", "nth")).alias("call_index"),
    )
    seen = steps.select("run_id", "step", F.posexplode(get("s", "observation.results", "array<variant>")).alias("nth", "r"))
    results_of = seen.select("run_id", get("r", "source_call_id").alias("call_id"), F.struct("step", "nth").alias("place"), content_text(get("r", "content", "variant")).alias("text"), get("r", "extra.is_error", "boolean").alias("is_error")).where("call_id IS NOT NULL")
    paired = normalize.pair_calls(calls, results_of)
    runs = every.select("run_id", "file", F.regexp_replace("file", "/[^/]*$", "").alias("folder"), "self_key", "parent_key", get("value", "agent.name").alias("agent"), get("value", "agent.model_name").alias("model"), F.when(F.col("parent_key").isNotNull(), "subagent").otherwise("main").alias("role"))
    if results is not None:
        runs = runs.join(results, "folder", "left").withColumn("outcome", F.when(F.col("role") == "main", trial_outcome(F.col("reward"), classify_failure(F.col("exception")))))
    runs = runs.join(normalize.instructions(messages), "run_id", "left").withColumn("title", normalize.title(F.col("instruction")))
    return Transcripts(normalize.offsets(normalize.promote_roles(messages, paired)), paired, runs)


def read_verifier_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(folder, task_name, reward, exception) of result files."""
    docs = read_documents(spark, path)
    rewards = F.map_values(get("value", "verifier_result.rewards", "map<string,double>"))
    return docs.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder"), get("value", "task_name").alias("task_name"), F.coalesce(get("value", "verifier_result.rewards.reward", "double"), F.get(rewards, F.lit(0))).alias("reward"), get("value", "exception_info.exception_type").alias("exception"))


def read_dialog_trials(spark: SparkSession, dialogs: str | list[str], results: str | list[str]) -> Transcripts:
    """Chat samples of which the verdict stands in the results file of their folder, shared by all of its samples."""
    t = chat.read_chat(spark, dialogs)
    found = read_documents(spark, results).select(F.regexp_replace("file", "/[^/]*$", "").alias("folder"), F.get(get("value", "results", "array<variant>"), F.lit(0)).alias("r"))
    verdict = found.select(
        "folder", get("r", "task_id").alias("task_id"), F.coalesce(get("r", "average_score", "double"), get("r", "is_resolved", "boolean").cast("double")).alias("verdict_score"),
        F.coalesce(get("r", "extra_info.exception.exception_type"), F.nullif(get("r", "failure_mode"), F.lit("unset"))).alias("exception"),
    )
    runs = t.runs.withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")).join(verdict, "folder", "left")
    return t._replace(runs=runs.withColumn("outcome", trial_outcome(F.col("verdict_score"), classify_failure(F.nullif(F.col("exception"), F.lit("none"))))))


def attempt_states(observations: DataFrame) -> DataFrame:
    """States of an artifact in order of time, those with the hash of the one before left out.

    observations: (run_id, received_offset_ms, artifact_sha256, size_bytes).
    """
    w = Window.partitionBy("run_id").orderBy("received_offset_ms")
    changed = ~F.lag("artifact_sha256").over(w).eqNullSafe(F.col("artifact_sha256"))
    return observations.withColumn("_changed", changed).where("_changed").drop("_changed").withColumn("state", F.row_number().over(w))


def read_attempts(spark: SparkSession, root: str) -> DataFrame:
    """(run, sequence, event_type, classification, ...): each run folder with its last terminal event.

    The last event of a kind decides; runs without one have null.
    """
    events = read_lines(spark, f"{root}/*/events.jsonl").withColumn("run", F.regexp_extract("file", "([^/]+)/events\\.jsonl$", 1))
    rows = events.select("run", get("value", "sequence", "long").alias("sequence"), get("value", "event_type").alias("event_type"), get("value", "payload", "variant").alias("payload"))
    terminal = F.col("event_type").rlike("(?i)terminal|completed|failed|finished")
    last = rows.groupBy("run").agg(F.count("*").alias("events"), F.max(F.when(terminal, F.struct("sequence", "event_type", F.coalesce(get("payload", "classification"), get("payload", "reason")).alias("classification")))).alias("last"))
    return last.select("run", "events", F.col("last.event_type").alias("event_type"), F.col("last.classification").alias("classification"), trial_outcome(F.lit(None).cast("double"), classify_failure(F.col("last.classification"))).alias("outcome"))

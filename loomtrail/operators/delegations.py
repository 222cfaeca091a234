"""Work that a run hands to others, what hooks tell it, and the steps at which it reacts to either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import found_terms
from .sequences import next_steps

# fixed values: tools that hand over work, what says that a report comes later and under which name, briefs that can't be
# read, shortest hook text, characters of guidance that are kept
DELEGATING = ("Agent", "Task", "spawn_agent")
LAUNCHED = r"Async agent launched[\s\S]{0,400}?agentId:\s*(\w+)|Async agent launched"
TASK_NAME, ENCRYPTED = r'"task_name"\s*:\s*"([^"]+)"', r"^gAAAA[\w-]{20,}"
HOOK_CHARS, GUIDANCE_CHARS = 30, 60_000
_AGENT = ("assistant", "tool")


def _said(*values: Column) -> Column:
    """The first of some texts that isn't null or empty, else an empty one."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def delegations(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """(run_id, step, call_id, tool, subagent_type, description, brief, brief_encrypted, result, result_step, next_steps): each call that
    hands over work, with the report and the first two agent steps that could know it.

    calls: (run_id, step, call_id, tool, input, result_text, spawned); messages: (run_id, step, role, text). A call whose result
    only says that it was launched has its report in the first later system or user message that holds its agent's id or task
    name; without one it has none. Names are looked for by an automaton of those of a run, so that each message is read once.
    """
    value = F.try_parse_json("input")
    field = lambda name: F.try_variant_get(value, f"$.{name}", "string")
    result = F.coalesce("result_text", F.lit(""))
    brief = _said(field("prompt"), field("message"))
    later = result.rlike(LAUNCHED) | F.ltrim(result).startswith('{"task_name"')
    handle = _said(F.regexp_extract(result, LAUNCHED, 1), F.regexp_extract(result, TASK_NAME, 1), field("task_name"))
    made = calls.where(F.element_at(F.split("tool", "__"), -1).isin(*DELEGATING) | F.col("spawned").isNotNull()).select(
        "run_id", "step", "call_id", "tool", _said(field("subagent_type"), field("agent_type")).alias("subagent_type"), _said(field("description"), field("task_name")).alias("description"),
        F.when(brief.rlike(ENCRYPTED), "").otherwise(brief).alias("brief"), brief.rlike(ENCRYPTED).alias("brief_encrypted"), result.alias("_result"), later.alias("_later"), F.when(later, handle).otherwise("").alias("_handle"),
    )
    told = messages.where(F.col("role").isin("system", "user")).select("run_id", "step", F.lit("text").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    hits = found_terms(told, made.where("_handle <> ''").select("run_id", F.col("_handle").alias("term")))
    # calls and hits of a name by step from the end: a hit at the step of the call stands behind it
    met = hits.select("run_id", F.col("term").alias("_handle"), "step", F.lit(0).alias("_call"), F.lit(None).cast(made.schema["call_id"].dataType).alias("call_id"))
    asked = made.where("_handle <> ''").select("run_id", "_handle", F.col("step").cast("long").alias("step"), F.lit(1).alias("_call"), "call_id")
    from_end = Window.partitionBy("run_id", "_handle").orderBy(F.desc("step"), F.desc("_call")).rowsBetween(Window.unboundedPreceding, -1)
    reports = asked.unionByName(met).withColumn("_report", F.last(F.when(F.col("_call") == 0, F.col("step")), ignorenulls=True).over(from_end)).where("_call = 1")
    made = made.join(reports.select("run_id", "step", "call_id", "_report"), ["run_id", "step", "call_id"], "left")
    made = made.withColumn("result_step", F.when(F.col("_later"), F.col("_report")).otherwise(F.col("step").cast("long")))
    onward = next_steps(messages.select("run_id", F.col("step").cast("long").alias("step"), "role", "text"), F.col("role").isin(*_AGENT))
    known = onward.select("run_id", F.col("step").alias("result_step"), F.coalesce("text", F.lit("")).alias("_text"), "next_steps")
    joined = made.join(known, ["run_id", "result_step"], "left")
    return joined.select(
        "run_id", "step", "call_id", "tool", "subagent_type", "description", "brief", "brief_encrypted",
        F.when(~F.col("_later"), F.col("_result")).otherwise(F.coalesce("_text", F.lit(""))).alias("result"), "result_step", F.coalesce("next_steps", F.array().cast("array<bigint>")).alias("next_steps"),
    )


def hook_events(messages: DataFrame) -> DataFrame:
    """(run_id, step, text, next_step): what hooks told a run, (messages with ``layer``), and the agent step that follows."""
    onward = next_steps(messages.select("run_id", "step", "role", "layer", "text"), F.col("role").isin(*_AGENT), 1)
    return onward.where((F.col("layer") == "hook") & (F.length("text") >= HOOK_CHARS)).select("run_id", "step", "text", F.get("next_steps", F.lit(0)).alias("next_step"))


def harness_text(messages: DataFrame, wrapped: DataFrame, compaction_prefix: str) -> DataFrame:
    """(run_id, guidance): what a run was told by its harness, (run_id, wrapped) first, then its system messages that are instructions or
    from hooks or stand in the first two steps, but for compactions; cut to the first characters, as pieces are put together.
    """
    system = messages.where((F.col("role") == "system") & (F.coalesce(F.col("layer").isin("instruction", "hook"), F.lit(False)) | (F.col("step") <= 2)) & (F.length("text") > 0) & ~F.col("text").startswith(compaction_prefix))
    # pieces that begin behind the last character that is kept don't leave their task
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    kept = system.withColumn("_before", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))).where(F.col("_before") < GUIDANCE_CHARS)
    pieces = kept.select("run_id", F.struct(F.col("step").cast("long").alias("step"), F.substring("text", 1, GUIDANCE_CHARS).alias("text")).alias("p"))
    pieces = pieces.unionByName(wrapped.where("wrapped <> ''").select("run_id", F.struct(F.lit(-1).cast("long").alias("step"), F.substring("wrapped", 1, GUIDANCE_CHARS).alias("text")).alias("p")))
    joined = pieces.groupBy("run_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return joined.select("run_id", F.substring(F.array_join(F.transform("p", lambda p: p["text"]), "\n\n"), 1, GUIDANCE_CHARS).alias("guidance"))

"""Session files of stream-json rows, and rollout files of typed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import timestamp_ms
from . import normalize
from .lines import content_images, content_text, get, is_text, read_lines, run_id
from .normalize import Transcripts


def _blocks(content: Column) -> Column:
    return F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))


def _of_type(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == kind)


def read_sessions(spark: SparkSession, path: str | list[str]) -> Transcripts:
    """One run for each file. Assistant rows that share a message id are one step; tool results come in user rows;
    attachments are system steps; a compaction boundary empties the context."""
    lines = read_lines(spark, path).withColumn("run_id", run_id(F.col("file"))).withColumn("type", get("value", "type"))
    rows = lines.where(F.col("type").isin("user", "assistant", "attachment", "system", "result"))
    content = F.coalesce(get("value", "message.content", "variant"), get("value", "attachment.content", "variant"), get("value", "content", "variant"), get("value", "result", "variant"))
    rows = rows.withColumn("content", content).withColumn("blocks", _blocks(F.col("content"))).withColumn("message_id", get("value", "message.id")).withColumn("stamp_ms", timestamp_ms(get("value", "timestamp")))
    w = Window.partitionBy("run_id").orderBy("place")
    only_results = (F.col("type") == "user") & (F.size("blocks") > 0) & F.forall("blocks", lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result")
    results = rows.select("run_id", "place", F.explode(_of_type(F.col("blocks"), "tool_result")).alias("b")).select(
        "run_id", get("b", "tool_use_id").alias("call_id"), "place", content_text(get("b", "content", "variant")).alias("text"), get("b", "is_error", "boolean").alias("is_error")
    )
    shown = rows.where(~only_results)
    # rows of one message follow each other: a step begins where the message id changes
    same = F.col("message_id").isNotNull() & F.coalesce(F.lag("message_id").over(w) == F.col("message_id"), F.lit(False))
    shown = shown.withColumn("step", F.sum((~same).cast("int")).over(w))
    text = F.when(is_text(F.col("content")), F.try_variant_get("content", "$", "string")).otherwise(content_text(F.col("content")))
    thinking = F.array_join(F.transform(_of_type(F.col("blocks"), "thinking"), lambda b: F.try_variant_get(b, "$.thinking", "string")), "\n")
    role = F.when(F.col("type").isin("attachment", "system"), "system").otherwise(F.col("type"))
    used = sum((F.coalesce(get("value", f"message.usage.{k}", "long"), F.lit(0)) for k in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")), F.lit(0))
    parts = shown.select(
        "run_id", "step", "place", role.alias("role"), text.alias("text"), thinking.alias("thinking"), F.size(content_images(F.col("content"))).alias("images"), "stamp_ms",
        F.when(get("value", "message.usage", "variant").isNotNull(), used).alias("context_tokens"), F.coalesce(get("value", "subtype") == "compact_boundary", F.lit(False)).alias("compaction"), "blocks",
    )
    joined = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c]), lambda x: x != ""), "\n")
    messages = parts.groupBy("run_id", "step").agg(
        F.min_by("role", "place").alias("role"), joined("text").alias("text"), joined("thinking").alias("thinking"), F.sum("images").cast("int").alias("images"),
        F.min("stamp_ms").alias("stamp_ms"), F.max("context_tokens").alias("context_tokens"), F.bool_or("compaction").alias("compaction"),
    )
    made = parts.select("run_id", "step", "place", F.posexplode(_of_type(F.col("blocks"), "tool_use")).alias("nth", "b"))
    calls = made.select(
        "run_id", "step", get("b", "id").alias("call_id"), F.element_at(F.split(get("b", "name"), "__"), -1).alias("tool"), get("b", "name").alias("raw_name"),
        F.coalesce(F.to_json(get("b", "input", "variant")), F.lit("")).alias("input"), F.row_number().over(Window.partitionBy("run_id").orderBy("place", "nth")).alias("call_index"),
    )
    paired = normalize.pair_calls(calls, results)
    runs = lines.groupBy("run_id", "file").agg(F.min_by(get("value", "sessionId"), "place").alias("self_key"), F.max(get("value", "message.model")).alias("model"), F.max(get("value", "version")).alias("version"), F.max(get("value", "totalCostUSD", "double")).alias("cost_usd"))
    runs = runs.join(normalize.instructions(messages), "run_id", "left").withColumn("title", normalize.title(F.col("instruction")))
    return Transcripts(normalize.offsets(normalize.promote_roles(messages, paired)), paired, runs)


def read_rollouts(spark: SparkSession, path: str | list[str]) -> Transcripts:
    """One run for each file. Reasoning belongs to the next assistant item or call; calls and outputs pair by id."""
    lines = read_lines(spark, path).withColumn("run_id", run_id(F.col("file"))).withColumn("type", get("value", "type")).withColumn("p", get("value", "payload", "variant"))
    lines = lines.withColumn("kind", get("p", "type")).withColumn("stamp_ms", timestamp_ms(get("value", "timestamp")))
    items = lines.where((F.col("type") == "response_item") | (F.col("type") == "compacted"))
    call_kinds, output_kinds = ("function_call", "custom_tool_call"), ("function_call_output", "custom_tool_call_output")
    output = F.col("p").isNotNull() & F.col("kind").isin(*output_kinds)
    told = F.try_parse_json(get("p", "output"))
    results = items.where(output).select(
        "run_id", get("p", "call_id").alias("call_id"), "place", F.coalesce(F.try_variant_get(told, "$.output", "string"), get("p", "output"), F.lit("")).alias("text"),
        (F.try_variant_get(told, "$.metadata.exit_code", "int") != 0).alias("is_error"),
    )
    shown = items.where((F.col("type") == "compacted") | F.col("kind").isin("message", "reasoning", *call_kinds))
    w = Window.partitionBy("run_id").orderBy("place")
    # a step ends with an item that isn't reasoning
    ends = F.coalesce(F.col("kind") != "reasoning", F.lit(True))
    shown = shown.withColumn("step", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    summary = F.coalesce(get("p", "summary", "variant"), get("p", "content", "variant"))
    role = F.when(F.col("type") == "compacted", "system").when(F.col("kind") == "message", get("p", "role")).when(F.col("kind").isin(*call_kinds), "assistant")
    text = F.when(F.col("kind") == "message", content_text(get("p", "content", "variant"))).when(F.col("type") == "compacted", F.coalesce(get("p", "message"), F.lit(""))).otherwise("")
    messages = shown.groupBy("run_id", "step").agg(
        F.max(F.when(role == "developer", "system").otherwise(role)).alias("role"), F.max(text).alias("text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "reasoning", F.struct("place", content_text(summary).alias("t"))))), lambda x: x["t"]), "\n").alias("thinking"),
        F.min("stamp_ms").alias("stamp_ms"), F.bool_or(F.col("type") == "compacted").alias("compaction"), F.max("place").alias("place"),
    ).where("role IS NOT NULL")
    # a measurement belongs to the last step before it
    counted = lines.where(F.col("kind") == "token_count").select("run_id", "place", get("p", "info.last_token_usage.input_tokens", "long").alias("measured"))
    spans = messages.withColumn("_next", F.lead("place").over(Window.partitionBy("run_id").orderBy("place"))).select("run_id", "step", F.col("place").alias("_from"), "_next")
    measured = counted.join(spans, "run_id").where((F.col("place") > F.col("_from")) & (F.col("_next").isNull() | (F.col("place") < F.col("_next"))))
    messages = messages.join(measured.groupBy("run_id", "step").agg(F.max("measured").alias("context_tokens")), ["run_id", "step"], "left").drop("place").withColumn("images", F.lit(0))
    made = shown.where(F.col("kind").isin(*call_kinds))
    name = F.concat_ws("__", get("p", "namespace"), get("p", "name"))
    calls = made.select(
        "run_id", "step", get("p", "call_id").alias("call_id"), get("p", "name").alias("tool"), name.alias("raw_name"),
        F.coalesce(get("p", "arguments"), get("p", "input"), F.lit("")).alias("input"), F.row_number().over(Window.partitionBy("run_id").orderBy("place")).alias("call_index"),
    )
    paired = normalize.pair_calls(calls, results)
    meta = lines.groupBy("run_id", "file").agg(F.max(F.when(F.col("type") == "session_meta", get("p", "id"))).alias("self_key"), F.max(F.when(F.col("type") == "turn_context", get("p", "model"))).alias("model"))
    runs = meta.join(normalize.instructions(messages), "run_id", "left").withColumn("title", normalize.title(F.col("instruction")))
    return Transcripts(normalize.offsets(normalize.promote_roles(messages, paired)), paired, runs)


def rollout_parents(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs with the run that spawned them: the one of which a call's result names their key."""
    spawned = calls.where(F.col("tool").rlike("(?i)spawn|agent")).select(F.col("run_id").alias("parent_run"), "step", F.explode(F.regexp_extract_all("result_text", F.lit("[0-9a-f-]{36}"), 0)).alias("self_key"))
    first = spawned.groupBy("self_key").agg(F.min(F.struct("parent_run", "step")).alias("p"))
    return runs.join(first, "self_key", "left").select(*runs.columns, F.col("p.parent_run").alias("parent_run"), F.col("p.step").alias("parent_step"))

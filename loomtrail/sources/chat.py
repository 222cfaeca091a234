"""Chat samples, one JSON object a line: messages with roles, tool calls and tool results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import normalize
from .lines import content_images, content_text, get, run_id
from .normalize import Transcripts
from .ranges import read_samples


def read_chat(spark: SparkSession, path: str | list[str]) -> Transcripts:
    """Files may be of any size, as each line is a run of its own. A sample without an id, or with that of an earlier one in
    its file, goes by the offset of its line. ``runs`` has what finds a sample again: file, offset, row, key."""
    paths = [path] if isinstance(path, str) else path
    samples = reduce(DataFrame.unionByName, [read_samples(spark, p) for p in paths])
    samples = samples.withColumn("run_id", run_id(F.col("file"), F.col("key"))).withColumn("sample_id", F.when(F.col("sample_id") != "", F.col("sample_id")).otherwise(F.col("key")))

    each = samples.select("run_id", F.posexplode(get("value", "messages", "array<variant>")).alias("at", "m"))
    each = each.withColumn("role", get("m", "role")).withColumn("content", get("m", "content", "variant"))
    results = each.where("role = 'tool'").select("run_id", get("m", "tool_call_id").alias("call_id"), F.col("at").alias("place"), content_text(F.col("content")).alias("text"), get("m", "is_error", "boolean").alias("is_error"))
    turns = each.where("role <> 'tool'").withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("at")))
    messages = turns.select(
        "run_id", "step", "role", content_text(F.col("content")).alias("text"), F.coalesce(get("m", "reasoning_content"), F.lit("")).alias("thinking"), F.size(content_images(F.col("content"))).alias("images"),
        F.lit(None).cast("long").alias("stamp_ms"), F.lit(None).cast("long").alias("context_tokens"), F.lit(False).alias("compaction"),
    )
    made = turns.select("run_id", "step", F.posexplode(get("m", "tool_calls", "array<variant>")).alias("nth", "c"))
    name = get("c", "function.name")
    calls = made.select(
        "run_id", "step", F.coalesce(get("c", "id"), F.concat(F.lit("call-"), "step", F.lit("-"), "nth")).alias("call_id"), F.element_at(F.split(name, "__"), -1).alias("tool"), name.alias("raw_name"),
        F.coalesce(get("c", "function.arguments"), F.lit("")).alias("input"), F.row_number().over(Window.partitionBy("run_id").orderBy("step", "nth")).alias("call_index"),
    )
    paired = normalize.pair_calls(calls, results)
    told = normalize.instructions(messages)
    runs = samples.select(
        "run_id", "file", "offset", "row", "key", "sample_id", *sample_groups("sample_id"), get("value", "source").alias("source"), get("value", "synthetic_model").alias("model"),
        F.coalesce(get("value", "reward", "double"), get("value", "score", "double"), F.when(get("value", "passed", "boolean"), 1.0).when(~get("value", "passed", "boolean"), 0.0)).alias("score"),
        F.coalesce(get("value", "tag.context_segment", "int"), F.regexp_extract("sample_id", r"_context_(\d+)", 1).try_cast("int")).alias("segment"),
    ).join(told, "run_id", "left")
    return Transcripts(normalize.offsets(normalize.promote_roles(messages, paired)), paired, runs.withColumn("title", normalize.title(F.col("instruction"))))


def sample_groups(column: str) -> list:
    """group_key, role and parent of a sample id ``<group>[_context_n or _subagent_<hex>]``."""
    group = F.regexp_replace(column, r"_(context_\d+|subagent_[0-9a-f]+)$", "")
    role = F.when(F.col(column).rlike(r"_subagent_[0-9a-f]+$"), "subagent").when(F.col(column).rlike(r"_context_\d+$"), "context").otherwise("main")
    return [group.alias("group_key"), role.alias("role")]


def manifest_spans(spark: SparkSession, path: str) -> DataFrame:
    """(name, records, start_row, end_row) of the files that a manifest says a sample file was made from."""
    from ..operators.joins import spans_of
    from .lines import read_documents

    files = read_documents(spark, path).select("file", F.posexplode(get("value", "input_files", "array<variant>")).alias("at", "f"))
    kept = get("f", "records", "long") - F.coalesce(get("f", "discarded_records", "long"), F.lit(0))
    return spans_of(files.select("at", get("f", "path").alias("name"), kept.alias("records")), ["at"]).drop("at")

"""Exports: chat samples, preference pairs, reviews and data cards as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import data_card


def chat_samples(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, line): each run as one chat sample, tool results after the turn that called."""
    made = calls.groupBy("run_id", "step").agg(
        F.array_sort(F.collect_list(F.struct("call_index", "call_id", "raw_name", "input", "result_text"))).alias("calls")
    )
    turns = messages.join(made, ["run_id", "step"], "left")
    role = F.when(F.col("role") == "tool", "assistant").otherwise(F.col("role"))
    tool_calls = F.transform("calls", lambda c: F.struct(c["call_id"].alias("id"), F.lit("function").alias("type"), F.struct(c["raw_name"].alias("name"), c["input"].alias("arguments")).alias("function")))
    said = F.struct(role.alias("role"), F.col("text").alias("content"), F.nullif(F.col("thinking"), F.lit("")).alias("reasoning_content"), tool_calls.alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
    answers = F.transform(
        F.filter("calls", lambda c: c["result_text"].isNotNull()),
        lambda c: F.struct(F.lit("tool").alias("role"), c["result_text"].alias("content"), F.lit(None).cast("string").alias("reasoning_content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"), c["call_id"].alias("tool_call_id")),
    )
    rows = turns.where("role <> 'result'").select("run_id", "step", F.concat(F.array(said), F.coalesce(answers, F.array().cast("array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"))).alias("m"))
    grouped = rows.groupBy("run_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "m"))), lambda x: x["m"])).alias("messages"))
    return grouped.select("run_id", F.to_json(F.struct(F.col("run_id").alias("id"), "messages")).alias("line"))


def corrections(reviews: DataFrame, messages: DataFrame) -> DataFrame:
    """(run_id, sft, dpo): for reviews with a turning step and a correction, the steps before it with the corrected
    turn, and with both turns as chosen and rejected."""
    told = reviews.where("turning_step IS NOT NULL AND correction IS NOT NULL AND trim(correction) <> ''").select("run_id", "turning_step", "correction")
    rows = messages.join(told, "run_id").where("step <= turning_step")
    each = F.struct("step", F.struct("role", F.col("text").alias("content")).alias("m"))
    grouped = rows.groupBy("run_id", "correction").agg(F.array_sort(F.collect_list(F.when(F.col("step") < F.col("turning_step"), each))).alias("before"), F.max(F.when(F.col("step") == F.col("turning_step"), F.struct("role", F.col("text").alias("content")))).alias("rejected"))
    context = F.transform("before", lambda x: x["m"])
    chosen = F.struct(F.lit("assistant").alias("role"), corrected(F.col("correction")).alias("content"))
    return grouped.select("run_id", F.to_json(F.struct(F.concat(context, F.array(chosen)).alias("messages"))).alias("sft"), F.to_json(F.struct(context.alias("prompt"), chosen.alias("chosen"), F.col("rejected"))).alias("dpo"))


def corrected(correction: Column) -> Column:
    """The text of a correction: the content of a JSON message, or the text itself."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(correction), "$.content", "string"), correction)


def write_lines(rows: DataFrame, path: str, line: str = "line", order: str | None = None) -> None:
    """One text file for each partition; sorted by ``order`` across them if it is given."""
    (rows.orderBy(order) if order else rows).select(line).write.text(path)


def write_export(rows: DataFrame, runs: DataFrame, path: str, facets: list[str]) -> None:
    """Sample lines with their data card beside them."""
    write_lines(rows, f"{path}/samples")
    data_card(runs, facets).write.json(f"{path}/data_card")


def judge_lines(results: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, row, line): judge results beside their runs, to be written in the order of path and row."""
    joined = results.join(runs.select("run_id", "path", "row"), "run_id")
    return joined.select("path", "row", F.to_json(F.struct(*[c for c in joined.columns if c not in ("path", "row")])).alias("line"))


def accepted_lines(samples: DataFrame, gates: DataFrame) -> DataFrame:
    """Lines of the samples that the gate includes, byte for byte."""
    return samples.join(gates.where("gate = 'include'").select("sample_id"), "sample_id", "left_semi")


def rerun_chains(gates: DataFrame) -> DataFrame:
    """The chains of samples that weren't included: ids without the number of their context, each once."""
    return gates.where("gate <> 'include'").select(F.regexp_replace("sample_id", r"_context_\d+$", "").alias("chain")).distinct()


def card_lines(card: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(facet, place, line): the Markdown tables of a data card (facet, value, count), by falling count, then value.

    ``titles`` gives the heading of each facet that is written. A facet without values has no table; a bar within a
    value is escaped, a null value is empty.
    """
    title = F.coalesce(*[F.when(F.col("facet") == f, F.lit(t)) for f, t in titles.items()])
    told = card.withColumn("_title", title).where("_title IS NOT NULL")
    row = F.concat(F.lit("| "), F.replace(F.coalesce("value", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value")) + 3
    rows = told.select("facet", place.alias("place"), row.alias("line"))
    head = F.posexplode(F.array(F.concat(F.lit("### "), "_title"), F.lit(""), F.lit("| | count |"), F.lit("| --- | ---: |")))
    heads = told.select("facet", "_title").distinct().select("facet", head.alias("place", "line"))
    return heads.unionByName(rows)

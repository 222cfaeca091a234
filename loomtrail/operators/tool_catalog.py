"""The tools of a run: those it called, had in its session, and was declared, under one name each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of sightings, in the order in which they count.
KINDS = ("call", "session", "declared")


def folded_name(name: Column) -> Column:
    """What names of one tool have in common: letters and digits without case."""
    return F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}]+", "")


def tool_catalog(sightings: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """(run_id, name, call_count, observed, available_in_session, declared, raw_names, sources) of sightings (run_id, raw_name, source, kind,
    place), ``place`` their order within a kind.

    A called tool stands under its own name. A name that is only listed is an alias of the tool that is written alike but for case and
    signs, if there is just one: the called one, or where none was called the one listed first. Where calls have several
    that are written alike, it stays apart. ``renames`` are names, or ends of names behind ``__``, that have another one to show.
    Null and empty names don't count.
    """
    raw = F.col("raw_name")
    name = raw
    for old, new in (renames or {}).items():
        name = F.when((raw == old) | raw.endswith(f"__{old}"), new).otherwise(name)
    seen = sightings.where(F.coalesce(raw != "", F.lit(False))).withColumn("name", name)
    seen = seen.withColumn("_folded", folded_name(F.col("name"))).withColumn("_rank", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    # one row for each name that a run has in a kind, however often it is called
    names = seen.groupBy("run_id", "_folded", "name").agg(F.min(F.struct("_rank", "place")).alias("first"))
    kin = names.groupBy("run_id", "_folded").agg(F.count_if(F.col("first._rank") == 1).alias("_called"), F.min(F.struct("first", "name")).alias("_first"))
    own = names.join(kin, ["run_id", "_folded"]).select("run_id", "name", F.when(F.col("_called") > 1, F.col("name")).otherwise(F.col("_first.name")).alias("_as"))
    is_kind = lambda k: F.col("kind") == k
    return (
        seen.groupBy("run_id", "name", "kind", "raw_name", "source").agg(F.count("*").alias("_n"))
        .join(own, ["run_id", "name"])
        .groupBy("run_id", F.col("_as").alias("name"))
        .agg(
            F.coalesce(F.sum(F.when(is_kind("call"), F.col("_n"))), F.lit(0)).cast("long").alias("call_count"), F.bool_or(is_kind("call")).alias("observed"), F.bool_or(is_kind("session")).alias("available_in_session"),
            F.bool_or(is_kind("declared")).alias("declared"), F.sort_array(F.collect_set("raw_name")).alias("raw_names"), F.sort_array(F.collect_set("source")).alias("sources"),
        )
    )

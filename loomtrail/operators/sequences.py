"""Operators over the ordered steps of a run: streaks, retries, recovery, running totals, divergence.

All take tool calls or messages with a run column and order columns, and are window functions over
``partitionBy(run).orderBy(order)``, so that Spark sorts once for those used together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ORDER = ("ts", "call_id")


def in_order(run: str = "run_id", order: Sequence[str] = ORDER, *more: str) -> WindowSpec:
    return Window.partitionBy(run, *more).orderBy(*order)


def backwards(run: str = "run_id", order: Sequence[str] = ORDER, *more: str) -> WindowSpec:
    """What comes later, read from the end: frames that end before the current row are extended row by row, while those
    that begin after it would be summed up anew for every row."""
    return Window.partitionBy(run, *more).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)


def _micros(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp"))


def numbered(calls: DataFrame, run: str = "run_id", order: Sequence[str] = ORDER) -> DataFrame:
    """Adds call_index, 1..n within the run."""
    return calls.withColumn("call_index", F.row_number().over(in_order(run, order)))


def longest_identical_streak(calls: DataFrame, least: int = 1) -> DataFrame:
    """(run_id, streak, first_index, tool): the first longest run of calls with one tool and input."""
    w = in_order()
    changed = ~(F.lag("tool").over(w).eqNullSafe(F.col("tool")) & F.lag("input").over(w).eqNullSafe(F.col("input"))) | F.lag("call_id").over(w).isNull()
    islands = numbered(calls).withColumn("changed", changed.cast("int")).withColumn("island", F.sum("changed").over(w))
    sizes = islands.groupBy("run_id", "island").agg(F.count("*").alias("streak"), F.min("call_index").alias("first_index"), F.first("tool").alias("tool"))
    best = sizes.groupBy("run_id").agg(F.max(F.struct("streak", (-F.col("first_index")).alias("minus"), "tool")).alias("b"))
    return best.select("run_id", F.col("b.streak").alias("streak"), (-F.col("b.minus")).alias("first_index"), F.col("b.tool").alias("tool")).where(F.col("streak") >= least)


def blind_retries(calls: DataFrame) -> DataFrame:
    """(run_id, call_id, retry_id): a failed call, and the next call of the tool if it has the same input."""
    w = in_order("run_id", ORDER, "tool")
    follower = calls.withColumn("retry_id", F.lead("call_id").over(w)).withColumn("retry_input", F.lead("input").over(w))
    return follower.where("is_error AND retry_id IS NOT NULL AND retry_input <=> input").select("run_id", "call_id", "retry_id")


def error_recovery(calls: DataFrame) -> DataFrame:
    """For each failed call the first later success of its tool, and how many later calls of the tool there are."""
    later = backwards("run_id", ORDER, "tool")
    succeeded = F.when(~F.col("is_error"), F.col("call_id"))
    found = calls.withColumn("recovered_by", F.last(succeeded, ignorenulls=True).over(later)).withColumn("attempts_later", F.count("*").over(later))
    return found.where("is_error").select("run_id", "call_id", "tool", "recovered_by", "attempts_later")


def recovery_rates(calls: DataFrame) -> DataFrame:
    """Errors of each run and the share of them that a later success of the tool made good."""
    return error_recovery(calls).groupBy("run_id").agg(F.count("*").alias("errors"), F.round(F.avg(F.col("recovered_by").isNotNull().cast("double")), 3).alias("recovery_rate"))


def repeat_of(calls: DataFrame) -> DataFrame:
    """Calls with the latest earlier call of the same tool and input."""
    w = in_order("run_id", ORDER, "tool", "input")
    return calls.withColumn("repeat_of", F.lag("call_id").over(w)).where("repeat_of IS NOT NULL").select("run_id", "call_id", "repeat_of")


def context_track(steps: DataFrame, tokens: Column, reset: Column, measured: Column, order: Sequence[str] = ("step",)) -> DataFrame:
    """Adds ``estimate``: tokens in the context before each step.

    The sum of earlier tokens since the last reset (which empties the context before its own step), moved
    by the difference between the last measurement and the sum at its place; never below 0.
    """
    w = Window.partitionBy("run_id").orderBy(*order)
    islands = steps.withColumn("_island", F.sum(reset.cast("int")).over(w)).withColumn("_tokens", tokens).withColumn("_measured", measured)
    inside = Window.partitionBy("run_id", "_island").orderBy(*order)
    running = F.coalesce(F.sum("_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tracked = islands.withColumn("_running", running).withColumn("_off", F.col("_measured") - F.col("_running"))
    shift = F.coalesce(F.last("_off", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return tracked.withColumn("estimate", F.greatest(F.lit(0), F.col("_running") + shift)).drop("_island", "_tokens", "_measured", "_running", "_off")


def time_to_next(steps: DataFrame, stamp: str = "ts", order: Sequence[str] = ORDER) -> DataFrame:
    """Adds seconds to the next stamped step, and a heat bucket: under 10 s, 1 min, 5 min, over."""
    seconds = _micros(F.last(stamp, ignorenulls=True).over(backwards("run_id", order))) / 1e6 - _micros(F.col(stamp)) / 1e6
    timed = steps.withColumn("seconds", seconds)
    return timed.withColumn("heat", F.when(F.col("seconds") < 10, 0).when(F.col("seconds") < 60, 1).when(F.col("seconds") < 300, 2).when(F.col("seconds").isNotNull(), 3))


def longest_gap(steps: DataFrame, stamp: str = "ts", order: Sequence[str] = ORDER) -> DataFrame:
    """The longest time between adjacent steps that both have a stamp."""
    gap = _micros(F.col(stamp)) - _micros(F.lag(stamp).over(in_order("run_id", order)))
    return steps.withColumn("gap", gap / 1e6).groupBy("run_id").agg(F.max("gap").alias("longest_gap"))


def verification_after_last_change(calls: DataFrame, change: Column, check: Column) -> DataFrame:
    """For each run with changes: the last change and the first check after it (null: not verified)."""
    marked = numbered(calls).withColumn("_change", change).withColumn("_check", check)
    last = F.max(F.when(F.col("_change"), F.col("call_index"))).over(Window.partitionBy("run_id"))
    marked = marked.withColumn("last_change", last).where("last_change IS NOT NULL")
    return marked.groupBy("run_id").agg(F.max("last_change").alias("last_change"), F.min(F.when(F.col("_check") & (F.col("call_index") > F.col("last_change")), F.col("call_index"))).alias("verified_at"))


def change_look_cycles(calls: DataFrame, change: Column, look: Column) -> DataFrame:
    """How often a look follows a change, and how often a change follows such a look."""
    kinds = calls.withColumn("_kind", F.when(change, "change").when(look, "look")).where("_kind IS NOT NULL")
    w = in_order()
    kinds = kinds.withColumn("_prev", F.lag("_kind").over(w)).withColumn("_prev2", F.lag("_kind", 2).over(w))
    return kinds.groupBy("run_id").agg(
        F.count_if(F.col("_kind") == "change").alias("changes"),
        F.count_if(F.col("_kind") == "look").alias("looks"),
        F.count_if((F.col("_kind") == "look") & (F.col("_prev") == "change")).alias("checked_changes"),
        F.count_if((F.col("_kind") == "change") & (F.col("_prev") == "look") & (F.col("_prev2") == "change")).alias("cycles"),
    )


def unverified_claims(calls: DataFrame, claim: Column, implement: Column, verify: Column) -> DataFrame:
    """Claims to be done whose latest earlier implementing or verifying call implements."""
    phase = F.when(implement, "implement").when(verify, "verify")
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("_claim", claim).withColumn("_last", F.last(phase, ignorenulls=True).over(before)).where("_claim AND _last = 'implement'").select("run_id", "call_id")


def closing_tail(calls: DataFrame, tail: Column, polish: Column, stamp: str = "ts") -> DataFrame:
    """The longest suffix of calls of the kind ``tail`` or ``polish``, from its first ``polish`` on: its first call, the one
    before it (null: none), its length and share, polishing calls in it, its time and share of the run's time."""
    marked = numbered(calls).withColumn("_polish", polish).withColumn("_tail", tail | F.col("_polish")).withColumn("_at", _micros(F.col(stamp)))
    run = Window.partitionBy("run_id")
    last_other = F.coalesce(F.max(F.when(~F.col("_tail"), F.col("call_index"))).over(run), F.lit(0))
    marked = marked.withColumn("_after", F.col("call_index") > last_other).withColumn("calls", F.count("*").over(run))
    marked = marked.withColumn("tail_from", F.min(F.when(F.col("_after") & F.col("_polish"), F.col("call_index"))).over(run)).where("tail_from IS NOT NULL")
    in_tail = F.col("call_index") >= F.col("tail_from")
    found = marked.groupBy("run_id", "calls", "tail_from").agg(
        F.count_if(in_tail & F.col("_polish")).alias("polish_calls"), F.max(F.when(F.col("call_index") == F.col("tail_from"), F.col("_at"))).alias("_begin"),
        F.max_by("_at", "call_index").alias("_end"), F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("call_index"))).alias("_start"),
    )
    length, spent, total = F.col("calls") - F.col("tail_from") + 1, F.col("_end") - F.col("_begin"), F.col("_end") - F.col("_start")
    return found.select(
        "run_id", "tail_from", F.nullif(F.col("tail_from") - 1, F.lit(0)).alias("milestone"), length.alias("tail_calls"), F.round(length / F.col("calls"), 3).alias("tail_share"), "polish_calls",
        F.floor(spent / 1000).alias("tail_ms"), F.when(total > 0, F.round(spent / total, 3)).alias("time_share"),
    )


def first_divergence(left: DataFrame, right: DataFrame, pair: str = "pair_id", signature: str = "signature", order: Sequence[str] = ORDER) -> DataFrame:
    """For pairs of call sequences: the first place where they differ, null where one is the other's beginning
    and both end, else the place after the shorter one."""
    w = Window.partitionBy(pair).orderBy(*order)
    a = left.select(pair, F.row_number().over(w).alias("at"), F.col(signature).alias("a"))
    b = right.select(pair, F.row_number().over(w).alias("at"), F.col(signature).alias("b"))
    joined = a.join(b, [pair, "at"], "full")
    return joined.groupBy(pair).agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("at"))).alias("diverges_at"), F.count_if(F.col("a") == F.col("b")).alias("same"))


def previous_tool_step(steps: DataFrame, has_tools: Column, order: Sequence[str] = ("step",)) -> DataFrame:
    """Adds the latest earlier step that called tools."""
    before = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("reacts_to", F.last(F.when(has_tools, F.col("step")), ignorenulls=True).over(before))


def next_steps(steps: DataFrame, after: Column, n: int = 2, order: Sequence[str] = ("step",)) -> DataFrame:
    """The next ``n`` steps of kind ``after`` for every step, as an array."""
    none = F.array().cast(f"array<{steps.schema['step'].dataType.simpleString()}>")
    found = steps.withColumn("next_steps", none)
    for _ in range(n):
        # the next step of the kind, and then those that were next for it
        onward = F.when(after, F.concat(F.array("step"), "next_steps"))
        found = found.withColumn("next_steps", F.coalesce(F.last(onward, ignorenulls=True).over(backwards("run_id", order)), none))
    return found


def status_changes(items: DataFrame, item: str = "item", status: str = "status", order: Sequence[str] = ("step",)) -> DataFrame:
    """Entries of a plan ledger at which an item's status changes, with the step at which it is completed."""
    w = Window.partitionBy("run_id", item).orderBy(*order)
    marked = items.withColumn("_before", F.lag(status).over(w)).where(~F.col("_before").eqNullSafe(F.col(status)))
    done = F.min(F.when(F.col(status) == "completed", F.col("step"))).over(Window.partitionBy("run_id", item))
    return marked.withColumn("completed_step", done).drop("_before")


def removed_items(snapshots: DataFrame, items: str = "items", order: Sequence[str] = ("step",)) -> DataFrame:
    """Items of a full-list plan that the next list leaves out, at the step of that list."""
    w = Window.partitionBy("run_id").orderBy(*order)
    gone = snapshots.withColumn("_gone", F.array_except(F.lag(items).over(w), F.col(items)))
    return gone.withColumn("item", F.explode("_gone")).select("run_id", "step", "item", F.lit("removed").alias("status"))


def duplicate_paragraphs(texts: DataFrame, text: str = "text", order: Sequence[str] = ("step",), least: int = 60) -> DataFrame:
    """Paragraphs of at least ``least`` characters, white space folded, that occurred earlier in the run."""
    said = lambda raw: F.trim(F.regexp_replace(raw, r"\s+", " "))
    raws = F.split(text, r"\n\s*\n")
    # only digests are sorted; the text is taken again for what occurs twice
    each = texts.select("run_id", *order, F.posexplode(raws).alias("nth", "raw")).withColumn("_said", said(F.col("raw"))).where(F.length("_said") >= least)
    marked = each.select("run_id", *order, "nth", F.unhex(F.sha2(F.col("_said").cast("binary"), 256)).alias("_digest"))
    w = Window.partitionBy("run_id", "_digest").orderBy(*order, "nth")
    again = marked.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1").drop("_digest")
    keys = ["run_id", *order]
    again = again.select(*[F.col(k).alias(f"_{k}") for k in keys], "nth", "occurrence")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return texts.join(again, same).select(*keys, "nth", said(F.get(raws, F.col("nth"))).alias("paragraph"), "occurrence")


def language_mix(texts: DataFrame, text: str = "text", least_units: float = 10.0) -> DataFrame:
    """Per run: steps by script (2.5 CJK characters carry one Latin word), the minority's share, the flag."""
    prose = F.regexp_replace(F.col(text), r"(?s)```.*?```|`[^`]*`|https?://\S+|(?:/[\w.-]+){2,}", " ")
    cjk = F.regexp_count(prose, F.lit(r"[㐀-鿿豈-﫿぀-ヿ가-힯]")) / 2.5
    latin = F.regexp_count(prose, F.lit("[A-Za-z]{2,}"))
    votes = texts.select("run_id", cjk.alias("cjk"), latin.alias("latin")).where(F.col("cjk") + F.col("latin") >= least_units)
    counts = votes.groupBy("run_id").agg(F.count_if(F.col("cjk") >= F.col("latin")).alias("cjk_steps"), F.count_if(F.col("cjk") < F.col("latin")).alias("latin_steps"))
    minority, total = F.least("cjk_steps", "latin_steps"), F.col("cjk_steps") + F.col("latin_steps")
    return counts.withColumn("mix_share", F.round(minority / total, 3)).withColumn("mixed", (minority >= 2) & (minority / total >= 0.15))

"""Questions to an external judge about steps, and what its answers add up to. The client is given by the caller."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

# fixed values: probabilities from which a question flags its step
THRESHOLDS = {"claims_done": 0.8, "ignores_error": 0.7}
DEFAULT_THRESHOLD = 0.5
# fixed values: steps of a window; probabilities from which a step is found, works on a requirement, and a sentence is one
# or is still carried; steps that a search returns
WINDOW, FOUND, COVERS, HOLDS, TOP = 60, 0.05, 0.3, 0.5, 8
Client = Callable[[list[str]], list[Mapping[str, float] | Exception]]
#: Answers of a choice: for each question the probabilities of steps.
ChoiceClient = Callable[[list[str]], list[Mapping[str, Mapping[str, float]] | Exception]]


def offline_client(states: list[str]) -> list[Mapping[str, float]]:
    """A stand-in without a model: words of the state answer."""
    return [{"claims_done": float("done" in s.lower()), "ignores_error": 0.0, "noticed_problem": float("error" in s.lower())} for s in states]


def step_states(messages: DataFrame, calls: DataFrame, clip: Callable[[Column, int], Column]) -> DataFrame:
    """(run_id, step, state, questions): each model turn with the results that it reacts to, and the questions for
    which there is evidence."""
    by_step = calls.groupBy("run_id", "step").agg(F.bool_or("is_error").alias("failed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_index", clip(F.coalesce("result_text", F.lit("")), 800).alias("t")))), lambda x: x["t"]), "\n").alias("results"))
    from .sequences import previous_tool_step

    joined = messages.join(by_step, ["run_id", "step"], "left")
    reacting = previous_tool_step(joined, F.col("results").isNotNull())
    before = by_step.select("run_id", F.col("step").alias("reacts_to"), F.col("results").alias("observed"), F.col("failed").alias("after_error"))
    turns = reacting.where(F.col("role").isin("assistant", "tool")).join(before, ["run_id", "reacts_to"], "left")
    state = F.to_json(F.struct("step", clip(F.col("text"), 1500).alias("text"), clip(F.col("thinking"), 800).alias("thinking"), "observed"))
    asked = F.array_compact(F.array(F.when(F.trim("text") != "", "claims_done"), F.when(F.col("after_error"), "ignores_error"), F.when(F.col("observed").isNotNull(), "noticed_problem")))
    return turns.select("run_id", "step", state.alias("state"), asked.alias("questions")).where(F.size("questions") > 0)


def ask(states: DataFrame, client: Client) -> DataFrame:
    """(run_id, step, question, p, error): answers to the questions asked of each step; a failed request is a row with
    its error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for run, step, asked, answer in zip(batch["run_id"], batch["step"], batch["questions"], client(list(batch["state"])), strict=True):
                for q in asked:
                    failed = isinstance(answer, Exception)
                    rows.append((run, step, q, None if failed else answer.get(q), str(answer) if failed else None))
            yield pd.DataFrame(rows, columns=["run_id", "step", "question", "p", "error"])

    kind = states.schema["run_id"].dataType.simpleString()
    return states.mapInPandas(each, f"run_id {kind}, step long, question string, p double, error string")


def flagged_steps(answers: DataFrame) -> DataFrame:
    """(run_id, question, steps, n): steps at which a question's probability reaches its threshold."""
    limit = F.coalesce(*[F.when(F.col("question") == q, t) for q, t in THRESHOLDS.items()], F.lit(DEFAULT_THRESHOLD))
    return answers.where(F.col("p") >= limit).groupBy("run_id", "question").agg(F.array_sort(F.collect_set("step")).alias("steps"), F.countDistinct("step").alias("n"))


def cacheable(answers: DataFrame) -> DataFrame:
    """Runs of which at least one request succeeded; those that failed altogether are not kept."""
    return answers.join(answers.groupBy("run_id").agg(F.count("p").alias("_good")).where("_good > 0").select("run_id"), "run_id", "left_semi")


def ask_in_turn(states: DataFrame, runs: Sequence, client: Client, stop_after: int = 3, at_once: int = 3) -> tuple[DataFrame, dict]:
    """Asks about the runs named, ``at_once`` in a job, until ``stop_after`` in a row have failed altogether: then something is broken, and
    further requests would be paid for nothing.

    Returns the answers of the runs that were reached and didn't fail (see ``cacheable``), and a report: analyzed, failed, not_run,
    stopped. The runs named are those of one batch, whose number the caller bounds; of each a job tells only whether it failed.
    Runs of the last job that come after the stop don't count.
    """
    kept, failed, streak, reached = [], [], 0, 0
    for begin in range(0, len(runs), at_once):
        some = list(runs[begin : begin + at_once])
        answers = cut(ask(states.where(F.col("run_id").isin(*some)), client))
        good = {r["run_id"]: r["good"] for r in answers.groupBy("run_id").agg(F.count("p").alias("good")).collect()}
        for run in some:
            reached += 1
            # a run with nothing to ask hasn't failed
            streak = 0 if good.get(run, 1) else streak + 1
            failed += [run] if streak else []
            if streak >= stop_after:
                break
        kept.append(cacheable(answers).where(F.col("run_id").isin(*runs[begin:reached])))
        if streak >= stop_after:
            break
    none = ask(states.limit(0), client)
    report = {"analyzed": reached - len(failed), "failed": failed, "not_run": len(runs) - reached, "stopped": streak >= stop_after}
    return reduce(DataFrame.unionByName, kept, none), report


def usage(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("requests"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def offline_choices(states: list[str]) -> list[Mapping[str, Mapping[str, float]]]:
    """A stand-in without a model: the steps of a window that say what is asked for, each as likely."""
    answers = []
    for state in map(json.loads, states):
        hits = {q: [k for k, said in state["steps"].items() if what.lower() in said.lower()] for q, what in state["questions"].items()}
        answers.append({q: dict.fromkeys(keys, 1 / len(keys)) for q, keys in hits.items() if keys})
    return answers


def step_windows(summaries: DataFrame, questions: DataFrame, size: int = WINDOW) -> DataFrame:
    """(run_id, window, state): the steps of a run by ``size``, each with all questions of the run.

    ``summaries`` has (run_id, step, summary), ``questions`` (run_id, question, what). Steps of a
    run and its questions are named once each. Runs without steps or questions have no window; a null summary is empty.
    """
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("step")) - 1
    entry = F.struct("step", F.coalesce("summary", F.lit("")).alias("summary"))
    windows = summaries.withColumn("window", F.floor(nth / size).cast("int")).groupBy("run_id", "window").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    steps = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["step"].cast("string"), e["summary"])))
    asked = questions.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", "what")))).alias("questions"))
    return windows.join(asked, "run_id").select("run_id", "window", F.to_json(F.struct("questions", steps.alias("steps"))).alias("state"))


def ask_choices(windows: DataFrame, client: ChoiceClient) -> DataFrame:
    """(run_id, window, question, step, p, error): probabilities of the steps of each window; a failed request is a row
    with its error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for run, window, answer in zip(batch["run_id"], batch["window"], client(list(batch["state"])), strict=True):
                if isinstance(answer, Exception):
                    rows.append((run, window, None, None, None, str(answer)))
                else:
                    rows += [(run, window, q, int(step), float(p), None) for q, steps in answer.items() for step, p in steps.items() if step != "none"]
            yield pd.DataFrame(rows, columns=["run_id", "window", "question", "step", "p", "error"]).astype({"step": "Int64"})

    kind = windows.schema["run_id"].dataType.simpleString()
    return windows.mapInPandas(each, f"run_id {kind}, window int, question string, step long, p double, error string")


def found_steps(answers: DataFrame, top: int = TOP, least: float = FOUND) -> DataFrame:
    """(run_id, question, place, step, p): the likeliest steps of a run; of two as likely the one whose number reads later
    as text is first."""
    order = Window.partitionBy("run_id", "question").orderBy(F.desc("p"), F.desc(F.col("step").cast("string")))
    ranked = answers.where(F.col("p") >= least).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= top).select("run_id", "question", "place", "step", F.round("p", 3).alias("p"))


def kept_requirements(candidates: DataFrame) -> DataFrame:
    """Sentences (…, p) that are requirements, with p to three digits; those without an answer aren't kept."""
    return candidates.withColumn("p", F.round("p", 3)).where(F.col("p") >= HOLDS)


def covered(requirements: DataFrame, answers: DataFrame) -> DataFrame:
    """(run_id, question, step, p_step): the likeliest step that works on each requirement over all windows, the first
    of those as likely; null below COVERS. A requirement without an answer has p_step 0."""
    positive = answers.where("p > 0").groupBy("run_id", "question").agg(F.max(F.struct("p", (-F.col("step")).alias("step"))).alias("best"))
    joined = requirements.select("run_id", "question").join(positive, ["run_id", "question"], "left")
    p = F.coalesce("best.p", F.lit(0.0))
    return joined.select("run_id", "question", F.when(p >= COVERS, -F.col("best.step")).alias("step"), F.round(p, 3).alias("p_step"))


def dropped_requirements(answers: DataFrame) -> DataFrame:
    """(run_id, compaction, dropped): requirements that a summary no longer carries, in order; empty if all are there.

    ``answers`` has (run_id, compaction, question, p).
    """
    lost = F.array_sort(F.collect_set(F.when(F.col("p") < HOLDS, F.col("question"))))
    return answers.groupBy("run_id", "compaction").agg(lost.alias("dropped"))

"""Windows of steps for the judge, what its answers add up to, and prompts by section, on literal frames."""

import json

from loomtrail.operators import judge, prompts
from loomtrail.sources import sinks


def test_windows_carry_all_steps_once_and_failures_are_rows(spark):
    summaries = spark.createDataFrame([("r", n, f"step {n}") for n in range(1, 132)] + [("s", 1, None)], "run_id string, step long, summary string")
    questions = spark.createDataFrame([("r", "match", "step 13"), ("s", "match", "x"), ("none", "match", "x")], "run_id string, question string, what string")
    windows = judge.step_windows(summaries, questions)
    got = {(w["run_id"], w["window"]): json.loads(w["state"]) for w in windows.collect()}
    assert [len(got["r", n]["steps"]) for n in range(3)] == [60, 60, 11] and len(got) == 4
    assert list(got["r", 1]["steps"])[:2] == ["61", "62"] and got["s", 0]["steps"] == {"1": ""}

    def client(states):
        return [ValueError("down") if '"1":""' in s else {"match": {"none": 0.5, "61": 0.2}} for s in states]

    answers = judge.ask_choices(windows, client)
    assert {(a["run_id"], a["window"], a["step"], a["p"], a["error"]) for a in answers.collect()} == {("r", n, 61, 0.2, None) for n in range(3)} | {("s", 0, None, None, "down")}


def test_found_steps_break_ties_by_the_step_as_text_and_stop_at_eight(spark):
    answers = spark.createDataFrame([("r", "match", n, 0.5) for n in range(1, 12)] + [("r", "match", 90, 0.04), ("r", None, None, None)], "run_id string, question string, step long, p double")
    found = judge.found_steps(answers).orderBy("place").collect()
    assert [f["step"] for f in found] == [9, 8, 7, 6, 5, 4, 3, 2]


def test_coverage_takes_the_first_of_the_likeliest(spark):
    answers = spark.createDataFrame([("r", "a", 7, 0.4), ("r", "a", 3, 0.4), ("r", "b", 2, 0.2), ("r", "d", 2, 0.0)], "run_id string, question string, step long, p double")
    wanted = spark.createDataFrame([("r", q) for q in "abcd"], "run_id string, question string")
    got = {c["question"]: (c["step"], c["p_step"]) for c in judge.covered(wanted, answers).collect()}
    assert got == {"a": (3, 0.4), "b": (None, 0.2), "c": (None, 0.0), "d": (None, 0.0)}


def test_requirements_kept_and_dropped(spark):
    rows = spark.createDataFrame([("r", 0, "a", 0.4996), ("r", 0, "b", 0.2), ("r", 1, "a", 0.9), ("r", 1, "b", None)], "run_id string, compaction int, question string, p double")
    assert {(k["compaction"], k["question"], k["p"]) for k in judge.kept_requirements(rows).collect()} == {(0, "a", 0.5), (1, "a", 0.9)}
    assert {d["compaction"]: d["dropped"] for d in judge.dropped_requirements(rows).collect()} == {0: ["a", "b"], 1: []}


def test_sections(spark):
    rows = [("a", "x\r\n# One \n\n```\n# no\n```\n## two\n# # no\n# Two\n"), ("b", None), ("c", "# Only"), ("d", "```\n# open"), ("e", "y\n\n")]
    got = prompts.sections(spark.createDataFrame(rows, "run_id string, text string")).orderBy("run_id", "section").collect()
    assert [(s["run_id"], s["section"], s["heading"], s["body"]) for s in got] == [
        ("a", 0, "", "x"), ("a", 1, "One", "\n```\n# no\n```\n## two\n# # no"), ("a", 2, "Two", ""), ("b", 0, "", ""),
        ("c", 0, "", ""), ("c", 1, "Only", ""), ("d", 0, "", "```\n# open"), ("e", 0, "", "y\n"),
    ]


def test_card_lines(spark):
    card = spark.createDataFrame([("all", None, 3), ("model", "b|c", 1), ("model", "a", 1), ("model", None, 2)], "facet string, value string, count long")
    lines = [x["line"] for x in sinks.card_lines(card, {"model": "Models", "role": "Roles"}).orderBy("place").collect()]
    assert lines == ["### Models", "", "| | count |", "| --- | ---: |", "|  | 2 |", "| a | 1 |", r"| b\|c | 1 |"]


def test_a_batch_stops_after_failures_in_a_row_and_keeps_what_succeeded(spark):
    states = spark.createDataFrame([(r, s, f"{r} {s}", ["q"]) for r in "abcdefghij" for s in (1, 2)], "run_id string, step long, state string, questions array<string>")

    def client(down):
        return lambda said: [ValueError("down") if s.split()[0] in down or s == "b 1" else {"q": 0.5} for s in said]

    def batch(down, **how):
        answers, report = judge.ask_in_turn(states, list("abcxdefghij"), client(down), **how)
        return sorted({a["run_id"] for a in answers.collect()}), report

    for at_once in (1, 2, 3, 20):
        assert batch("cefg", at_once=at_once) == (["a", "b", "d"], {"analyzed": 4, "failed": list("cefg"), "not_run": 3, "stopped": True})
    # one that fails in part, or has nothing to be asked, ends a row of failures
    assert batch("acd") == (list("befghij"), {"analyzed": 8, "failed": list("acd"), "not_run": 0, "stopped": False})
    assert judge.ask_in_turn(states, [], client(""))[1] == {"analyzed": 0, "failed": [], "not_run": 0, "stopped": False}

"""Flags, changes and text expressions on literal frames."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrail.functions import texts
from loomtrail.operators import changes, signals

CALLS = "run_id string, call_index int, step int, tool string, raw_name string, input string, is_error boolean, result_text string"


def calls(spark, *rows):
    return spark.createDataFrame([(r, i, i + 1, t, t, x if isinstance(x, str) else json.dumps(x), e, o) for r, i, t, x, e, o in rows], CALLS)


def flags_of(spark, made, turns=(), outcome="fail", role="main"):
    messages = spark.createDataFrame([("r", 90 + i, "assistant", t, "") for i, t in enumerate(turns)], "run_id string, step int, role string, text string, thinking string")
    runs = spark.createDataFrame([("r", outcome, role)], "run_id string, outcome string, role string")
    return {f["key"]: (f["severity"], f["steps"]) for f in signals.flags(messages, calls(spark, *made), runs).first()["flags"]}


def test_loops_and_retries(spark):
    made = [("r", i, "Bash", {"command": "ls"}, True, "x") for i in (1, 2, 3)]
    got = flags_of(spark, made)
    assert got["loop"] == ("warn", [2, 3, 4]) and got["blind_retry"] == ("warn", [3, 4])


@pytest.mark.parametrize(("then", "verified"), [(("Bash", {"command": "pytest -q"}), True), (("Read", {"file_path": "/a.py"}), True), (("Bash", {"command": "cat other"}), False), (None, False), (("Bash", {"command": "cat /x/a.py"}), True)])
def test_verification(spark, then, verified):
    made = [("r", 1, "Edit", {"file_path": "/a.py", "old_string": "x"}, False, "")]
    made += [("r", 2, *then, False, "")] if then else []
    assert ("no_verify" in flags_of(spark, made)) is not verified


def test_test_edits(spark):
    new = [("r", 1, "Write", {"file_path": "tests/test_a.py"}, False, ""), ("r", 2, "Edit", {"file_path": "tests/test_a.py"}, False, "")]
    assert "test_edit" not in flags_of(spark, new)
    old = [("r", 1, "Edit", {"file_path": "tests/test_a.py"}, False, "")]
    assert flags_of(spark, old)["test_edit"] == ("bad", [2]) and flags_of(spark, old, outcome="unknown")["test_edit"][0] == "info"
    assert flags_of(spark, old, role="subagent")["subagent_edit"] == ("info", [2])


def test_text_flags(spark):
    long = "The same long paragraph that stands here more than once, word for word, indeed."
    got = flags_of(spark, [("r", 1, "Bash", {"command": "x"}, True, "curl: connection refused")], [long, f"{long}\n\n{long}", "Sorry, let me see"])
    assert got["infra_error"] == ("info", [2]) and got["redundancy"][0] == "info" and 91 in got["redundancy"][1]


def test_paths_and_mutations(spark):
    made = calls(spark, ("r", 1, "Bash", {"command": "echo a > out/x.txt"}, False, ""), ("r", 2, "Bash", {"command": "ls 2>/dev/null"}, False, ""), ("r", 3, "apply_patch", "*** Update File: src/a.py\n", False, ""), ("r", 4, "editor", {"command": "create", "path": "p"}, False, ""))
    got = made.select(signals.touched_paths(F.col("tool"), F.col("input")).alias("p"), signals.is_mutation(F.col("tool"), F.col("input")).alias("m"), "call_index").orderBy("call_index").collect()
    assert [r["m"] for r in got] == [True, False, True, True] and got[0]["p"] == ["out/x.txt"] and got[2]["p"] == ["src/a.py"] and got[3]["p"] == ["p"]


def test_overlaps_are_found_once(spark):
    left = spark.createDataFrame([("s", 1, 0, 9000), ("s", 2, 9001, 9002)], "k string, id int, start long, end long")
    right = spark.createDataFrame([("s", 7, 9000, 9001), ("s", 8, 20000, 20001), ("t", 9, 0, 5)], "k string, id int, start long, end long")
    assert sorted((r["left_id"], r["right_id"]) for r in changes.overlapping(left, right, ["k"]).collect()) == [(1, 7), (2, 7)]


def test_review_order_and_compactions(spark):
    rows = [("s", 1, False, [], True), ("s", 2, False, ["w"], True), ("s", 3, True, ["w"], True), ("s", 4, False, [], False)]
    frame = spark.createDataFrame(rows, "sample_id string, position int, gate_warning boolean, warnings array<string>, recorded boolean")
    assert [r["position"] for r in changes.review_order(frame).collect()] == [3, 2, 4, 1]
    m = spark.createDataFrame([("r", 1, "a", False, False), ("r", 2, "", True, False), ("r", 3, "sum", False, True), ("r", 4, "x", False, False), ("r", 5, "", True, False), ("r", 6, "sum2", False, True)], "run_id string, step int, text string, compaction boolean, is_summary boolean")
    assert [(r["step"], r["summary"]) for r in changes.compaction_points(m).orderBy("step").collect()] == [(2, "sum"), (5, "sum2")]
    s = spark.createDataFrame([("g", 1, None, "one two"), ("g", 2, "one  two", "x"), ("g", 3, "y", None)], "group_key string, segment int, opening_summary string, closing_summary string")
    assert [r["sync"] for r in changes.summary_sync(s).orderBy("segment").collect()] == ["same", "differs", None]


def test_texts(spark):
    one = lambda column, value: spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("v")).first()["v"]
    assert one(texts.requirement_candidates, "Intro words here. You must do it well!\n- Add three charts\n- Add three charts\nok") == ["Intro words here.", "You must do it well!", "Add three charts"]
    got = one(texts.split_metadata, 'hello\n[metadata] {"a": 1}')
    assert (got["text"], got["metadata"]) == ("hello", '{"a": 1}') and one(texts.split_metadata, "x [metadata] {bad")["metadata"] is None
    assert one(texts.fence, "a ``` b").startswith("````\n") and texts.step_ranges("3-5, 9") == [3, 4, 5, 9]
    with pytest.raises(ValueError, match="not a step"):
        texts.step_ranges("x")


def test_removed_steps_merge_into_the_next_kept_one(spark):
    schema = "sample_id string, step int, text string"
    removed = spark.createDataFrame([("s", 2, "please read every single card"), ("s", 3, "nothing alike here"), ("s", 9, "after all others"), ("t", 1, "alone")], schema)
    kept = spark.createDataFrame([("s", 2, "read every card"), ("s", 4, "then read every single card again"), ("s", 5, "nothing alike here")], schema)
    got = {(r["sample_id"], r["step"]): r["merged_into"] for r in changes.merged_steps(removed, kept).collect()}
    assert got == {("s", 2): 4, ("s", 3): None}

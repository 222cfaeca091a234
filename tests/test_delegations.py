"""Delegations, hooks and guidance on literal frames, and kept summaries."""

from pyspark.sql import functions as F

from loomtrail.operators import delegations as d
from loomtrail.operators.summaries import Summaries

MESSAGES = "run_id string, step int, role string, layer string, text string"
CALLS = "run_id string, step int, call_id string, tool string, input string, result_text string, spawned string"


def test_reports_of_both_kinds(spark):
    messages = [
        ("r", 1, "user", None, "agent7 is named before its time"), ("r", 2, "assistant", None, "call"), ("r", 3, "tool", None, "x"), ("r", 4, "assistant", None, "call"),
        ("r", 5, "system", None, "news of agent7: done"), ("r", 6, "assistant", None, "a"), ("r", 7, "user", None, "task build is ready"), ("r", 8, "tool", None, "b"), ("r", 9, "assistant", None, "c"), ("s", 5, "system", None, "agent9"),
    ]
    calls = [
        ("r", 2, "c1", "Agent", '{"prompt": "look", "subagent_type": "finder", "description": "d"}', "found it", None),
        ("r", 4, "c2", "Task", '{"message": "go"}', "Async agent launched successfully\nagentId: agent7\nwait", None),
        ("r", 4, "c3", "mcp__x__spawn_agent", '{"prompt": "gAAAAabcdefghijklmnopqrstuv", "task_name": "t"}', ' {"task_name": "build"}', None),
        ("r", 4, "c4", "Agent", "no json", "Async agent launched", None),
        ("r", 6, "c5", "run", "{}", "own result", "child-1"),
        ("r", 6, "c6", "Read", "{}", "no delegation", None),
        ("r", 6, "c7", "Agent", "{}", "Async agent launched agentId: agent9", None),
    ]
    got = {x["call_id"]: x for x in d.delegations(spark.createDataFrame(calls, CALLS), spark.createDataFrame(messages, MESSAGES)).collect()}
    assert set(got) == {"c1", "c2", "c3", "c4", "c5", "c7"}
    said = lambda k: (got[k]["brief"], got[k]["result"], got[k]["result_step"], got[k]["next_steps"])
    assert said("c1") == ("look", "found it", 2, [3, 4]) and (got["c1"]["subagent_type"], got["c1"]["description"]) == ("finder", "d")
    assert said("c2") == ("go", "news of agent7: done", 5, [6, 8])
    assert said("c3") == ("", "task build is ready", 7, [8, 9]) and got["c3"]["brief_encrypted"] and got["c3"]["description"] == "t"
    assert said("c4") == ("", "", None, []) and said("c7") == ("", "", None, [])
    assert said("c5") == ("", "own result", 6, [8, 9])
    empty = d.delegations(spark.createDataFrame([], CALLS), spark.createDataFrame([], MESSAGES))
    assert empty.count() == 0


def test_hooks_and_guidance(spark):
    long = "PostToolUse:Write hook additional context: run the checks"
    rows = [("r", 1, "system", None, "be good"), ("r", 2, "system", None, "SUMMARY: old"), ("r", 3, "system", "hook", long), ("r", 4, "user", None, "x"), ("r", 5, "tool", None, "y"), ("r", 6, "system", "hook", "short"), ("r", 7, "system", "hook", long + "!"), ("r", 8, "system", "other", "no guidance")]
    messages = spark.createDataFrame(rows, MESSAGES)
    assert sorted((x["step"], x["next_step"]) for x in d.hook_events(messages).collect()) == [(3, 5), (7, None)]
    wrapped = spark.createDataFrame([("r", "rules first"), ("s", ""), ("t", "only this")], "run_id string, wrapped string")
    got = {x["run_id"]: x["guidance"] for x in d.harness_text(messages, wrapped, "SUMMARY:").collect()}
    assert got == {"r": "\n\n".join(["rules first", "be good", long, "short", long + "!"]), "t": "only this"}


def test_only_what_changed_is_summarized_and_written(spark, tmp_path):
    asked = []

    def summarize(rows):
        asked.append(sorted(x["record"] for x in rows.select("record").collect()))
        return rows.where("record <> '13'").select("record", F.concat(F.lit("sum "), "text").alias("summary"))

    current = lambda rows: spark.createDataFrame(rows, "record int, text string, before string, status string")
    rows = [(i, f"t{i}", f"f{i}", None) for i in range(40)]
    kept = Summaries(spark, str(tmp_path), 8)
    got = kept.refresh(current(rows), ["before", "status"], summarize)
    assert got.count() == 40 and {x["record"]: (x["summary"], x["error"]) for x in got.collect()}["13"] == (None, "no summary")
    files = lambda: {p for p in tmp_path.rglob("*") if p.is_file()}
    before = files()
    kept.refresh(current(rows), ["before", "status"], summarize)
    assert files() == before and len(asked) == 1
    # a null and a word differ, a changed text without a changed fingerprint doesn't count
    rows[3] = (3, "t3", "f3", "null")
    rows[4] = (4, "other", "f4", None)
    kept = Summaries(spark, str(tmp_path), 8)
    after = {x["record"]: x["summary"] for x in kept.refresh(current(rows[:39]), ["before", "status"], summarize).collect()}
    assert asked[1:] == [["3"]] and after["4"] == "sum t4" and "39" not in after and len(after) == 39
    assert len({p.parent.parent.name for p in files() - before if "rows" in p.parts and p.suffix == ".parquet" and "crc" not in p.name}) <= 2
    assert kept.refresh(current([]), ["before"], summarize).count() == 0

"""Sources: small files in each format to messages, calls and runs."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrail.sources import chat, lines, normalize, sessions


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def call(id_, name, args):
    return {"id": id_, "type": "function", "function": {"name": name, "arguments": args if isinstance(args, str) else json.dumps(args)}}


SAMPLE = {
    "id": "t1_model_attempt_01", "source": "s", "reward": 0.5,
    "messages": [
        {"role": "system", "content": "be good"},
        {"role": "user", "content": [{"type": "text", "text": "# Make a page"}, {"type": "image_url", "image_url": {"url": "data:x"}}]},
        {"role": "assistant", "content": "", "reasoning_content": "hm", "tool_calls": [call("c1", "mcp__fs__read", {"path": "/a"}), call("c2", "Bash", {"command": "ls"})]},
        {"role": "tool", "tool_call_id": "c2", "content": "Exit code 2\nbad"},
        {"role": "tool", "tool_call_id": "c1", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]},
        {"role": "tool", "tool_call_id": "zz", "content": "stray"},
        {"role": "assistant", "content": "done"},
    ],
}


def test_lines_keep_their_order_and_skip_what_is_no_object(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", [{"n": 1}, "", "[1]", "{broken", {"n": 2}])
    rows = lines.with_line_numbers(lines.read_lines(spark, path)).select("row", lines.get("value", "n", "int").alias("n")).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="(?i)json|record"):
        lines.read_lines(spark, path, strict=True).collect()


def test_chat(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", [SAMPLE, SAMPLE | {"id": "t1_model_attempt_01_context_02"}, SAMPLE, {"no": "messages"}])
    t = chat.read_chat(spark, path)
    runs = t.runs.orderBy("sample_id").collect()
    assert [(r["group_key"], r["role"], r["segment"], r["score"], r["title"]) for r in runs] == [("t1_model_attempt_01", "main", None, 0.5, "Make a page")] * 2 + [("t1_model_attempt_01", "context", 2, 0.5, "Make a page")]
    assert len({r["run_id"] for r in runs}) == 3
    one = t.messages.where(F.col("run_id") == runs[0]["run_id"]).orderBy("step").collect()
    assert [(m["role"], m["text"], m["thinking"], m["images"]) for m in one] == [("system", "be good", "", 0), ("user", "# Make a page", "", 1), ("tool", "", "hm", 0), ("assistant", "done", "", 0)]
    calls = t.tool_calls.where(F.col("run_id") == runs[0]["run_id"]).orderBy("call_index").collect()
    assert [(c["tool"], c["step"], c["result_text"], c["is_error"]) for c in calls] == [("read", 3, "one\ntwo", False), ("Bash", 3, "Exit code 2\nbad", True)]


def test_readiness_of_broken_runs(spark, tmp_path):
    bad = SAMPLE | {"messages": [
        {"role": "user", "content": "go on with it"},
        {"role": "assistant", "content": "", "tool_calls": [call("a", "x", "{broken")]}, {"role": "tool", "tool_call_id": "a", "content": "r"},
        {"role": "assistant", "content": "", "tool_calls": [call("b", "x", {})]},
        {"role": "assistant", "content": "", "tool_calls": [call("c", "x", {})]},
    ]}
    t = chat.read_chat(spark, write(tmp_path / "c.jsonl", [bad]))
    orphans = spark.createDataFrame([(t.runs.first()["run_id"], 1)], "run_id string, orphan_results int")
    r = normalize.readiness(t.messages, t.tool_calls, orphans).first()
    assert {i["key"]: i["steps"] for i in r["issues"]} == {"bad_arguments": [2], "unpaired_calls": [3], "truncated_end": [4], "orphan_results": []}
    assert not r["ready"]
    good = chat.read_chat(spark, write(tmp_path / "d.jsonl", [SAMPLE]))
    g = normalize.readiness(good.messages, good.tool_calls).first()
    assert g["ready"] and [i["severity"] for i in g["issues"]] == ["warn"] and 0 < g["trained_share"] < 1


def test_sessions_merge_message_rows_and_pair_results(spark, tmp_path):
    rows = [
        {"type": "user", "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "<system-reminder>x</system-reminder>Fix the bug now"}},
        {"type": "assistant", "timestamp": "2026-01-01T00:00:05Z", "message": {"id": "m1", "role": "assistant", "model": "mo", "content": [{"type": "thinking", "thinking": "think"}], "usage": {"input_tokens": 10, "cache_read_input_tokens": 5}}},
        {"type": "assistant", "timestamp": "2026-01-01T00:00:06Z", "message": {"id": "m1", "role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "x", "a": 1}}], "usage": {"input_tokens": 10, "cache_read_input_tokens": 5}}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "boom", "is_error": True}]}},
        {"type": "attachment", "attachment": {"type": "hook", "content": "hooked"}},
        {"type": "queue-operation"},
        {"type": "assistant", "timestamp": "2026-01-01T00:00:09Z", "message": {"id": "m2", "role": "assistant", "content": [{"type": "text", "text": "fixed"}]}},
    ]
    t = sessions.read_sessions(spark, write(tmp_path / "s.jsonl", rows))
    got = t.messages.orderBy("step").collect()
    assert [(m["role"], m["thinking"], m["context_tokens"], m["offset_ms"]) for m in got] == [("user", "", None, 0), ("assistant", "think", 15, 5000), ("system", "", None, None), ("assistant", "", None, 9000)]
    assert got[1]["text"] == "ok" and got[2]["text"] == "hooked"
    c = t.tool_calls.collect()
    assert [(x["tool"], x["step"], x["is_error"], x["result_text"], json.loads(x["input"])) for x in c] == [("Bash", 2, True, "boom", {"command": "x", "a": 1})]
    r = t.runs.first()
    assert (r["self_key"], r["model"], r["title"]) == ("s1", "mo", "Fix the bug now")


def test_rollouts_attach_reasoning_and_measurements(spark, tmp_path):
    item = lambda p: {"timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": p}
    rows = [
        {"type": "session_meta", "payload": {"id": "r1"}}, {"type": "turn_context", "payload": {"model": "mo"}},
        item({"type": "message", "role": "user", "content": [{"type": "input_text", "text": "Do something"}]}),
        item({"type": "reasoning", "summary": [{"type": "summary_text", "text": "because"}]}),
        item({"type": "function_call", "name": "shell", "call_id": "c1", "arguments": "{\"command\":[\"ls\",\"-l\"]}"}),
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 77}}}},
        item({"type": "function_call_output", "call_id": "c1", "output": "{\"output\":\"listing\",\"metadata\":{\"exit_code\":1}}"}),
        item({"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "bye"}]}),
    ]
    t = sessions.read_rollouts(spark, write(tmp_path / "r.jsonl", rows))
    assert [(m["role"], m["text"], m["thinking"], m["context_tokens"]) for m in t.messages.orderBy("step").collect()] == [("user", "Do something", "", None), ("tool", "", "because", 77), ("assistant", "bye", "", None)]
    c = t.tool_calls.first()
    assert (c["tool"], c["result_text"], c["is_error"]) == ("shell", "listing", True)
    assert t.runs.first()["model"] == "mo"


def test_metrics_and_context(spark, tmp_path):
    t = chat.read_chat(spark, write(tmp_path / "c.jsonl", [SAMPLE]))
    m = normalize.metrics(t.messages, t.tool_calls).first()
    assert (m["steps"], m["tool_calls"], m["tool_errors"], m["tools"]) == (4, 2, 1, 2)
    assert normalize.context_estimates(t.messages).orderBy("step").first()["estimate"] == 0


def test_contents_arguments_and_request_times(spark):
    rows = spark.createDataFrame([('"plain"',), (json.dumps(json.dumps([{"type": "text", "text": "in"}])),), (json.dumps(json.dumps([{"type": "odd"}])),)], "x string").withColumn("v", F.parse_json("x"))
    assert [r[0] for r in rows.select(lines.content_text(lines.decoded_content(F.col("v")))).collect()] == ["plain", "in", '[{"type": "odd"}]']
    got = spark.createDataFrame([('{"b": 1, "a": 2}',), ("{bad",), ("text",)], "x string").select(lines.arguments(F.col("x"))).collect()
    assert [r[0] for r in got] == ['{"a":2,"b":1}', "{bad", "text"]
    m = spark.createDataFrame([("r", 1, None), ("r", 2, None), ("r", 3, 9)], "run_id string, step int, stamp_ms long")
    q = spark.createDataFrame([("r", 1, 5), ("r", 2, 7)], "run_id string, message_count int, stamp_ms long")
    assert [r["stamp_ms"] for r in normalize.request_times(m, q).orderBy("step").collect()] == [None, 5, 9]


def test_exports(spark):
    from loomtrail.sources import sinks

    gates = spark.createDataFrame([("a_context_1", "include"), ("b_context_1", "review"), ("b_context_2", "exclude")], "sample_id string, gate string")
    assert [r["chain"] for r in sinks.rerun_chains(gates).collect()] == ["b"]
    samples = spark.createDataFrame([("a_context_1", "x"), ("b_context_1", "y")], "sample_id string, line string")
    assert [r["line"] for r in sinks.accepted_lines(samples, gates).collect()] == ["x"]
    found = sinks.judge_lines(spark.createDataFrame([("r", 0.5)], "run_id string, p double"), spark.createDataFrame([("r", "f", 3)], "run_id string, path string, row int")).first()
    assert (found["path"], found["row"], json.loads(found["line"])) == ("f", 3, {"run_id": "r", "p": 0.5})
    m = spark.createDataFrame([("r", 1, "user", "do", ""), ("r", 2, "tool", "", "hm"), ("r", 3, "assistant", "done", "")], "run_id string, step int, role string, text string, thinking string")
    c = spark.createDataFrame([("r", 2, 1, "c1", "Bash", "{}", "out")], "run_id string, step int, call_index int, call_id string, raw_name string, input string, result_text string")
    said = json.loads(sinks.chat_samples(m, c).first()["line"])["messages"]
    assert [x["role"] for x in said] == ["user", "assistant", "tool", "assistant"] and said[2]["tool_call_id"] == "c1"
    reviews = spark.createDataFrame([("r", 3, '{"content": "better"}'), ("q", None, "x")], "run_id string, turning_step int, correction string")
    pair = sinks.corrections(reviews, m).first()
    assert json.loads(pair["dpo"])["chosen"]["content"] == "better" and json.loads(pair["dpo"])["rejected"]["content"] == "done" and len(json.loads(pair["sft"])["messages"]) == 3


def test_discovery_and_rewards(spark, tmp_path):
    from loomtrail.sources import discover, rewards

    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    write(tmp_path / "a" / "c.jsonl", [SAMPLE])
    write(tmp_path / "a" / "node_modules" / "c.jsonl", [SAMPLE])
    write(tmp_path / "a" / "r.jsonl", [{"type": "session_meta", "payload": {"id": "x"}}])
    write(tmp_path / "a" / "s.jsonl", [{"type": "user", "sessionId": "s", "message": {"role": "user", "content": "hi"}}])
    write(tmp_path / "a" / "results.json", [{"messages": []}])
    found = discover.fingerprint(discover.discover(spark, str(tmp_path / "a"))).collect()
    assert {r["path"].rsplit("/", 1)[-1]: r["format"] for r in found} == {"c.jsonl": "chat", "r.jsonl": "rollout", "s.jsonl": "session"} and all(len(r["fingerprint"]) == 64 for r in found)
    for task, text in (("t1", {"ledger": [{"id": "L1", "pass": False, "severity": "bad", "slides": [1]}, {"id": "m", "pass": False, "severity": "monitor"}], "R": 0.75, "tier": 4, "masked": False}), ("t2", {"ledger": [], "R": 0.1, "masked": True}), ("t3", "[broken"), ("_skip", {"ledger": []})):
        (tmp_path / "w" / "work" / task).mkdir(parents=True)
        write(tmp_path / "w" / "work" / task / "reward.json", [text])
    good, errors = rewards.read_rewards(spark, str(tmp_path / "w"), "label")
    got = {r["task_id"]: (r["r"], r["status"], [f["id"] for f in r["failed"]]) for r in good.collect()}
    assert got == {"t1": (0.75, "pass", ["L1"]), "t2": (None, "unknown", [])} and [r["task_id"] for r in errors.collect()] == ["t3"]


def test_the_first_known_name_of_a_failure_decides(spark):
    from loomtrail.sources import trials

    cases = [
        (("RuntimeError: x", "AgentTimeoutError"), ("AgentTimeoutError", "fail", "budget", False)),
        ((None, " ", "ApiOverloadedError", "AgentTimeoutError"), ("ApiOverloadedError", "error", "infra", True)),
        (("x classification='never_seen' y", "ValueError"), ("never_seen", "error", None, None)),
        (("x classification=reward_zero", "AgentTimeoutError"), ("reward_zero", "fail", "agent", False)),
        (("a long message of no meaning", "OddError"), ("OddError", "error", None, None)),
        (("NonZeroAgentExitCodeError", None), ("NonZeroAgentExitCodeError", "error", "agent", None)),
        ((None, ""), None),
    ]
    for names, want in cases:
        got = spark.range(1).select(trials.classify_failure(*[F.lit(n).cast("string") for n in names]).alias("f")).first()["f"]
        assert (tuple(got) if got else None) == want, names

"""Operators on tiny literal frames, and texts."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomtrail.functions import diffs, scalars, texts
from loomtrail.operators import episodes, joins, judge, library, replay, rewrites, sampling, search, sequences, upserts
from loomtrail.sources import normalize, trials
from loomtrail.streaming import imports

CALLS = "run_id int, ts int, call_id int, tool string, is_error boolean, input string"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_streaks_and_retries(spark):
    rows = [(1, i, i, "Bash", i in (2, 3, 4), "ls" if 2 <= i <= 4 else f"c{i}") for i in range(1, 7)]
    calls = spark.createDataFrame(rows, CALLS)
    s = sequences.longest_identical_streak(calls).first()
    assert (s["streak"], s["first_index"]) == (3, 2)
    assert sorted((r["call_id"], r["retry_id"]) for r in sequences.blind_retries(calls).collect()) == [(2, 3), (3, 4)]
    r = {x["call_id"]: (x["recovered_by"], x["attempts_later"]) for x in sequences.error_recovery(calls).collect()}
    assert r == {2: (5, 4), 3: (5, 3), 4: (5, 2)}


def test_context_track(spark):
    rows = [(1, 1, 100, None, False), (1, 2, 100, 5100, False), (1, 3, 10, None, False), (1, 4, 2, None, True), (1, 5, 1, None, False)]
    steps = spark.createDataFrame(rows, "run_id int, step int, tokens int, measured int, reset boolean")
    got = sequences.context_track(steps, F.col("tokens"), F.col("reset"), F.col("measured")).orderBy("step").collect()
    assert [r["estimate"] for r in got] == [0, 5100, 5200, 0, 2]


def test_verification(spark):
    calls = spark.createDataFrame([(1, 1, 1, "edit", False, ""), (1, 2, 2, "test", False, ""), (2, 1, 3, "edit", False, ""), (3, 1, 4, "test", False, "")], CALLS)
    got = {r["run_id"]: r["verified_at"] for r in sequences.verification_after_last_change(calls, F.col("tool") == "edit", F.col("tool") == "test").collect()}
    assert got == {1: 2, 2: None}


@pytest.mark.parametrize(("text", "error"), [("Exit code 1\nx", True), ("<tool_use_error>no", True), ("Exit code 0", False), ("fine", False), ('Output:\n{"content": [{"t": 1}], "isError": true}', True), (None, False), ("Process exited with code 0", False), ("x Process exited with code 2", True)])
def test_errors_in_outputs(spark, text, error):
    assert one(spark, scalars.tool_error, text) is error


def test_error_templates(spark):
    t = lambda x: one(spark, scalars.error_template, x)
    assert t("ls: cannot access '/a/b': No such file") == t("ls: cannot access '/other/x9': No such file")
    assert t("Traceback (most recent call last):\n  File \"x.py\", line 3\nValueError: bad value 17") == "ValueError: bad value <n>"
    assert t("Exit code: 1\nWall time: 3 s\nChunk ID 4\nProcess exited with code 2\nOutput:\nno such thing") == "no such thing"
    assert t('{"content": [{"type": "text", "text": "one"}, {"text": "denied: 5"}], "isError": true}') == "one denied: <n>"
    assert t('{"other": 1}') == '{<str>: <n>}'
    assert t("some output\nmore\nerror: it broke") == "error: it broke" and t("") == "(empty error output)"


def test_tokens_layers_and_keys(spark):
    assert one(spark, scalars.estimate_tokens, "a" * 10) == 2 and one(spark, scalars.estimate_tokens, "中" * 3) == 2
    assert [one(spark, scalars.harness_layer, x) for x in ("Bash", "mcp__fs__read", "Skill", "Task", "clock__sleep")] == ["base", "mcp", "skill", "subagent", "mcp"]
    assert one(spark, lambda c: scalars.task_key(F.lit(None).cast("string"), c), " A\n b ") == one(spark, lambda c: scalars.task_key(F.lit(None).cast("string"), c), "a b")
    assert [one(spark, lambda c: scalars.score_status(c.cast("double")), x) for x in ("1", "0", "0.5", None)] == ["pass", "fail", "partial", "unknown"]
    assert one(spark, scalars.command_text, '{"command": ["ls", "-l"]}') == "ls -l" and one(spark, scalars.command_text, "plain") == "plain"
    assert one(spark, scalars.timestamp_ms, "2026-01-01T00:00:01Z") == 1767225601000 == one(spark, scalars.timestamp_ms, "1767225601")


def test_failures(spark):
    f = lambda x: one(spark, trials.classify_failure, x)
    assert f("AgentTimeoutError")["kind"] == "budget" and f("AgentTimeoutError")["infra"] is False
    assert f("NonZeroAgentExitCodeError")["infra"] is None and f("ApiOverloadedError")["infra"] is True and f(None) is None
    assert f("DockerBuildBroke")["kind"] == "infra" and f("Odd")["kind"] is None and f("x classification='cancelled'")["name"] == "cancelled"


def test_episode_roots_with_missing_parents_and_cycles(spark):
    rows = [(1, "a", None, "g"), (2, "b", "a", None), (3, "c", "b", None), (4, "d", "gone", None), (5, "x", "y", None), (6, "y", "x", None), (7, None, None, None), (8, None, "c", None)]
    runs = spark.createDataFrame(rows, "run_id int, self_key string, parent_key string, group_key string")
    got = {r["run_id"]: r["episode_key"] for r in episodes.episode_roots(runs, 16).collect()}
    assert got == {1: "g", 2: "g", 3: "g", 4: "gone", 5: "y", 6: "x", 7: "row:7", 8: "g"}


def test_episode_summary_and_continued_threads(spark):
    schema = "collection string, episode_key string, run_id string, role string, segment long, steps int, tool_calls int, tool_errors int, tokens long, duration_ms long, flags array<string>, issues array<struct<key:string,severity:string>>"
    end = [("truncated_end", "block")]
    rows = [("c", "e", "r1", "main", 1, 5, 2, 1, 0, 10, ["no_verify"], end), ("c", "e", "r3", "context", 3, 4, 1, 0, 0, 20, ["no_verify"], end), ("c", "e", "s", "subagent", None, 3, 1, 0, 0, 99, ["loop"], [])]
    runs = spark.createDataFrame(rows, schema)
    s = episodes.episode_summary(runs).first()
    assert (s["head"], s["steps"], s["tokens"], s["duration_ms"], s["missing"], s["subagents"]) == ("r1", 12, None, 30, [2], 1)
    got = {r["run_id"]: (r["flags"], r["issues"][0]["severity"] if r["issues"] else None, r["ready"]) for r in episodes.suppress_continued(runs).collect()}
    assert got == {"r1": ([], "info", True), "r3": (["no_verify"], "block", False), "s": (["loop"], None, True)}


def test_prefix_match_takes_the_latest_ancestor(spark):
    runs = spark.createDataFrame([(1, "/d/runs/t1"), (2, "/d/runs2/t1"), (3, "/d/other")], "run_id int, path string")
    rewards = spark.createDataFrame([("/d/runs", "old", 1), ("/d", "older", 0), ("/d/runs", "new", 2)], "root string, label string, imported_at int")
    assert {r["run_id"]: r["label"] for r in joins.latest_by_prefix(runs, rewards).collect()} == {1: "new", 2: "older", 3: "older"}
    runs = spark.createDataFrame([(1, "/d/runs/t", "a/t-1"), (2, "/d/runs/t", "xt-1"), (3, "/d/runs/t", "t-1"), (4, "/e", "t-1"), (5, "/d/runs", None)], "run_id int, path string, task_id string")
    rewards = spark.createDataFrame([("/d/runs", "new", 2, "t-1"), ("/d", "old", 1, "t-1")], "root string, label string, imported_at int, task_id string")
    assert {r["run_id"]: r["label"] for r in joins.latest_by_prefix(runs, rewards).collect()} == {1: "new", 3: "new"}
    assert spark.range(1).select(joins.suffixes(F.lit("a/b/c"))).first()[0] == ["a/b/c", "b/c", "c"]


def test_spawning_calls(spark):
    children = spark.createDataFrame([("s1", "e", "c1", "k1"), ("s2", "e", None, "k2"), ("s3", "e", None, "k9")], "run_id string, episode_key string, parent_call_id string, self_key string")
    calls = spark.createDataFrame([("m", "e", "c1", None, 3), ("m", "e", "c2", "k2", 5)], "run_id string, episode_key string, call_id string, spawned string, step int")
    assert {r["run_id"]: r["launched_at"] for r in joins.spawning_calls(children, calls).collect()} == {"s1": 3, "s2": 5, "s3": None}


def test_filters_compose(spark):
    rows = spark.createDataFrame([("a", "c", "pass", ["x"], None, 0.5), ("b", "c", "fail", [], 1, None)], "run_id string, collection string, outcome string, flags array<string>, human_status int, r double")
    listed = lambda **k: [r["run_id"] for r in rows.where(library.RunFilter(**k).condition(rows.columns)).orderBy("run_id").collect()]
    assert listed() == ["a", "b"] and listed(flag="x") == ["a"] and listed(reviewed=True) == ["b"] and listed(r_min=0.4, outcome="pass") == ["a"] and listed(collection="z") == []


def test_queue_is_stable_and_keeps_pairs(spark):
    rows = [(i, f"c{i % 3}", f"t{i % 5}", ("pass", "fail", "unknown")[i % 3], i % 6 == 0) for i in range(60)]
    runs = spark.createDataFrame(rows, "run_id int, collection string, task_key string, outcome string, suspicious boolean").withColumn("collection", F.lit("c"))
    first = sampling.daily_queue(runs, "2026-01-01").orderBy("place").collect()
    assert first == sampling.daily_queue(runs.repartition(5), "2026-01-01").orderBy("place").collect()
    assert len(first) == 20 == len({r["run_id"] for r in first}) and first != sampling.daily_queue(runs, "2026-01-02").orderBy("place").collect()
    paired = [dict(enumerate(rows))[r["run_id"]][2] for r in first if r["bucket"] == "pair"]
    assert len(paired) == 6 and all(paired.count(t) == 2 for t in paired)


def test_search_phrases(spark):
    steps = spark.createDataFrame([(1, 1, "The quick brown fox"), (1, 2, "brown quick"), (2, 1, "Café 中文字 quick brown"), (3, 1, None)], "run_id int, step int, text string")
    index = search.postings(steps)
    hit = lambda q: sorted((r["run_id"], r["step"]) for r in search.search(index, q).collect())
    assert hit('"quick brown"') == [(1, 1), (2, 1)] and hit("brown quick") == [(1, 1), (1, 2), (2, 1)] and hit("cafe") == [(2, 1)] and hit("文字") == [(2, 1)] and hit("") == [] and hit("none") == []


def test_word_diff():
    assert diffs.word_diff("a b c", "a x c") == [("same", "a "), ("removed", "b"), ("added", "x"), ("same", " c")]
    assert diffs.word_diff("abc", "xyz") == [("removed", "abc"), ("added", "xyz")] and diffs.word_diff("", "") == []
    assert diffs.line_counts("a\nb\n", "a\nc\nd\n") == (2, 1)
    for old, new in (("one two\nthree", "one 2\nthree four"), ("", "x"), ("same", "same")):
        parts = diffs.word_diff(old, new)
        assert "".join(t for op, t in parts if op != "added") == old and "".join(t for op, t in parts if op != "removed") == new


def test_alignment_and_gate(spark):
    a = spark.createDataFrame([("s", 1, "hello there", []), ("s", 2, "to be dropped", []), ("s", 3, "call", ["c1"]), ("s", 4, "the end of it all", [])], "sample_id string, step int, text string, call_ids array<string>")
    b = spark.createDataFrame([("s", 1, "hello there!", []), ("s", 2, "rewritten", ["c1"]), ("s", 3, "the end of it", []), ("s", 4, "zzz", [])], a.schema)
    got = {(r["old_step"], r["new_step"], r["how"]) for r in rewrites.align_steps(a, b).collect()}
    assert got == {(1, 1, "content"), (2, None, "removed"), (3, 2, "call"), (4, 3, "content"), (None, 4, "added")}
    assert rewrites.rising([(0, 2), (1, 0), (2, 1), (3, 3)]) == [(1, 0), (2, 1), (3, 3)]
    decide = lambda *v: spark.range(1).select(rewrites.gate(*map(F.lit, v)).alias("g")).first()["g"]
    wanted = [
        ((True, None, 0, 0, 0, 0, False, 0, None), "include", []),
        ((False, None, 0, 0, 0, 0, False, 0, None), "exclude", ["not compared"]),
        ((True, "failed", 1, 0, 0, 2, True, 0, None), "exclude", ["pipeline status", "changes judged wrong", "residue without an answer", "summary out of sync"]),
        ((True, None, None, 0, 0, 0, None, 3, "later"), "review", ["flagged changes without a verdict"]),
        ((True, None, 0, 1, 1, 0, False, 0, "include"), "include", ["decided", "changes missed", "residue confirmed"]),
    ]
    for given, decision, reasons in wanted:
        got = decide(*given)
        assert (got["decision"], [r["reason"] for r in got["reasons"]]) == (decision, reasons)


def test_replay(spark):
    import json

    j = json.dumps
    rows = [
        ("r", 1, "Write", j({"file_path": "a.html", "content": "<b>one</b>\n"}), False), ("r", 2, "Edit", j({"file_path": "a.html", "old_string": "one", "new_string": "two"}), False),
        ("r", 3, "Edit", j({"file_path": "a.html", "old_string": "missing", "new_string": "x"}), False), ("r", 4, "Write", j({"file_path": "a.html", "content": "failed"}), True),
        ("r", 5, "apply_patch", "*** Begin Patch\n*** Add File: b.txt\n+l1\n+l2\n*** Update File: a.html\n@@\n-<b>two</b>\n+<i>three</i>\n*** End Patch", False),
        ("r", 6, "Bash", j({"command": "cat > c.py <<'EOF'\nprint(1)\nEOF"}), False), ("r", 7, "Edit", j({"file_path": "new.md", "old_string": "q", "new_string": "w"}), False),
    ]
    versions = replay.file_versions(spark.createDataFrame(rows, "run_id string, call_index int, tool string, input string, is_error boolean"))
    got = {(v["path"], v["version"]): (v["content"], v["exact"]) for v in versions.collect()}
    assert got == {("a.html", 1): ("<b>one</b>\n", True), ("a.html", 2): ("<b>two</b>\n", True), ("a.html", 3): ("<b>two</b>\n", False), ("a.html", 4): ("<i>three</i>\n", False), ("b.txt", 1): ("l1\nl2\n", True), ("c.py", 1): ("print(1)\n", True), ("new.md", 1): ("", False)}
    assert replay.main_deliverable(versions).first()["path"] == "a.html"
    found = replay.text_introduced(versions, spark.createDataFrame([("r", "a.html", "two"), ("r", "a.html", "never")], "run_id string, path string, text string")).collect()
    assert {r["text"]: (r["introduced"], r["last_changed"]) for r in found} == {"two": (2, 4), "never": (None, None)}


def test_judge(spark):
    states = spark.createDataFrame([(1, 1, "all done", ["claims_done"]), (1, 2, "error seen", ["noticed_problem", "claims_done"]), (2, 1, "x", ["claims_done"])], "run_id int, step long, state string, questions array<string>")
    answers = judge.ask(states, judge.offline_client)
    assert {(r["run_id"], r["question"]): r["steps"] for r in judge.flagged_steps(answers).collect()} == {(1, "claims_done"): [1], (1, "noticed_problem"): [2]}
    failing = judge.ask(states, lambda s: [ValueError("down")] * len(s))
    assert failing.where("error = 'down'").count() == 4 and judge.cacheable(failing).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "s", "f1", "kept"), (2, "s", "f2", "lost"), (3, "t", "f3", "other")], "run_id int, source_id string, fingerprint string, judged string")
    new = spark.createDataFrame([(1, "s", "f1", None), (2, "s", "changed", None)], old.schema)
    assert {r["run_id"]: r["judged"] for r in upserts.replace_source(old, new, ["judged"]).collect()} == {1: "kept", 2: None, 3: "other"}
    merged = upserts.merge_fields(old, new.select("run_id", F.lit("z").alias("judged")), ["run_id"])
    assert {r["run_id"]: r["judged"] for r in merged.collect()} == {1: "z", 2: "z", 3: "other"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"n": 1}\nbroken\n{"n": 2}\n')
    seen = []
    for _ in range(2):
        imports.import_new(imports.stream_lines(spark, str(tmp_path / "in")), lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "ck")).awaitTermination(60)
        (tmp_path / "in" / "b.jsonl").write_text('{"n": 3}\n')
    assert [c for _, c in seen] == [2, 1]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_whole_tables_are_joined(spark):
    from loomtrail.plans import catalog

    queries = catalog.queries()
    lines = [tuple(r) for r in spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity * 100 as bigint)").collect()]
    spans, done = [], 0
    for key, n in sorted(Counter(r[0] for r in lines).items()):
        spans.append((done, done + n, key))
        done += n
    keys = [r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()]
    want = sorted((c, k) for c in keys for a, b, k in spans if a <= 2 * c < b)
    assert sorted(tuple(r) for r in queries["manifest_span_join_whole"](spark, SF).collect()) == want
    orders = defaultdict(list)
    for key, n, q in lines:
        orders[key].append((n, q))
    pairs = sorted((k, a, b) for k, of in orders.items() for a, p in of for b, q in of if a < b and abs(p - q) <= 900)
    assert sorted(tuple(r) for r in queries["overlapping_edits_whole"](spark, SF).collect()) == pairs
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source").collect()]
    related = sorted((a, b) for a, la, sa in docs if a % 100 == 0 for b, lb, sb in docs if la == lb and sa != sb)
    assert sorted(tuple(r) for r in queries["related_runs_each_hundredth"](spark, SF).collect()) == related
    assert sorted(tuple(r) for r in queries["related_runs"](spark, SF).collect()) == related


def test_spans_are_summed_in_several_partitions(spark):
    files = spark.createDataFrame([(i, i % 7) for i in range(1000)], "at int, records long")
    got = joins.spans_of(files, ["at"])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    ends = 0
    for at, records, end, start in sorted(tuple(r) for r in got.select("at", "records", "end_row", "start_row").collect()):
        assert (start, end) == (ends, ends + records), at
        ends = end


def test_rewards_below_the_top_tier_fail(spark):
    status = lambda *v: spark.range(1).select(scalars.reward_status(*[F.lit(x).cast(k) for x, k in zip(v, ("boolean", "int", "double"), strict=True)])).first()[0]
    assert [status(False, t, 0.5) for t in (0, 1, 3, 4, 5)] == ["fail", "fail", "fail", "pass", "pass"] and status(True, 4, 1.0) == status(False, 4, None) == "unknown"


def test_context_of_five_messages(spark):
    rows = [(1, "x" * 400, None, False), (2, "x" * 400, 5100, False), (3, "x" * 40, None, False), (4, "", None, True), (5, "x" * 8, None, False)]
    m = spark.createDataFrame([("r", s, t, c, z) for s, t, c, z in rows], "run_id string, step int, text string, context_tokens int, compaction boolean").withColumn("thinking", F.lit(None).cast("string"))
    got = [r["estimate"] for r in normalize.context_estimates(m).orderBy("step").collect()]
    assert got[0] == 0 and got[2] == 5200 and got[3] == 0
    s = normalize.context_summary(normalize.context_estimates(m)).first()
    assert (s["context_peak"], s["measured_steps"], s["compactions"]) == (5200, 1, 1)
    calls = spark.createDataFrame([("r", 1, "y" * 40, "z" * 360)], "run_id string, step int, input string, result_text string")
    assert normalize.context_estimates(m.where("step <> 2"), calls).where("step = 3").first()["estimate"] == 200


def test_next_steps_and_recovery_of_one_long_run(spark):
    steps = spark.range(1, 8).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("step"))
    got = {r["step"]: r["next_steps"] for r in sequences.next_steps(steps, F.col("step") % 2 == 0).collect()}
    assert got == {1: [2, 4], 2: [4, 6], 3: [4, 6], 4: [6], 5: [6], 6: [], 7: []}
    calls = spark.range(200_000).select(F.lit("r").alias("run_id"), F.col("id").alias("ts"), F.col("id").alias("call_id"), F.lit("t").alias("tool"), (F.col("id") % 10 < 9).alias("is_error"))
    found = sequences.error_recovery(calls).agg(F.count("*"), F.sum(F.col("recovered_by") - F.col("call_id")), F.max("attempts_later")).first()
    assert tuple(found) == (180_000, 20_000 * 45, 199_999)


def test_chains_of_any_depth_have_one_root(spark):
    rows = spark.range(300).select(F.col("id").alias("run_id"), F.concat(F.lit("k"), "id").alias("self_key"), F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id") - 1)).alias("parent_key"), F.lit(None).cast("string").alias("group_key"))
    assert {r["episode_key"] for r in episodes.episode_roots(rows).select("episode_key").distinct().collect()} == {"k0"}


def test_tasks_wrapped_in_json(spark):
    import json

    long = "x" * 400
    cases = {
        json.dumps({"prompt": "do", "rules": "r"}): ("do", "r"),
        f'Treat this JSON: {{"task": "do", "system": "s"}} {long}': ("do", f"Treat this JSON:\n{long}\ns"),
        f'An example {{"task": "do"}} {long}': (f'An example {{"task": "do"}} {long}', ""),
        f'{"y" * 601} {{"task": "do", "rules": "{long * 9}"}}': (f'{"y" * 601} {{"task": "do", "rules": "{long * 9}"}}', ""),
        '{"other": 1}': ('{"other": 1}', ""), "{not json": ("{not json", ""), None: ("", ""), " a ": ("a", ""),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", texts.split_task(F.col("x")).alias("t")).collect()
    assert {r["x"]: (r["t"]["task"], r["t"]["harness"]) for r in rows} == cases


def test_an_episode_as_a_tree(spark):
    rows = [("c", "e", "r1", "main", None), ("c", "e", "r2", "segment", 2), ("c", "e", "r4", "segment", 4), ("c", "e", "s1", "subagent", None), ("c", "e", "s2", "subagent", None)]
    members = spark.createDataFrame(rows, "collection string, episode_key string, run_id string, role string, segment int")
    launches = spark.createDataFrame([("s1", "r2", 9), ("s2", "r1", 3)], "run_id string, launched_by string, launched_at int")
    tree = episodes.episode_tree(members, launches, F.col("run_id") == "r4").orderBy(F.desc("lane"), "place").collect()
    assert [(t["kind"], t["segment"], t["run_id"], t["launched_by"], t["current"]) for t in tree] == [
        ("main", 0, "r1", None, False), ("segment", 2, "r2", None, False), ("missing", 3, None, None, False), ("segment", 4, "r4", None, True),
        ("subagent", 0, "s2", "r1", False), ("subagent", 0, "s1", "r2", False),
    ]


def test_related_runs_of_one_task_are_dealt_out(spark):
    rows = [(i, None if i % 97 == 0 else "one", None if i % 89 == 0 else f"e{i % 7}", f"v{i}") for i in range(2000)] + [(2000, "two", "e1", "v"), (2001, "two", "e2", "v"), (2001, "two", "e2", "v")]
    runs = spark.createDataFrame(rows, "run_id int, task_key string, episode_key string, more string").repartition(4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.related_runs(runs.where("run_id % 10 = 0"), runs)
        assert got.columns == ["task_key", "run_id", "episode_key", "more", "of_run"]
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        found = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = sorted((t, b, e, m, a) for a, of, own, _ in rows if a % 10 == 0 for b, t, e, m in rows if None not in (t, e, own) and t == of and e != own)
    assert found == want
    # the task that nearly all runs have isn't the work of one partition
    assert max(parts) < len(want) / 2


def test_differences_are_sent_in_runs(spark):
    import pandas as pd

    long = " ".join(f"w{i}" for i in range(800))
    old, new = pd.Series([long, None, "x"] * 100), pd.Series([f"{long} z", "y", None] * 100)
    runs = list(diffs.word_diff_of.func(iter([(old, new), (old[:0], new[:0])])))
    # a batch of Arrow isn't held at once, and nothing is lost or moved
    assert max(map(len, runs)) < 100 and sum(map(len, runs)) == 300
    assert runs[0][1] == [{"op": "added", "text": "y"}] and runs[0][2] == [{"op": "removed", "text": "x"}]
    rows = [(i, f"a b {i} c\nd", f"a x {i} c\ne\nf") for i in range(300)] + [(300, None, "y"), (301, "x", None), (302, None, None)]
    got = spark.createDataFrame(rows, "i int, a string, b string").repartition(2).select("i", diffs.word_diff_of("a", "b").alias("d"), diffs.line_delta("a", "b").alias("n"), F.size(diffs.regions_of("a", "b")).alias("r")).collect()
    want = {i: (diffs.word_diff(a or "", b or ""), diffs.line_counts(a or "", b or ""), len(diffs.regions(a or "", b or ""))) for i, a, b in rows}
    assert {r["i"]: ([tuple(x) for x in r["d"]], tuple(r["n"]), r["r"]) for r in got} == want

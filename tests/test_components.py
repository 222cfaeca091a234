"""Uses of components against a search for every name in every step."""

import json
import random
import re
import time

from loomtrail.operators import components as c

COMPONENTS = "run_id string, kind string, name string, tools array<string>"
MESSAGES = "run_id string, step int, role string, text string, thinking string"
CALLS = "run_id string, step int, call_index int, tool string, raw_name string, input string, result_text string"
PATH = re.compile(c.OUTPUT_PATH.replace("(?iU)", "(?i)"))


def brute_terms(parts):
    bases = [n.rsplit("/", 1)[-1] for _, k, n, _ in parts if k == "file"]
    out = []
    for _, kind, name, tools in parts:
        terms = {"mcp": {name, *tools, *(t.split("__")[-1] for t in tools)}, "file": {name} | ({name.rsplit("/", 1)[-1]} if bases.count(name.rsplit("/", 1)[-1]) == 1 else set())}
        out += [((kind, name), t) for t in terms.get(kind, {name, name.split("__")[-1]} if kind in ("tool", "skill", "subagent") else set()) if len(t) >= 5 and not t.isdigit()]
    return out


def brute(parts, messages, calls):
    terms, uses, outputs, seen = brute_terms(parts), {(k, n): {h: [] for h in ("calls", "files", "mentions", "outputs")} for _, k, n, _ in parts}, {}, []
    has = lambda text, t: re.search(r"(?<![\w.-])" + re.escape(t) + r"(?![\w-])", text)
    own = {t: (k, n) for _, k, n, tools in parts if k not in ("skill", "subagent") for t in tools}

    def note(who, how, step):
        if step not in uses[who][how]:
            uses[who][how].append(step)

    for _, step, role, text, thinking in sorted(messages, key=lambda m: m[1]):
        if role not in ("assistant", "tool"):
            continue
        mine = sorted((x for x in calls if x[1] == step), key=lambda x: x[2])
        for _, _, _, tool, raw, said, _ in mine:
            if raw in own:
                note(own[raw], "calls", step)
            elif tool.lower() == "skill" and ("skill", json.loads(said).get("skill")) in uses:
                note(("skill", json.loads(said)["skill"]), "calls", step)
            for who, t in terms:
                if who[0] == "file" and has(said, t):
                    note(who, "files", step)
            for path, who in outputs.items():
                if has(said, path):
                    note(who, "outputs", step)
            seen.append(said)
        prose = "\n".join(x for x in (thinking, text) if x is not None)
        for who, t in terms:
            if has(prose, t):
                note(who, "mentions", step)
        for path, who in outputs.items():
            if has(prose, path):
                note(who, "outputs", step)
        seen.append(prose)
        for _, _, _, _, raw, _, result in mine:
            for m in PATH.finditer((result or "")[: c.RESULT]):
                if raw in own and len(m[1]) >= 5 and m[1] not in outputs and not any(m[1] in s for s in seen) and m[1] not in [t for w, t in terms if w[0] == "file"]:
                    outputs[m[1]] = own[raw]
    return {(who, how): steps for who, ways in uses.items() for how, steps in ways.items()}


def test_uses_are_those_of_a_search_for_every_name(spark, monkeypatch):
    monkeypatch.setattr(c, "STRETCH", 7)
    r = random.Random(4)
    names = ["cards", "guide", "cards/tide-chart.json", "other/tide-chart.json", "cards/moon.json", "bench", "12345", "tiny", "mcp__bench__render", "Expert"]
    words = [*names, "render", "moon.json", "tide-chart.json", "xcards", "cards-x", "see", ".cards", "out/a.png", "out/b.png", "(cards)", "/w/cards/moon.json", "中cards", "é"]
    parts = {
        f"r{n}": [(f"r{n}", k, name, tools) for k, name, tools in [("mcp", "bench", ["mcp__bench__render"]), ("file", "cards/tide-chart.json", []), ("file", "other/tide-chart.json", []), ("file", "cards/moon.json", []), ("skill", "guide", ["Skill"]), ("tool", "cards", ["cards"]), ("tool", "12345", []), ("instruction", "Expert", [])] if r.random() < 0.9]
        for n in range(12)
    }
    messages, calls = [], []
    for run in parts:
        for step in range(1, 30):
            said = lambda k=6: " ".join(r.choice(words) for _ in range(r.randrange(k)))
            messages.append((run, step, r.choice(["assistant", "assistant", "tool", "user"]), said(), r.choice([None, said()])))
            if messages[-1][2] in ("assistant", "tool"):
                for nth in range(r.randrange(3)):
                    raw = r.choice(["mcp__bench__render", "Read", "Skill", "cards"])
                    result = said() + r.choice(["", f" made out/{r.choice('abcd')}.png and out/{r.choice('abcd')}.png"])
                    calls.append((run, step, nth, raw.split("__")[-1], raw, json.dumps({"skill": r.choice(["guide", "x"])}) if raw == "Skill" else said(), result))
    frames = (spark.createDataFrame([p for ps in parts.values() for p in ps], COMPONENTS), spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(calls, CALLS))
    got = {}
    for row in c.component_uses(*frames).collect():
        for how in ("calls", "files", "mentions", "outputs"):
            got[row["run_id"], ((row["kind"], row["name"]), how)] = row[how]
    want = {(run, k): v for run, ps in parts.items() for k, v in brute(ps, [m for m in messages if m[0] == run], [x for x in calls if x[0] == run]).items()}
    assert got == want
    assert sum(len(v) for (_, (_, how)), v in got.items() if how == "outputs") > 5


def test_files_that_the_agent_writes_are_no_components(spark):
    write = lambda path: json.dumps({"file_path": path, "content": "x"})
    calls = spark.createDataFrame([("r", 1, 1, "Write", "Write", write("/work/page/artifact.html"), ""), ("r", 2, 2, "Read", "Read", json.dumps({"file_path": "notes/plan.md"}), ""), ("r", 3, 3, "Bash", "Bash", json.dumps({"command": "echo x > out/list.txt"}), "")], CALLS)
    files = [("r", "file", n, []) for n in ("artifact.html", "plan.md", "out/list.txt", "fact.html", "page/artifact.html")]
    frame = spark.createDataFrame(files, COMPONENTS)
    assert {x["name"] for x in c.written_files(frame, calls).collect()} == {"artifact.html", "page/artifact.html", "out/list.txt"}
    messages = spark.createDataFrame([("r", 1, "assistant", "the artifact.html and plan.md", None)], MESSAGES)
    uses = {x["name"]: (x["files"], x["mentions"]) for x in c.component_uses(frame, messages, calls).collect()}
    assert uses["artifact.html"] == ([], []) and uses["plan.md"] == ([2], [1])


def test_stems_name_a_file_if_asked(spark):
    frame = spark.createDataFrame([("r", "file", "inputs/cards/tide-chart-card.json", []), ("r", "file", "inputs/short.json", [])], COMPONENTS)
    assert "tide-chart-card" in {x["term"] for x in c.component_terms(frame, stems=True).collect()} and "short" not in {x["term"] for x in c.component_terms(frame, stems=True).collect()}
    assert "tide-chart-card" not in {x["term"] for x in c.component_terms(frame).collect()}


def test_many_names_and_steps_take_time_in_proportion(spark):
    r = random.Random(1)
    frame = lambda n: spark.createDataFrame([("r", "skill", f"skill-number-{i}", []) for i in range(n)], COMPONENTS)
    messages = spark.createDataFrame([("r", s, "assistant", " ".join(f"word{r.randrange(999)}" for _ in range(200)) + f" skill-number-{s % 500}", None) for s in range(2000)], MESSAGES)
    calls = spark.createDataFrame([], CALLS)
    began = time.perf_counter()
    rows = c.component_uses(frame(500), messages, calls).collect()
    assert time.perf_counter() - began < 30 and sum(len(x["mentions"]) for x in rows) == 2000
    assert c.component_uses(frame(3), messages.limit(0), calls).count() == 3

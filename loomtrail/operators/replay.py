"""Replay of file changes that tool calls made, and the trace of added components."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: tools that write and edit files, marks of a patch, a here-document that writes a file
_WRITES = frozenset("write write_file create_file".split())
_EDITS = frozenset("edit multiedit edit_file str_replace str_replace_editor str_replace_based_edit_tool replace".split())
_PATCH = re.compile(r"^\*\*\* (Update|Add|Delete) File: (.+)$", re.M)
_HEREDOC = re.compile(r"cat\s*>\s*(\S+)\s*<<\s*['\"]?(\w+)['\"]?\n(.*?)\n\2\b", re.S)

VERSIONS = "run_id string, path string, version int, call_index int, action string, exact boolean, content string"


def file_versions(calls: DataFrame) -> DataFrame:
    """(run_id, path, version, call_index, action, exact, content): every version that calls gave a file.

    Calls are replayed in order, run by run, on texts only: nothing is executed and no file is touched. Failed
    calls change nothing. Where what was there before isn't known, or an edit's old text isn't found, the version
    is marked as not exact and keeps what is known.
    """

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("call_index")
        files: dict[str, tuple[str, bool]] = {}
        rows, counts = [], {}
        for run, index, tool, text, failed in zip(group["run_id"], group["call_index"], group["tool"], group["input"], group["is_error"], strict=True):
            if failed:
                continue
            for path, action, change in changes_of((tool or "").lower(), text or ""):
                content, exact = change(*files.get(path, ("", action in ("write", "add"))))
                files[path] = content, exact
                counts[path] = counts.get(path, 0) + 1
                rows.append((str(run), path, counts[path], index, action, exact, content))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in VERSIONS.split(", ")])

    return calls.groupBy("run_id").applyInPandas(replay, VERSIONS)


def changes_of(tool: str, text: str) -> list[tuple]:
    """(path, action, function from (content, exact) to the same) for each file that a call changes."""
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    if not isinstance(value, dict):
        return _patched(value) if isinstance(value, str) else []
    path = next((value[k] for k in ("file_path", "path", "filename", "target_file") if isinstance(value.get(k), str)), None)
    command = value.get("command")
    if path and (tool in _WRITES or command == "create"):
        content = value.get("content", value.get("file_text", ""))
        return [(path, "write", lambda *_: (str(content), True))]
    if path and command == "insert":
        return [(path, "insert", lambda old, exact: (_inserted(old, int(value.get("insert_line", 0)), str(value.get("new_str", ""))), exact))]
    if path and (tool in _EDITS or command == "str_replace"):
        edits = value.get("edits") if isinstance(value.get("edits"), list) else [value]
        return [(path, "edit", lambda old, exact: _edited(old, exact, edits))]
    said = next((value[k] for k in ("command", "cmd", "script", "input", "patch") if isinstance(value.get(k), str | list)), "")
    said = " ".join(map(str, said)) if isinstance(said, list) else said
    return _patched(said) + [(m[1], "write", lambda *_, m=m: (m[3] + "\n", True)) for m in _HEREDOC.finditer(said)]


def _edited(content: str, exact: bool, edits: list[dict]) -> tuple[str, bool]:
    for e in edits:
        old, new = e.get("old_string", e.get("old_str", "")), e.get("new_string", e.get("new_str", ""))
        if not old:
            content = new + content
        elif old in content:
            content = content.replace(old, new) if e.get("replace_all") else content.replace(old, new, 1)
        else:
            exact = False
    return content, exact


def _inserted(content: str, line: int, new: str) -> str:
    lines = content.splitlines(keepends=True)
    return "".join([*lines[:line], new if new.endswith("\n") else new + "\n", *lines[line:]])


def _patched(text: str) -> list[tuple]:
    marks = list(_PATCH.finditer(text))
    out = []
    for n, m in enumerate(marks):
        body = text[m.end() + 1 : marks[n + 1].start() if n + 1 < len(marks) else len(text)].split("*** End Patch")[0]
        if m[1] == "Add":
            added = "".join(x[1:] + "\n" for x in body.splitlines() if x.startswith("+"))
            out.append((m[2].strip(), "add", lambda *_, added=added: (added, True)))
        elif m[1] == "Delete":
            out.append((m[2].strip(), "delete", lambda *_: ("", True)))
        else:
            out.append((m[2].strip(), "patch", lambda old, exact, body=body: _hunks(old, exact, body)))
    return out


def _hunks(content: str, exact: bool, body: str) -> tuple[str, bool]:
    for hunk in re.split(r"^@@.*$", body, flags=re.M):
        lines = [x for x in hunk.splitlines() if x and x[0] in " +-"]
        old = "".join(x[1:] + "\n" for x in lines if x[0] in " -")
        new = "".join(x[1:] + "\n" for x in lines if x[0] in " +")
        if lines and old in content:
            content = content.replace(old, new, 1)
        elif lines:
            exact = False
    return content, exact


def main_deliverable(versions: DataFrame) -> DataFrame:
    """(run_id, path, versions): the file that matters most in each run, HTML first, then the most versions."""
    files = versions.groupBy("run_id", "path").agg(F.max("version").alias("versions"))
    best = files.groupBy("run_id").agg(F.max(F.struct(F.lower("path").rlike(r"\.html?$").alias("html"), "versions", "path")).alias("b"))
    return best.select("run_id", F.col("b.path").alias("path"), F.col("b.versions").alias("versions"))


def last_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("run_id", "path").agg(F.max_by(F.struct("content", "exact", "version"), "version").alias("v")).select("run_id", "path", "v.*")


def compare_with_kept(versions: DataFrame, kept: DataFrame) -> DataFrame:
    """Last versions beside the files that were kept: same, differs, or not kept."""
    j = last_versions(versions).join(kept.select("run_id", "path", F.col("content").alias("kept")), ["run_id", "path"], "left")
    return j.withColumn("verdict", F.when(F.col("kept").isNull(), "not kept").when(F.col("kept") == F.col("content"), "same").otherwise("differs"))


def text_introduced(versions: DataFrame, texts: DataFrame) -> DataFrame:
    """texts: (run_id, path, text). The version that first has a text, and the last one that added or removed it."""
    j = versions.join(texts, ["run_id", "path"]).withColumn("has", F.contains("content", "text"))
    w = Window.partitionBy("run_id", "path", "text").orderBy("version")
    changed = j.withColumn("_was", F.coalesce(F.lag("has").over(w), F.lit(False)))
    return changed.groupBy("run_id", "path", "text").agg(F.min(F.when(F.col("has"), F.col("version"))).alias("introduced"), F.max(F.when(F.col("has") != F.col("_was"), F.col("version"))).alias("last_changed"))


def looks_after(checks: DataFrame, versions: DataFrame, looks: DataFrame) -> DataFrame:
    """Failed checks with the last change before them of their text's file and how many looks came after it.

    checks: (run_id, path, check, text); looks: (run_id, call_index).
    """
    traced = text_introduced(versions, checks.select("run_id", "path", "text").distinct())
    at = versions.select("run_id", "path", F.col("version").alias("last_changed"), F.col("call_index").alias("edited_at"))
    linked = checks.join(traced, ["run_id", "path", "text"], "left").join(at, ["run_id", "path", "last_changed"], "left")
    counted = linked.join(looks.select("run_id", F.col("call_index").alias("_look")), "run_id", "left").groupBy(*linked.columns).agg(F.count_if(F.col("_look") > F.col("edited_at")).alias("looks"))
    return counted.withColumn("verdict", F.when(F.col("introduced").isNull(), "untraceable").when(F.col("looks") > 0, "looked").otherwise("never"))


def component_inventory(calls: DataFrame, stock: list[str]) -> DataFrame:
    """(run_id, kind, name): what the harness added, by the calls made: MCP servers, skills, subagents, other tools."""
    raw, value = F.col("raw_name"), F.try_parse_json("input")
    kind = F.when(raw.startswith("mcp__"), "mcp").when(F.lower("tool").isin("skill", "use_skill", "load_skill"), "skill").when(F.lower("tool").isin("agent", "task", "spawn_agent"), "subagent").when(~F.lower("tool").isin(*stock), "tool")
    name = F.when(raw.startswith("mcp__"), F.split(raw, "__")[1]).when(kind == "skill", F.coalesce(F.try_variant_get(value, "$.skill", "string"), F.try_variant_get(value, "$.name", "string"))).when(kind == "subagent", F.try_variant_get(value, "$.subagent_type", "string")).otherwise(F.col("tool"))
    return calls.select("run_id", kind.alias("kind"), name.alias("name")).where("kind IS NOT NULL AND name IS NOT NULL").distinct()


def component_trace(components: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, kind, name, calls, mentions): the steps at which model turns call a component or name it.

    Names are looked for as a substring first and as a whole word then; the join is by run, so that only a run's
    own components meet its steps.
    """
    turns = messages.where(F.col("role").isin("assistant", "tool")).select("run_id", "step", F.concat_ws("\n", "text", "thinking").alias("_said"))
    word = F.concat(F.lit(r"(?i)(?<![\w-])\Q"), F.col("name"), F.lit(r"\E(?![\w-])"))
    named = components.join(turns, "run_id").where(F.contains(F.lower("_said"), F.lower("name"))).where(F.regexp(F.col("_said"), word)).groupBy("run_id", "kind", "name").agg(F.array_sort(F.collect_set("step")).alias("mentions"))
    used = components.join(calls.select("run_id", "step", "raw_name", "input"), "run_id").where(F.contains("raw_name", "name") | F.contains("input", "name")).groupBy("run_id", "kind", "name").agg(F.array_sort(F.collect_set("step")).alias("calls"))
    keys = ["run_id", "kind", "name"]
    none = F.array().cast("array<int>")
    return components.join(used, keys, "left").join(named, keys, "left").select(*keys, F.coalesce(F.col("calls").cast("array<int>"), none).alias("calls"), F.coalesce(F.col("mentions").cast("array<int>"), none).alias("mentions"))

"""Rule flags of a run: loops, blind retries, unverified and test edits, infrastructure errors, redundancy, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_tool, command_text, harness_layer
from . import sequences

# fixed values: tools that change files, shells, tools that create files
MUTATING = ("write", "edit", "multiedit", "notebookedit", "apply_patch", "write_file", "edit_file", "create_file", "str_replace", "str_replace_editor", "str_replace_based_edit_tool", "replace", "patch")
SHELLS = ("bash", "shell", "exec_command", "local_shell", "run_command", "execute_command", "terminal", "exec", "run_shell_command")
CREATING = ("write", "write_file", "create_file")
PATH_KEYS = ("file_path", "path", "filename", "notebook_path", "target_file")
# fixed values: patterns of shell commands that change files or check them, of checking tools, test paths, failures of
# the infrastructure, and filler
SHELL_MUTATION = (
    r"(?U)(?:^|[^<>&=0-9-])>{1,2}\s*(?!/dev/null)[\"']?[\w~.-]*[./][\w./~-]+|\btee\b|\bsed\s+-i|\bperl\s+-p?i|"
    r"\bgit\s+apply\b|\bapply_patch\b|\bpatch\s+-p|\bcp\s|\bmv\s|\brm\s|\bmkdir\s|\btouch\s|write_text\(|open\([^)]*['\"]w"
)
CHECK_COMMAND = (
    r"(?iU)\b(pytest|unittest|tox|nox|npm\s+(run\s+)?test|yarn\s+test|pnpm\s+test|node\s+--test|node\s+--check|jest|vitest|mocha|go\s+test|go\s+vet|"
    r"cargo\s+(test|check|clippy)|make\s+(test|check)|ruff|mypy|pyright|tsc|eslint|flake8|py_compile|compileall|playwright|puppeteer|chromium|headless|"
    r"screenshot|lighthouse|html-validate|validator|curl\s|wget\s|diff\s|cmp\s|sha256sum|shasum|python3?\s+-c|node\s+-e|verify|validate|lint|\w*test\w*)"
)
CHECK_TOOLS = r"(?i)screenshot|browser_|playwright|puppeteer|workbench|review|verify|validate|inspect|^read$|^view$|read_file|^glob$|^grep$"
TEST_PATH = (
    r"(?i)(^|/)(tests?|__tests__|spec|specs|eval|evals|grader|graders|verifier)(/|$)|"
    r"(^|/)(test_[^/]+\.py|[^/]+_test\.(py|go)|[^/]+\.(test|spec)\.[jt]sx?|conftest\.py)$|(^|/)reward(\.txt|\.json)?$"
)
INFRA = (
    r"(?im)ETIMEDOUT|ECONNRESET|ECONNREFUSED|connection (reset|refused|lost|aborted|closed)|502 Bad Gateway|503 Service|504 Gateway|gateway time-?out|"
    r"rate[ _-]?limit|429 Too Many|No space left on device|\bOOMKilled\b|out of memory|Cannot allocate memory|network is unreachable|"
    r"Temporary failure in name resolution|Could not resolve host|overloaded_error|API Error|internal server error|sandbox (error|unavailable|crashed)|Killed\s*$"
)
FILLER = (
    r"(?i)\b(sorry|apologi[sz]e|my apologies|let me double[- ]check|let me re-?verify|to be safe, let me|I (have|'ve) (now )?(verified|confirmed) (again|once more))\b|"
    r"抱歉|对不起|让我再(确认|检查)一下"
)
_ADDED = r"\*\*\* Add File: ([^\s\\\"'`]+)"
_PATCHED = r"\*\*\* (?:Update|Add|Delete) File: ([^\s\\\"'`]+)"
_REDIRECT = r">{1,2}\s*([\w./~-]+)"


def touched_paths(tool: Column, tool_input: Column) -> Column:
    """Paths that a call names: under five keys, in patch headers, and behind shell redirections."""
    value = F.try_parse_json(tool_input)
    keyed = F.array_compact(F.array(*[F.try_variant_get(value, f"$.{k}", "string") for k in PATH_KEYS]))
    said = command_text(tool_input)
    shell = F.when(base_tool(tool).isin(*SHELLS), F.regexp_extract_all(said, F.lit(_REDIRECT), 1)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(keyed, F.regexp_extract_all(said, F.lit(_PATCHED), 1), shell))


def is_mutation(tool: Column, tool_input: Column) -> Column:
    name = base_tool(tool)
    command = F.try_variant_get(F.try_parse_json(tool_input), "$.command", "string")
    changed = F.coalesce(command.isin("create", "str_replace", "insert"), F.lit(False))
    return F.when(name.isin(*MUTATING), True).when(name.isin(*SHELLS), command_text(tool_input).rlike(SHELL_MUTATION)).otherwise(changed)


def is_check(tool: Column, tool_input: Column, paths: Column, changed: Column) -> Column:
    """Whether a call checks earlier changes (``changed``: paths): a checking command or tool, or reading one back."""
    name, said = base_tool(tool), command_text(tool_input)
    named = F.exists(F.filter(F.transform(changed, lambda p: F.element_at(F.split(p, "/"), -1)), lambda n: F.length(n) > 3), lambda n: F.contains(said, n))
    shell = F.when(said.rlike(CHECK_COMMAND), True).when(is_mutation(tool, tool_input), False).otherwise(named)
    reads = (F.size(changed) == 0) | F.arrays_overlap(paths, changed)
    return F.coalesce(F.when(name.isin(*SHELLS), shell).when(name.isin("read", "view", "read_file"), reads).otherwise(name.rlike(CHECK_TOOLS) | tool.rlike(CHECK_TOOLS)), F.lit(False))


def edits(calls: DataFrame, order: tuple[str, ...] = ("call_index",)) -> DataFrame:
    """Calls with their paths, whether they change files, the paths that they create, and test paths edited that the run
    didn't create before.

    The first creation of a path in a run is joined to the edits of it, so that no call gathers all earlier paths."""
    marked = calls.withColumn("paths", touched_paths(F.col("tool"), F.col("input"))).withColumn("mutation", is_mutation(F.col("tool"), F.col("input")))
    creates = base_tool(F.col("tool")).isin(*CREATING) | (F.coalesce(F.try_variant_get(F.try_parse_json("input"), "$.command", "string"), F.lit("")) == "create")
    added = F.regexp_extract_all(command_text(F.col("input")), F.lit(_ADDED), 1)
    none = F.array().cast("array<string>")
    marked = marked.withColumn("creates", F.when(F.col("mutation"), F.when(creates, F.col("paths")).otherwise(added)).otherwise(none))
    created = marked.select("run_id", F.explode("creates").alias("_path"), F.struct(*order).alias("_at")).groupBy("run_id", "_path").agg(F.min("_at").alias("_created"))
    tests = F.filter(F.array_except("paths", "creates"), lambda p: p.rlike(TEST_PATH))
    touched = marked.where("mutation").select("run_id", *order, F.struct(*order).alias("_at"), F.explode(tests).alias("_path"))
    edited = touched.join(created, ["run_id", "_path"], "left").where("_created IS NULL OR _created >= _at")
    edited = edited.groupBy("run_id", *order).agg(F.array_sort(F.collect_set("_path")).alias("test_edits"))
    return marked.join(edited, ["run_id", *order], "left").withColumn("test_edits", F.coalesce("test_edits", none))


def verification(calls: DataFrame, order: tuple[str, ...] = ("call_index",)) -> DataFrame:
    """(run_id, last_mutation, verified_at): the last changing call of each run and the first check of it, if any."""
    marked = edits(calls, order).withColumn("_at", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    last = marked.where("mutation").groupBy("run_id").agg(F.max(F.struct("_at", "paths", "step")).alias("last"))
    later = marked.join(last, "run_id").where(F.col("_at") > F.col("last._at"))
    checks = later.where(is_check(F.col("tool"), F.col("input"), F.col("paths"), F.col("last.paths"))).groupBy("run_id").agg(F.min_by("step", "_at").alias("verified_at"))
    return last.join(checks, "run_id", "left").select("run_id", F.col("last.step").alias("last_mutation"), "verified_at")


def layers(calls: DataFrame) -> DataFrame:
    """Calls of each run by the layer that they come from."""
    layer = harness_layer(F.col("raw_name"))
    return calls.groupBy("run_id").agg(*[F.count_if(layer == n).alias(n) for n in ("base", "mcp", "skill", "subagent")])


def flags(messages: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, flags): for each run an array of (key, severity, steps). runs has outcome and role.

    Steps are the places in the transcript that tell of the flag, at most fifty.
    """
    indexed = calls.withColumn("ts", F.col("call_index"))
    streak = sequences.longest_identical_streak(indexed.withColumn("call_id", F.col("call_index")), 3)
    steps_of = lambda rows: rows.groupBy("run_id", "key", "severity").agg(F.slice(F.array_sort(F.collect_set(F.col("step").cast("int"))), 1, 50).alias("steps"))
    found = lambda rows, key, severity: rows.select("run_id", F.lit(key).alias("key"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), "step")
    looped = indexed.join(streak.select("run_id", "streak", "first_index"), "run_id").where((F.col("call_index") >= F.col("first_index")) & (F.col("call_index") < F.col("first_index") + F.col("streak")))
    retries = sequences.blind_retries(indexed.withColumn("call_id", F.col("call_index"))).select("run_id", F.col("retry_id").alias("call_index"))
    edited = edits(calls)
    unverified = verification(calls).where("verified_at IS NULL").select("run_id", F.col("last_mutation").alias("step"))
    graded = F.when(F.coalesce(F.col("outcome"), F.lit("unknown")) == "unknown", "info").otherwise("bad")
    tests = edited.where(F.size("test_edits") > 0).join(runs.select("run_id", "outcome"), "run_id", "left")
    failures = calls.where(F.right(F.coalesce("result_text", F.lit("")), F.lit(4000)).rlike(INFRA)).select("run_id", "step").unionByName(messages.where(F.col("role").isin("system", "result") & F.col("text").rlike(INFRA)).select("run_id", "step"))
    turns = messages.where(F.col("role").isin("assistant", "tool"))
    filler = turns.where(F.concat_ws("\n", "text", "thinking").rlike(FILLER)).select("run_id", "step", F.lit(1).alias("kind"))
    again = sequences.duplicate_paragraphs(turns).select("run_id", "step", F.lit(2).alias("kind"))
    many = filler.unionByName(again).withColumn("_f", F.count_if(F.col("kind") == 1).over(Window.partitionBy("run_id"))).withColumn("_d", F.count_if(F.col("kind") == 2).over(Window.partitionBy("run_id"))).where("_d >= 2 OR _f >= 3")
    sub = edited.where("mutation").join(runs.where(F.col("role") == "subagent").select("run_id"), "run_id", "left_semi")
    rows = [
        found(looped, "loop", "warn"), found(indexed.join(retries, ["run_id", "call_index"]), "blind_retry", "warn"), found(unverified, "no_verify", "warn"), found(tests, "test_edit", graded),
        found(failures, "infra_error", "info"), found(many, "redundancy", "info"), found(sub, "subagent_edit", "info"),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    by_run = steps_of(every).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("key", "severity", "steps"))).alias("flags"))
    return runs.select("run_id").join(by_run, "run_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<struct<key:string,severity:string,steps:array<int>>>")))

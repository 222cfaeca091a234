"""Scalar expressions over texts, scores and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens of an image, masks of error lines in the order in which they apply
IMAGE_TOKENS = 1500
MASKS = (
    (r"<tool_use_error>|</tool_use_error>", ""),
    (r"https?://\S+", "<url>"),
    (r"(?:[A-Za-z]:)?(?:~|\.{1,2})?/[\w.@%+~\-/]+", "<path>"),
    (r"\b[\w.-]+\.(?:py|js|ts|tsx|jsx|mjs|json|html|css|md|txt|png|jpg|svg|yaml|yml|toml|sh|go|rs|java)\b", "<file>"),
    (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{8,}\b", "<hex>"),
    (r"'[^'\n]{0,200}'|\"[^\"\n]{0,200}\"|`[^`\n]{0,200}`", "<str>"),
    (r"\d+(?:\.\d+)?", "<n>"),
    (r"\s+", " "),
)
# fixed values: words that name an error; lines about a command as such; exception names that mean the infrastructure
ERROR_WORDS = r"(?iu)error|exception|fail|not found|no such|denied|cannot|can't|invalid|refused|timed? ?out|unknown|missing|not allowed|blocked|requires approval|does not exist|undefined"
COMMAND_LINES = r"(?i)^(?:Exit code:?\s*-?\d+|Process exited with code -?\d+|Script (?:failed|error|completed).*|Script running with cell ID.*|Wall time.*|Output:|Chunk ID.*)$"
_LINE_END = r"\r\n|\n|\r"
INFRA_EXCEPTION = r"(?iu)environment|docker|sandbox|container|connection|network|gateway|provision|ratelimit|rate_limit|overloaded|apierror|api_error|stream"


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text: four ASCII characters make one, other scripts one and a half; half to even."""
    other = (F.octet_length(text) - F.length(text)) / 2
    return F.bround((F.length(text) - other) / 4 + other / 1.5).cast("long")


def base_tool(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "__"), -1))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys; text that isn't JSON stays."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def clip(text: Column, size: int, marker: str = " … ") -> Column:
    """At most ``size`` characters of a text: 65 % from its head, the rest from its tail, a marker between."""
    head = int(size * 0.65)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(size - head))))


def task_key(task_id: Column, instruction: Column) -> Column:
    """``id:`` and the task's id, else ``h:`` and a digest of the instruction in lower case, spaces folded."""
    folded = F.substring(F.trim(F.regexp_replace(F.lower(instruction), r"\s+", " ")), 1, 1500)
    digest = F.concat(F.lit("h:"), F.substring(F.sha1(folded.cast("binary")), 1, 16))
    return F.when(task_id.isNotNull() & (task_id != ""), F.concat(F.lit("id:"), task_id)).when(folded != "", digest)


def score_status(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 1, "pass").when(score <= 0, "fail").otherwise("partial")


def reward_status(masked: Column, tier: Column, r: Column) -> Column:
    """A masked reward is unknown, never 0; only tier 4 and above passes."""
    return F.when(masked | r.isNull(), "unknown").when(tier >= 4, "pass").otherwise("fail")


def consistency(claims_done: Column, outcome: Column) -> Column:
    return F.when(claims_done & outcome.isin("fail", "error"), "overclaim").when(~claims_done & (outcome == "pass"), "underclaim")


def tool_error(text: Column) -> Column:
    """Whether a tool's output without an error flag tells of a failure."""
    head = F.substring(text, 1, 4000)
    exit_code = F.regexp_extract(head, r"^\s*Exit code:? ?(-?\d+)\b", 1)
    named = head.rlike(r"^\s*(?:<tool_use_error>|Script failed\b|failed to parse function arguments|[Ee]rror:)")
    process = F.regexp_extract(F.substring(head, 1, 600), r"Process exited with code (-?\d+)", 1)
    mcp = F.regexp_instr(head, F.lit(r'(?s)\{\s*\\?"content\\?"\s*:\s*\[.*?\\?"isError\\?"\s*:\s*true'))
    found = F.when(exit_code != "", exit_code.cast("int") != 0).when(named, True).when(process != "", process.cast("int") != 0).otherwise((mcp > 0) & (mcp <= 300))
    return F.coalesce(found, F.lit(False))


def error_template(text: Column) -> Column:
    """The line of an error output that tells most, with what varies masked. Lines about the command as such are left out; of
    a result object the texts in its content count."""
    trimmed = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    lines = F.filter(trimmed(F.slice(F.split(text, _LINE_END), 1, 200)), lambda x: ~x.rlike(COMMAND_LINES))
    parts = F.try_variant_get(F.try_parse_json(F.array_join(lines, "\n")), "$.content", "array<variant>")
    said = trimmed(F.split(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), " "), _LINE_END))
    lines = F.when(F.get(lines, F.lit(0)).startswith("{") & (F.size(said) > 0), said).otherwise(lines)
    first = F.get(lines, F.lit(0))
    last = F.element_at(lines, -1)
    raised = F.element_at(F.filter(lines, lambda x: ~(x.startswith("File ") | x.startswith("^") | x.startswith("~"))), -1)
    named = F.get(F.filter(F.slice(lines, 1, 60), lambda x: x.rlike(ERROR_WORDS)), F.lit(0))
    line = F.when(F.size(lines) == 0, F.lit("")).when(first.startswith("Traceback"), F.coalesce(raised, first)).when(first.rlike(ERROR_WORDS), first).otherwise(F.coalesce(named, last))
    line = F.substring(line, 1, 240)
    for pattern, mask in MASKS:
        line = F.regexp_replace(line, pattern, mask)
    line = F.substring(F.trim(line), 1, 160)
    return F.when(line != "", line).otherwise("(empty error output)")


def infra_failure(name: Column) -> Column:
    """True for exceptions of the infrastructure, null where there is no name."""
    return F.when(name.isNotNull() & (name != ""), name.rlike(INFRA_EXCEPTION))


def command_text(tool_input: Column) -> Column:
    """The command in a tool's JSON input: under one of five keys, list parts joined; a plain string is itself."""
    value = F.try_parse_json(tool_input)
    found = [F.try_variant_get(value, f"$.{k}", "string") for k in ("command", "cmd", "script", "input", "code")]
    lists = [F.array_join(F.try_variant_get(value, f"$.{k}", "array<string>"), " ") for k in ("command", "cmd", "script", "input", "code")]
    return F.coalesce(*[c for pair in zip(lists, found, strict=True) for c in pair], F.when(value.isNull(), tool_input), F.lit(""))


def harness_layer(raw_name: Column, native: tuple[str, ...] = ()) -> Column:
    """Where a call comes from: base agent, MCP server, skill or subagent."""
    name = base_tool(raw_name)
    added = raw_name.contains("__") & ~raw_name.startswith("collaboration__") & ~(name.isin(*native) if native else F.lit(False))
    return (
        F.when(raw_name.startswith("mcp__") | added, "mcp")
        .when(name.isin("skill", "use_skill", "load_skill"), "skill")
        .when(name.isin("agent", "task", "spawn_agent", "send_message") | raw_name.startswith("collaboration__"), "subagent")
        .otherwise("base")
    )


def timestamp_ms(value: Column) -> Column:
    """Epoch milliseconds of seconds, milliseconds or ISO-8601 text."""
    number = value.try_cast("double")
    return F.coalesce(F.when(number < 1e11, number * 1000).otherwise(number).cast("long"), F.unix_millis(F.try_to_timestamp(value)))


def tool_signature(tool: Column, path: Column) -> Column:
    return F.when(path.isNotNull() & (path != ""), F.concat(tool, F.lit(":"), F.element_at(F.split(path, "/"), -1))).otherwise(tool)


def squash(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def warning_type(warning: Column) -> Column:
    return F.element_at(F.split(warning, ":"), 1)

"""Text expressions: requirements in instructions, metadata blocks, excerpts."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: fields of a wrapped task, those with the harness's rules, letters around a wrapper, its least share of the text
TASK_FIELDS = ("context", "prompt", "request", "task", "query", "user_request", "instruction")
HARNESS_FIELDS = ("instructions", "system", "harness_instructions", "rules")
MOST_FRAMING, LEAST_SHARE = 600, 0.6

# fixed values: words that make a sentence a likely requirement
HINTS = r"(?iu)\b(must|should|need|required?|ensure|make sure|at least|at most|exactly|only|never|always|do not|don't|avoid|include|without)\b|必须|需要|应该|不要|至少|最多|确保|避免|包含"


def width(text: Column) -> Column:
    """Characters, those of CJK scripts count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[㐀-鿿豈-﫿぀-ヿ가-힯]"))


def requirement_candidates(instruction: Column, most: int = 30, least_width: int = 12) -> Column:
    """Sentences and list items that may be requirements, in order, each once, those with hints first if there are too
    many."""
    marked = F.regexp_replace(instruction, r"(?<=[.!?])\s+(?=\S)|(?<=[。！？；])|\n+", "\u0000")
    parts = F.transform(F.split(marked, "\u0000"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", "")))
    wide = F.filter(parts, lambda x: width(x) >= least_width)

    def first_of_each(sides: Column) -> Column:
        places = F.transform(F.array_distinct(sides["lower"]), lambda x: F.array_position(sides["lower"], x).cast("int"))
        return F.transform(places, lambda at: F.struct((~F.element_at(sides["text"], at).rlike(HINTS)).alias("plain"), at.alias("at"), F.element_at(sides["text"], at).alias("text")))

    once = bound(wide, lambda w: bound(F.struct(w.alias("text"), F.transform(w, lambda x: F.lower(x)).alias("lower")), first_of_each))
    chosen = F.slice(F.array_sort(once), 1, most)
    return F.transform(F.array_sort(F.transform(chosen, lambda k: F.struct(k["at"], k["text"]))), lambda k: k["text"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_metadata(text: Column, most: int = 2000) -> Column:
    """struct(text, metadata): a text without the JSON block behind ``[metadata]`` at its end; a large block becomes its size."""
    tail = F.regexp_extract(text, r"(?s)\n?\[metadata\]\s*(\{.*\})\s*$", 1)
    valid = (tail != "") & F.try_parse_json(tail).isNotNull()
    body = F.when(valid, F.rtrim(F.regexp_replace(text, r"(?s)\n?\[metadata\]\s*\{.*\}\s*$", ""))).otherwise(text)
    note = F.when(F.length(tail) > most, F.concat(F.lit("object, "), F.length(tail), F.lit(" characters"))).otherwise(tail)
    return F.struct(body.alias("text"), F.when(valid, note).alias("metadata"))


def fence(text: Column) -> Column:
    """A text in a fence longer than any run of backticks in it."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), lambda x: F.length(x)))
    ticks = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))
    return F.concat(ticks, F.lit("\n"), text, F.lit("\n"), ticks)


def excerpt_line(step: Column, role: Column, text: Column) -> Column:
    """One step of a Markdown excerpt: heading and text, with markup escaped."""
    escaped = F.regexp_replace(text, r"([\\`*_\[\]<>#|])", r"\\$1")
    return F.concat(F.lit("### "), step.cast("string"), F.lit(" · "), role, F.lit("\n\n"), escaped)


def step_ranges(text: str, most: int = 200) -> list[int]:
    """The steps of a text such as ``3-9, 15``, in order, at most ``most``."""
    out: list[int] = []
    for part in text.replace(" ", "").split(","):
        low, _, high = part.partition("-")
        if not low.isdigit() or high and not high.isdigit():
            raise ValueError(f"not a step or range: {part!r}")
        out.extend(range(int(low), int(high or low) + 1))
    if len(out) > most:
        raise ValueError(f"more than {most} steps")
    return sorted(set(out))


def _unwrapped(text: str) -> tuple[str, str]:
    """(task, harness text). JSON counts as a wrapper if it is most of the text, or what stands before it speaks of JSON and
    it has rules; and if little stands before it."""
    before, brace, _ = text.partition("{")
    try:
        wrapper, end = json.JSONDecoder().raw_decode(text, len(before)) if brace else (None, 0)
    except ValueError:
        return text, ""
    before = before.strip()
    if not isinstance(wrapper, dict) or len(before) > MOST_FRAMING:
        return text, ""
    told = lambda fields: [wrapper[f] for f in fields if isinstance(wrapper.get(f), str)]
    is_most = end - text.index("{") >= LEAST_SHARE * len(text)
    task = "\n".join(told(TASK_FIELDS))
    if not task or not (is_most or ("json" in before.lower() and told(HARNESS_FIELDS))):
        return text, ""
    return task, "\n".join(filter(None, [before, text[end:].strip(), "\n".join(told(HARNESS_FIELDS))]))


def split_task(instruction: Column) -> Column:
    """struct(task, harness): what the user asks for, and the harness's text, of an instruction that may wrap both in JSON.
    Reading one JSON value from the middle of a text is not to be had as an expression."""

    @F.pandas_udf("task string, harness string")
    def split(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_unwrapped((t or "").strip()) for t in texts], columns=["task", "harness"])

    return split(instruction)

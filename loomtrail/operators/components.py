"""Where the steps of a run use what its harness added: calls, files, mentions, and what its tools made.

All names of a run are looked for in one pass over a text, by an automaton of them, so that time grows with texts and names
and not with their product. A run's texts are dealt in stretches of steps, each with the run's names before it, so that a
long run isn't one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signals
from .lineage import cut

#: Steps of a stretch.
STRETCH = 512
# fixed values: shortest name, characters of a result in which paths are looked for, what a path that a tool made looks like, a
# stem that stands for its file, tools that load a skill and start a subagent, and the fields that name these
LEAST, RESULT = 5, 20_000
OUTPUT_PATH = r"(?iU)(?<![\w./-])((?:[\w.-]+/)*[\w-][\w.-]*\.(?:png|jpe?g|webp|gif|avif|svg|json|html|txt|md|csv|mp4|webm))(?![\w-])"
STEM = r"(?U)^(?=.{8,}$)[\w]+(?:[-_][\w]+)+$"
SKILL_TOOLS, SPAWN_TOOLS = ("skill", "use_skill", "load_skill"), ("agent", "task")
SKILL_FIELDS = ("skill", "name", "command", "skill_name")


def _last(name: Column, separator: str) -> Column:
    return F.element_at(F.split(name, separator), -1)


def component_terms(components: DataFrame, stems: bool = False) -> DataFrame:
    """(run_id, kind, name, term): the names that components (run_id, kind, name, tools) go by in texts.

    A tool goes by its own name and that behind its server's, a server by its tools' too, a file by its path and, if no other
    of the run is called so, by what it is called; with ``stems`` also by that without its ending, if it is distinctive.
    Short names and numbers would be found in any prose.
    """
    base = _last(F.col("name"), "/")
    once = F.count_if(F.col("kind") == "file").over(Window.partitionBy("run_id", base)) == 1
    rows = components.withColumn("_once", once & (F.col("kind") == "file"))
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    by_kind = (
        F.when(F.col("kind") == "mcp", F.concat(F.array("name"), tools, F.transform(tools, lambda t: _last(t, "__"))))
        .when(F.col("kind").isin("tool", "skill", "subagent"), F.array("name", _last(F.col("name"), "__")))
        .when(F.col("kind") == "file", F.array_compact(F.array(F.col("name"), F.when(F.col("_once"), base), F.when(F.col("_once") & F.lit(stems) & stem.rlike(STEM), stem))))
        .otherwise(none)
    )
    each = rows.select("run_id", "kind", "name", F.explode(F.array_distinct(by_kind)).alias("term"))
    return each.where((F.length("term") >= LEAST) & ~F.col("term").rlike(r"^\d+$"))


def found_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(run_id, step, part, term, whole): which of its run's terms (run_id, term) a text (run_id, step, part, text) has, each once;
    ``whole`` if it stands by itself somewhere, as no part of a longer name."""
    dealt = texts.where("text <> ''").withColumn("_stretch", F.floor(F.col("step") / STRETCH))
    needed = dealt.select("run_id", "_stretch").distinct().join(terms.select("run_id", "term").distinct(), "run_id")
    first = needed.select("run_id", "_stretch", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("step"), F.lit("").alias("part"), F.col("term").alias("text"))
    then = dealt.join(needed.select("run_id", "_stretch").distinct(), ["run_id", "_stretch"], "left_semi").select("run_id", "_stretch", F.lit(1).alias("_kind"), F.col("step").cast("long").alias("step"), "part", "text")
    rows = first.unionByName(then).repartition("run_id", "_stretch").sortWithinPartitions("run_id", "_stretch", "_kind")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton, ready = None, None, False
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for run, stretch, kind, step, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (run, stretch) != at:
                    at, automaton, ready = (run, stretch), ahocorasick.Automaton(), False
                if kind == 0:
                    automaton.add_word(text, text)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                found: dict[str, bool] = {}
                for end, term in automaton.iter(text):
                    if not found.get(term):
                        before, after = text[end - len(term)] if end >= len(term) else "", text[end + 1 : end + 2]
                        found[term] = not (_joins(before) or before == ".") and not _joins(after)
                for column, values in zip(out, ([run] * len(found), [step] * len(found), [part] * len(found), list(found), list(found.values())), strict=True):
                    column.extend(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["run_id", "step", "part", "term", "whole"])

    kind = texts.schema["run_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"run_id {kind}, step long, part string, term string, whole boolean")


def _joins(c: str) -> bool:
    """Whether a character makes a name beside it longer."""
    return c.isalnum() or c in ("_", "-") if c else False


def written_files(files: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, name): files (run_id, name) that the agent itself writes, edits or redirects output to: a name that the harness
    gave to its work, not material that it was given."""
    tool, said = F.col("tool"), F.col("input")
    paths = calls.where(signals.is_mutation(tool, said)).select("run_id", F.explode(signals.touched_paths(tool, said)).alias("path"))
    # every end of a path that begins behind a separator, so that the match is an equality
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    ended = paths.select("run_id", F.explode(F.array_distinct(F.concat(F.array("path"), ends))).alias("name")).distinct()
    return files.select("run_id", "name").join(ended, ["run_id", "name"], "left_semi").distinct()


def component_uses(components: DataFrame, messages: DataFrame, calls: DataFrame, stems: bool = False) -> DataFrame:
    """(run_id, kind, name, calls, files, mentions, outputs): the steps at which agent turns use each component.

    components: (run_id, kind, name, tools); messages: (run_id, step, role, text, thinking); calls: (run_id, step, call_index,
    tool, raw_name, input, result_text). ``calls`` are by tool, skill or kind of subagent, ``files`` where a call's input names a file,
    ``mentions`` where a turn's words name a component. ``outputs`` are uses of paths that a component's tool returned before
    the run had said them anywhere, after that step; the first tool to return one owns it. A file that the agent writes
    itself is no component. Each list ascends; null texts are empty; a component without uses has empty lists.
    """
    keys = ["run_id", "kind", "name"]
    own = written_files(components.where("kind = 'file'"), calls).withColumn("kind", F.lit("file"))
    terms = cut(component_terms(components.join(own, keys, "left_anti"), stems))
    turns = messages.where(F.col("role").isin("assistant", "tool"))
    prose = turns.select("run_id", "step", F.lit("prose").alias("part"), F.concat_ws("\n", "thinking", "text").alias("text"))
    said = calls.select("run_id", "step", F.lit("input").alias("part"), F.coalesce("input", F.lit("")).alias("text"))

    tools = components.where(~F.col("kind").isin("skill", "subagent")).select(*keys, F.explode("tools").alias("raw_name"))
    owned = calls.join(tools, ["run_id", "raw_name"])
    made = owned.select(*keys, "step", "call_index", F.posexplode(F.regexp_extract_all(F.substring("result_text", 1, RESULT), F.lit(OUTPUT_PATH), 1)).alias("at", "term")).where(F.length("term") >= LEAST)
    made = made.join(terms.where("kind = 'file'").select("run_id", "term"), ["run_id", "term"], "left_anti")
    first = made.groupBy("run_id", "term").agg(F.min(F.struct("step", "call_index", "at", "kind", "name")).alias("m"))
    first = cut(first.select("run_id", "term", F.col("m.step").alias("made_at"), "m.kind", "m.name"))

    hits = cut(found_terms(prose.unionByName(said), terms.select("run_id", "term").unionByName(first.select("run_id", "term"))))
    seen = hits.groupBy("run_id", "term").agg(F.min("step").alias("seen_at"))
    new = first.join(seen, ["run_id", "term"], "left").where("seen_at IS NULL OR seen_at > made_at")
    whole = hits.where("whole")
    named = whole.join(terms, ["run_id", "term"])
    value = F.try_parse_json("input")
    field = lambda *names: F.coalesce(*[F.try_variant_get(value, f"$.{n}", "string") for n in names])
    tool = F.lower(_last(F.col("tool"), "__"))
    asked = calls.select("run_id", "step", F.when(tool.isin(*SKILL_TOOLS), "skill").when(tool.isin(*SPAWN_TOOLS), "subagent").alias("kind"), F.when(tool.isin(*SKILL_TOOLS), field(*SKILL_FIELDS)).otherwise(field("subagent_type")).alias("name"))
    ways = [
        owned.select(*keys, "step", F.lit("calls").alias("how")),
        asked.where("kind IS NOT NULL").join(components.select(*keys), keys, "left_semi").select(*keys, "step", F.lit("calls").alias("how")),
        named.where("part = 'input' AND kind = 'file'").select(*keys, "step", F.lit("files").alias("how")),
        named.where("part = 'prose'").select(*keys, "step", F.lit("mentions").alias("how")),
        whole.join(new, ["run_id", "term"]).where("step > made_at").select(*keys, "step", F.lit("outputs").alias("how")),
    ]
    used = ways[0]
    for way in ways[1:]:
        used = used.unionByName(way)
    lists = [F.coalesce(F.array_sort(F.collect_set(F.when(F.col("how") == how, F.col("step")))), F.array()).alias(how) for how in ("calls", "files", "mentions", "outputs")]
    by_component = used.withColumn("step", F.col("step").cast("long")).groupBy(*keys).agg(*lists)
    none = F.array().cast("array<bigint>")
    return components.select(*keys).distinct().join(by_component, keys, "left").select(*keys, *[F.coalesce(c, none).alias(c) for c in ("calls", "files", "mentions", "outputs")])

"""Which recorded edit each change of a rewritten text belongs to, with ids that say the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.diffs import regions_of

#: Words of a needle up to which white space may differ; what stands between the runs of one change.
MOST_WORDS, GAP = 2_000, " … "


def located(text: Column, needle: Column) -> Column:
    """struct(start, stop): where a text first has a needle, in code points, or null.

    If it isn't there as it stands, white space may be any other. The first place of what the pattern matched is its
    match, as every other place would be a match too.
    """
    at = F.instr(text, needle)
    words = F.filter(F.split(needle, r"(?U)\s+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1")), r"\s+")
    said = F.when((at > 0) | ~F.size(words).between(1, MOST_WORDS), needle).otherwise(F.regexp_substr(text, F.concat(F.lit("(?U)"), pattern)))
    place = F.struct((F.instr(text, said) - 1).cast("long").alias("start"), (F.instr(text, said) - 1 + F.length(said)).cast("long").alias("stop"))
    return F.when((needle != "") & (F.instr(text, said) > 0), place)


def _rebuilds(old: Column, new: Column, edits: Column) -> Column:
    """Whether edits in order of their places, which must not overlap, turn the old text into the new one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"), F.lit(True).alias("apart"))

    def put(acc: Column, edit: Column) -> Column:
        between = F.substring(old, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), edit["old"]["start"] - acc["at"]).cast("int"))
        return F.struct(edit["old"]["stop"].alias("at"), F.concat(acc["text"], between, edit["said"]).alias("text"), (acc["apart"] & F.coalesce(edit["old"]["start"] >= acc["at"], F.lit(False))).alias("apart"))

    end = lambda acc: acc["apart"] & (F.concat(acc["text"], F.substring(old, (acc["at"] + 1).cast("int"), F.length(old))) == new)
    every = ~F.exists(edits, lambda e: e["old"].isNull())
    return F.coalesce((F.size(edits) > 0) & every & F.aggregate(edits, start, put, end), F.lit(False))


def _touches(place: Column, start: Column, stop: Column) -> Column:
    return F.coalesce((place["start"] <= stop) & (start <= place["stop"]), F.lit(False))


def owned_changes(fields: DataFrame, edits: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, row, step, field, id, removed, added, owners): the changes of texts, each with the recorded edits it belongs to.

    ``fields`` has one row (key, row, step, field, old, new) for each text of a rewritten sample, ``edits`` one (key, step, field,
    n, edit, old, new) for each recorded edit, ``n`` their order. Where the edits of a text, put into the old one at their places, give
    just the new one, each change is the edit's own: ``e:edit``. Else the texts are compared, and a change belongs to all edits
    whose old or new text it touches: ``e:edit+edit``. What no edit explains is one change of its text,
    ``h:step:field:`` and a digest of what it says, so that it has the same id however other texts change. Runs of
    one change are joined by a gap mark.

    A null text is empty, a null edit's text too. A text without edits has only the last kind, an equal pair no row. The
    edits of one text meet in one row; texts are compared each by itself.
    """
    names = [key, "step", "field"]
    texts = fields.select(key, "row", "step", "field", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new")).where("old <> new")
    told = edits.select(*names, "n", F.col("edit").cast("string").alias("edit"), F.coalesce("old", F.lit("")).alias("was"), F.coalesce("new", F.lit("")).alias("said"))
    placed = told.join(texts.select(*names, "old", "new"), names).select(*names, F.struct(located(F.col("old"), F.col("was")).alias("old"), "n", "edit", "said", located(F.col("new"), F.col("said")).alias("new")).alias("e"))
    by_text = placed.groupBy(*names).agg(F.sort_array(F.collect_list("e")).alias("edits"))
    joined = texts.join(by_text, names, "left")
    joined = joined.withColumn("exact", F.coalesce(_rebuilds(F.col("old"), F.col("new"), F.col("edits")), F.lit(False)))
    # the parts that are compared: each edit by itself, or the whole text
    own = joined.where("exact").select(key, "row", "step", "field", F.posexplode("edits").alias("part", "e"), "old").select(
        key, "row", "step", "field", "part", F.substring("old", (F.col("e.old.start") + 1).cast("int"), (F.col("e.old.stop") - F.col("e.old.start")).cast("int")).alias("old"), F.col("e.said").alias("new"),
        F.array("e.edit").alias("owner"), F.filter(F.array("e"), lambda e: F.lit(False)).alias("edits"),
    )
    whole = joined.where("NOT exact").select(key, "row", "step", "field", F.lit(0).alias("part"), "old", "new", F.lit(None).cast("array<string>").alias("owner"), "edits")
    runs = own.unionByName(whole).select("*", F.posexplode(regions_of("old", "new")).alias("run", "r"))
    touching = F.filter("edits", lambda e: _touches(e["old"], F.col("r.old_start"), F.col("r.old_stop")) | _touches(e["new"], F.col("r.new_start"), F.col("r.new_stop")))
    in_order = F.transform(F.sort_array(F.transform(touching, lambda e: F.struct(e["n"].alias("n"), e["edit"].alias("edit")))), lambda e: e["edit"])
    owners = F.coalesce("owner", in_order, F.array().cast("array<string>"))
    each = runs.select(key, "row", "step", "field", owners.alias("owners"), F.struct("part", "run", "r.removed", "r.added").alias("r"))
    grouped = each.groupBy(key, "row", "step", "field", "owners").agg(F.sort_array(F.collect_list("r")).alias("runs"))
    said = lambda side: F.array_join(F.filter(F.transform("runs", lambda r: r[side]), lambda t: t != ""), GAP).alias(side)
    pieces = F.flatten(F.transform("runs", lambda r: F.array(F.concat(F.lit("-"), r["removed"]), F.concat(F.lit("+"), r["added"]))))
    digest = F.substring(F.sha1(F.array_join(F.filter(pieces, lambda p: F.length(p) > 1), "\0").cast("binary")), 1, 10)
    ref = F.when(F.size("owners") > 0, F.concat(F.lit("e:"), F.array_join("owners", "+"))).otherwise(F.concat_ws(":", F.lit("h"), F.col("step").cast("string"), "field", digest))
    return grouped.select(key, "row", "step", "field", ref.alias("id"), said("removed"), said("added"), "owners")


def unplaced_edits(edits: DataFrame, changes: DataFrame, key: str = "sample_id") -> DataFrame:
    """The recorded edits that no change belongs to."""
    placed = changes.select(key, F.explode("owners").alias("_placed"))
    return edits.join(placed, (edits[key] == placed[key]) & (edits["edit"].cast("string") == placed["_placed"]), "left_anti")


def step_changes(alignment: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, id, change): ids of whole steps that were removed or added, of an alignment (key, old_step, new_step, how)."""
    sign = F.when(F.col("how") == "removed", "-").otherwise("+")
    return alignment.where("how IN ('removed', 'added')").select(key, F.concat_ws(":", F.lit("s"), sign, F.coalesce("old_step", "new_step").cast("string")).alias("id"), F.col("how").alias("change"))


def call_changes(calls: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, id, change): ids of calls of ``rewrites.tool_changes`` that aren't the same; one without an id goes by its tool."""
    name = F.coalesce(F.col("call_id").cast("string"), "new_tool", "old_tool")
    return calls.where("change <> 'same'").select(key, F.concat_ws(":", F.lit("t"), name, "change").alias("id"), "change")

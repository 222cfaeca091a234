"""Mixing sources to target weights by pivotal dependent rounding in a distributed reduction tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import content_tag, cut, fresh, text_of

#: Documents that a leaf of the tree rounds, and children of a node above.
LEAF, FAN = 1_000, 256


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``sizes``: (source, source_size), a row for each source. Adds target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight, until
    none is above. The fixed point is min(most * size, level * weight) for the one level at which
    targets sum to the total. It is found by a running sum over sources ordered by the level at which each
    reaches its limit; there is one row for each source, however many documents there are. Sources
    without words have the target 0.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    all_rows = Window.orderBy("full_at", "weight", F.col("source").asc_nulls_last())
    before = all_rows.rowsBetween(Window.unboundedPreceding, -1)
    whole = all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # the level holds from the first source that it doesn't fill
    levels = levels.withColumn("place", F.row_number().over(all_rows))
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("place", "level"))).over(whole)["level"]
    target = F.least(most * F.col("source_size"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).cast("double").alias("target"))


def pivotal(items: Iterator[tuple[float, float, float]]) -> tuple[list[int], int | None, float]:
    """Rounds items (size, fraction, draw) pair by pair: the copies, the open item if any, its fraction.

    Of two open items one gains what the other loses, in words, until one is at 0 or 1; which way is
    drawn so that each keeps its expected copies. So the words that are taken in all change by nothing
    but the rounding of the last open item.
    """
    copies: list[int] = []
    open_at, open_size, open_part = None, 0.0, 0.0
    for at, (size, part, draw) in enumerate(items):
        copies.append(0)
        if part <= 1e-9 or part >= 1 - 1e-9:
            copies[at] = round(part)
            continue
        if open_at is None:
            open_at, open_size, open_part = at, size, part
            continue
        up = min((1 - open_part) * open_size, part * size)  # words that the open item may gain
        down = min(open_part * open_size, (1 - part) * size)  # words that it may lose
        moved = up if draw * (up + down) < down else -down
        open_part += moved / open_size
        part -= moved / size
        if open_part <= 1e-9 or open_part >= 1 - 1e-9:
            copies[open_at] = round(open_part)
            open_at, open_size, open_part = at, size, part
            if part <= 1e-9 or part >= 1 - 1e-9:
                copies[at], open_at = round(part), None
        else:
            copies[at] = round(part)
    return copies, open_at, open_part


def _round_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["draw", "id", "size", "row", "chunk"], kind="stable", na_position="last").reset_index(drop=True)
    draws = (group["draw"].to_numpy().view("uint64") >> 11) / float(1 << 53)
    copies, open_at, part = pivotal(zip(group["size"].astype(float), group["part"], draws, strict=True))
    group["copies"] = group["copies"] + copies
    group["part"] = 0.0
    group["open"] = False
    if open_at is not None:
        group.loc[open_at, ["part", "open"]] = [part, True]
    return group[[c.split()[0] for c in _SCHEMA.split(", ")]]


_SCHEMA = (
    "id long, row long, source string, source_size long, target double, size long, chunk long, rows long, node long, draw long, part double, copies long, open boolean"
)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, row (content tag), source, size, source_size, target, copies.

    size counts the words of the text (null: 0). Every document of a source has target / source_size
    expected copies; the whole part is given to all, the fraction is rounded by the pivotal method. Leaves
    are groups of about 1,000 items of a source, dealt by a hash of id and text, so that a source with
    a third of all rows has many. Each leaves one open item at most; those meet in nodes of 256
    until one is left, which is drawn alone. Words taken differ from the target by one document at most.

    Rows that repeat an id, a text and a source are counted first and are one item for each 1,000 of them, whose copies are
    rounded in sum and given out evenly, so that no leaf grows with their number. Draws are hashes of id, text and
    ``seed``: reruns agree, however rows are partitioned. Documents without words, null and empty ones get no copies.
    A text of any length is one number. Null ids and sources are values like others; an empty table gives no rows;
    other columns are not read.
    """
    text = text_of(F.col(text_col))
    words = docs.select(
        F.col(id_col).cast("long").alias("id"),
        content_tag(F.col(text_col)).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )
    counted = words.groupBy("id", "row", "source", "size").agg(F.count("*").alias("n"))
    items = cut(
        counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LEAF))))
        .withColumn("rows", F.least(F.lit(LEAF).cast("long"), F.col("n") - F.col("chunk") * LEAF))
        .drop("n")
    )
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("items"))
    aims = targets(sizes.select("source", "source_size"), weights, most)
    aims = aims.join(sizes.select(F.col("source").alias("of"), "items"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    aims = cut(aims.withColumnRenamed("source", "of"))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("items") / LEAF))
    # of an item's expected copies the whole part is certain
    expected = F.col("rows") * F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = (
        items.join(aims, items["source"].eqNullSafe(aims["of"]))
        .withColumn("expected", expected)
        .withColumn("copies", F.floor(F.col("expected") + 1e-9))
        .withColumn("draw", F.xxhash64("id", "row", "chunk", F.lit(seed)))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("expected") - F.col("copies")))
        .withColumn("node", F.pmod(F.xxhash64("draw"), leaves))
        .withColumn("open", F.lit(False))
    )
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    even = dealt.where(F.col("part") <= 1e-9).withColumn("node", F.lit(0).cast("long"))
    rounded = cut(dealt.where(F.col("part") > 1e-9).select(*columns).groupBy("source", "node").applyInPandas(_round_group, _SCHEMA))
    done, open_rows = [even.select(*columns), rounded.where("NOT open")], rounded.where("open")
    most_leaves = aims.agg(F.max(leaves)).first()[0] or 1
    while most_leaves > 1:
        # each leaf has one open item at most, so a node of FAN leaves has FAN rows
        most_leaves = -(-most_leaves // FAN)
        level = cut(open_rows.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("source", "node").applyInPandas(_round_group, _SCHEMA))
        done, open_rows = [*done, level.where("NOT open")], level.where("open")
    drawn = (F.shiftrightunsigned(F.xxhash64("draw", F.lit(seed)), 11) / float(1 << 53) < F.col("part")).cast("long")
    rows = open_rows.withColumn("copies", F.col("copies") + drawn)
    for part in done:
        rows = rows.unionByName(part)
    each = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    share = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("long")
    return each.select(F.col("id").alias("doc_id"), "row", "source", "size", "source_size", "target", share.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies_col: str = "copies", **options) -> DataFrame:
    """The documents that the mix takes, with all columns and how many copies of each it takes.

    Rows that repeat an id and a text stand once, with the sum of their copies. Null and empty texts are never taken; null ids
    are values like others; an empty table gives no rows; a column that is called like the new one keeps its name.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, **options).groupBy(F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_tag"))
    taken = cut(taken.agg(F.sum("copies").alias("keep_copies"), F.count("*").alias("keep_n")).where("keep_copies > 0"))
    tag, name = fresh(docs, "__tag"), fresh(docs, copies_col)
    tagged = docs.withColumn(tag, content_tag(F.col(text_col)))

    def named(rows: DataFrame) -> DataFrame:
        same = tagged[id_col].eqNullSafe(rows["keep_id"]) & (tagged[tag] == rows["keep_tag"])
        return tagged.join(rows, same).drop("keep_id", "keep_tag", "keep_n").withColumnRenamed("keep_copies", name)

    kept, several = named(taken.where("keep_n = 1")), taken.where("keep_n > 1")
    if not several.isEmpty():
        kept = kept.unionByName(named(several).dropDuplicates([id_col, tag]))
    return kept.drop(tag)

"""Line deduplication over overlapping windows of three lines. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_tag, cut, fresh, text_of

#: Lines of a window.
WINDOW = 3
_BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """The lines that aren't blank, as (position from 0, trimmed line)."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(_BLANK)).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _windows(lines: Column) -> Column:
    """Every window: its number, the positions of its lines, two 64-bit hashes of them."""

    def window(lines: Column, k: Column) -> Column:
        part = [F.get(lines, k + n - 1) for n in range(WINDOW)]
        text = F.concat_ws("\n", *[x["line"] for x in part])
        return F.struct(
            k.alias("k"),
            F.array(*[x["at"] for x in part]).alias("lines"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit("second"), text).alias("h2"),
        )

    return F.when(F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(lines) - WINDOW + 1), lambda k: window(lines, k))).otherwise(F.array())


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, covered): for each document the positions of lines in later occurrences of a window.

    Occurrences are ordered by id (null last), content tag and place. Counts and first occurrences are
    summed up before the shuffle, so that a window that a third of all documents share is no hot group;
    the join back may be split by adaptive execution. The list collected for a document is no longer than
    the document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), content_tag(F.col(text_col)).alias("tag"), _lines(text_of(F.col(text_col))).alias("all"))
    windows = cut(rows.select("id", "tag", F.inline(_bound(F.col("all"), _windows))))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tag", "k")
    # cut, so that the join has an exchange of its own, which may be split at a window that very many documents have
    repeated = cut(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("id", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from the text; n_lines and n_removed are added.

    A window is three consecutive lines that aren't blank, trimmed; a text with fewer has none and stays
    as it is. Of each window that occurs again anywhere, in another document or the same one, the first
    occurrence stays and the lines that later ones cover go, overlaps merged. Blank lines stay. A null text
    counts as one empty line and comes back empty. Rows that repeat an id and a text are one document:
    each gets the same result. Other columns are kept; an empty table gives no rows.
    """
    id_name, tag, covered = (fresh(docs, n) for n in ("__id", "__tag", "__covered"))
    marks = repeated_lines(docs, id_col, text_col).toDF(id_name, tag, covered)
    tagged = docs.withColumn(tag, content_tag(F.col(text_col)))
    same = tagged[id_col].eqNullSafe(marks[id_name]) & (tagged[tag] == marks[tag])
    joined = tagged.join(marks, same, "left").drop(marks[tag]).drop(tag, id_name)
    lines = F.split(text_of(F.col(text_col)), "\n")
    positions = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    kept = _bound(lines, lambda x: F.transform(positions, lambda i: F.get(x, i)))
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col(covered).isNull(), text_of(F.col(text_col))).otherwise(F.array_join(kept, "\n")))
        .drop(covered)
    )

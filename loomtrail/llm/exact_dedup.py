"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_tag, cut, keep_rows, text_of, without_spaces

#: Characters of the original text from which the prefix hash is taken.
PREFIX_CHARS = 512


def _signatures(docs: DataFrame, id_col: str, text_col: str, digest: Column) -> DataFrame:
    text = text_of(F.col(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.length(text).cast("long").alias("n_chars"),
        F.length(without_spaces(text)).cast("long").alias("length"),
        _prefix(text).alias("prefix"),
        content_tag(F.col(text_col)).alias("tag"),
        digest.alias("digest"),
    )


def _prefix(text: Column) -> Column:
    """A hash of the first characters that remain without white space.

    Taken from a bounded piece of the text: the first 64 characters that are left of its first 512 are
    the same for equal normalised texts only if both pieces leave so many. Where fewer are left, the
    hash is 0 and the stage decides nothing for the row.
    """
    head = without_spaces(F.substring(text, 1, PREFIX_CHARS))
    return F.when(F.length(head) >= 64, F.xxhash64(F.substring(head, 1, 64))).otherwise(F.lit(0).cast("long"))


def _digest(text: Column) -> Column:
    return F.sha2(without_spaces(text).cast("binary"), 256)


def _survivors(signatures: DataFrame) -> DataFrame:
    """The (length, prefix) groups with several rows, among lengths with several rows.

    A prefix of 0 could belong to any group of its length, so that a length with such a row stays whole.
    Both groupings are over counts that are summed before the shuffle.
    """
    groups = signatures.groupBy("length", "prefix").agg(F.count("*").alias("n"))
    lengths = groups.groupBy("length").agg(F.sum("n").alias("of_length"), F.max(F.col("prefix") == 0).alias("open")).where("of_length > 1")
    return groups.join(lengths, "length").where("n > 1 OR open").select("length", "prefix")


def _decide(signatures: DataFrame) -> DataFrame:
    """For each digest of the surviving rows: the row that stays and the size of the group."""
    best = F.min(F.struct((-F.col("n_chars")).alias("minus"), F.col("id").isNull().alias("unnamed"), "id", "tag")).alias("best")
    return signatures.groupBy("digest").agg(best, F.count("*").alias("group_size")).select(
        "digest", F.col("best.id").alias("keep_id"), F.col("best.tag").alias("keep_tag"), F.col("best.unnamed").alias("unnamed"), "group_size"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts the one
    with the most code points stays, then the smallest id (null ids last). Rows that repeat both an id and
    a text are one document: all are marked kept if it stays. Since the result states the digest of every
    text, it is computed in the one scan that also takes lengths and prefixes; only rows that survive both
    are grouped by it, all others stay without another shuffle of their digest.
    Other columns are not read; an empty table gives no rows. A group of copies of any size is summed up
    before the shuffle, and the join back by digest may be split by adaptive execution.
    """
    text = text_of(F.col(text_col))
    rows = cut(_signatures(docs, id_col, text_col, _digest(text)))
    alive = _survivors(rows).withColumn("alive", F.lit(True))
    marked = rows.join(alive, ["length", "prefix"], "left")
    # cut, so that the join has an exchange of its own, which may be split where a group is large
    groups = cut(_decide(marked.where("alive")))
    joined = marked.join(groups, "digest", "left")
    mine = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("tag") == F.col("keep_tag"))
    single = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | mine).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, by the rule of ``exact_duplicates``.

    Lengths and prefix hashes come from a first scan; the full hash is computed in a second one, for rows
    of surviving groups only. The rows that go are those of a surviving group that aren't its best.
    """
    text = text_of(F.col(text_col))
    rows = cut(_signatures(docs, id_col, text_col, F.lit(None).cast("string")).drop("digest"))
    alive = cut(_survivors(rows))
    again = _signatures(docs, id_col, text_col, text).join(alive, ["length", "prefix"], "left_semi")
    full = cut(again.withColumn("digest", F.sha2(without_spaces(F.col("digest")).cast("binary"), 256)))
    groups = cut(_decide(full))
    same = groups["keep_id"].eqNullSafe(full["id"]) & (groups["keep_tag"] == full["tag"]) & (groups["digest"] == full["digest"])
    best = groups.join(full, same).groupBy(groups["keep_id"], groups["keep_tag"]).agg(F.count("*").alias("keep_n"))
    single = rows.join(alive, ["length", "prefix"], "left_anti").select(
        F.col("id").alias("keep_id"), F.col("tag").alias("keep_tag"), F.lit(1).cast("long").alias("keep_n")
    )
    return keep_rows(docs, cut(best.unionByName(single)), id_col, text_col)

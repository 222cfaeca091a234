"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local master, where driver and executors are one process, has a
    temporary folder without that setting."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder is None and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="loomtrail-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def without_spaces(column: Column) -> Column:
    """The text with every ASCII white-space character deleted."""
    for space in SPACES:
        column = F.replace(column, F.lit(space), F.lit(""))
    return column


def held_out(id_column: Column, buckets: int, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``buckets``; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % buckets == fold, F.lit(False))


def keep_rows(docs: DataFrame, keepers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``keepers``, each name once, with the columns of ``docs``.

    ``keepers`` has ``keep_id``, ``keep_tag`` (``content_tag`` of the text) and ``keep_n`` (how many rows
    have that id and that text). Only names with several rows need another pass, which makes one of them.
    """
    tag = fresh(docs, "__tag")
    tagged = docs.withColumn(tag, content_tag(F.col(text_col)))

    def named(rows: DataFrame) -> DataFrame:
        same = tagged[id_col].eqNullSafe(rows["keep_id"]) & (tagged[tag] == rows["keep_tag"])
        return tagged.join(rows, same, "left_semi")

    kept = named(keepers.where("keep_n = 1"))
    several = keepers.where("keep_n > 1")
    if not several.isEmpty():
        kept = kept.unionByName(named(several).dropDuplicates([id_col, tag]))
    return kept.drop(tag)


def content_tag(column: Column) -> Column:
    """A 64-bit tag of the text that tells rows with one id apart; null and empty texts share it."""
    return F.xxhash64(text_of(column))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def within_bytes(df: DataFrame, most: int) -> bool:
    """Whether the rows of ``df`` take no more than ``most`` bytes as text, and so may be broadcast."""
    # a row costs some bytes beside its values
    size = F.length(F.to_json(F.struct("*")).cast("binary")) + 32
    return (df.agg(F.sum(size)).first()[0] or 0) <= most

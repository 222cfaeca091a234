"""Reading JSON lines and JSON documents as variants, in the order of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """(file, place, value): each line that is a JSON object, as a variant.

    Files are split as usual; ``place`` orders lines within a file across splits, as it begins with the split's
    offset. Blank lines and lines that aren't objects are skipped, or raise if ``strict``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("place"),
        F.col("value").alias("line"),
    )
    lines = lines.where(F.trim("line") != "")
    if strict:
        return lines.withColumn("value", F.parse_json("line")).drop("line")
    return lines.where(F.ltrim("line").startswith("{")).withColumn("value", F.try_parse_json("line")).where("value IS NOT NULL").drop("line")


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): each file as one JSON document; null where it isn't one."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("value"))


def with_line_numbers(lines: DataFrame, name: str = "row") -> DataFrame:
    return lines.withColumn(name, F.row_number().over(Window.partitionBy("file").orderBy("place")))


def get(value: str | Column, path: str, kind: str = "string") -> Column:
    """What a variant has at a path, null if it has nothing of that kind there."""
    return F.try_variant_get(F.col(value) if isinstance(value, str) else value, f"$.{path}" if path else "$", kind)


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def content_text(content: Column) -> Column:
    """The text of a message's content: a string, or its parts that have text, joined by line ends."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(is_text(p), F.try_variant_get(p, "$", "string")), F.lit("")))
    joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    return F.coalesce(F.when(is_text(content), F.try_variant_get(content, "$", "string")), joined, F.lit(""))


def content_images(content: Column) -> Column:
    """The image parts of a message's content as JSON, each once, the first place counts."""
    parts = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    images = F.filter(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("")).isin("image", "image_url", "input_image"))
    return F.array_distinct(F.transform(images, lambda p: F.to_json(p)))


def run_id(path: Column, key: Column | None = None) -> Column:
    """The stable id of a run: 16 hex digits of the digest of its path and key."""
    whole = path if key is None else F.when(key.isNull(), path).otherwise(F.concat(path, F.lit("#"), key))
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 16)


#: Kinds of content parts that may stand as JSON in a string.
PART_KINDS = ("text", "input_text", "output_text", "image", "image_url", "input_image", "tool_result")


def decoded_content(content: Column) -> Column:
    """A content string that holds a JSON list of known parts as that list; anything else as it is."""
    inner = F.try_parse_json(F.when(is_text(content), F.try_variant_get(content, "$", "string")))
    parts = F.try_variant_get(inner, "$", "array<variant>")
    known = F.forall(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string").isin(*PART_KINDS), F.lit(False)))
    return F.when((F.size(parts) > 0) & known, inner).otherwise(content)


def arguments(text: Column) -> Column:
    """A call's arguments as JSON if they begin like it and are; else the text, which marks them as bad if it begins so."""
    return F.when(F.ltrim(text).rlike(r"^[{\[]"), F.coalesce(F.to_json(F.try_parse_json(text)), text)).otherwise(text)

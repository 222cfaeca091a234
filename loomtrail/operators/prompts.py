"""System prompts by their sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def sections(prompts: DataFrame, key: Sequence[str] = ("run_id",), text: str = "text") -> DataFrame:
    """(key, section, heading, body) of each text: what follows each heading of the first level, from 1 on.

    What is before the first heading is section 0 with an empty heading, which every text has, null ones too. Lines in
    a code block between lines that begin with three back ticks are no headings; a block that isn't closed goes to the end.
    ``key`` names a text once.
    """
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?:{_LINE_END})\\z", "")
    lines = prompts.select(*key, F.posexplode(F.split(whole, _LINE_END)).alias("_n", "_line"))
    so_far = Window.partitionBy(*key).orderBy("_n")
    lines = lines.withColumn("_fences", F.count_if(F.ltrim("_line").startswith("```")).over(so_far))
    opens = (F.col("_fences") % 2 == 0) & F.col("_line").startswith("# ") & ~F.col("_line").startswith("# #")
    lines = lines.withColumn("_opens", opens).withColumn("section", F.count_if("_opens").over(so_far).cast("int"))
    body = F.array_sort(F.collect_list(F.when(~F.col("_opens"), F.struct("_n", "_line"))))
    found = lines.groupBy(*key, "section").agg(F.max(F.when(F.col("_opens"), F.trim(F.substr("_line", F.lit(3))))).alias("heading"), F.array_join(F.transform(body, lambda x: x["_line"]), "\n").alias("body"))
    # a text that begins with a heading has nothing before it
    first = prompts.select(*key, F.lit(0).alias("section"), F.lit("").alias("heading"), F.lit("").alias("body"))
    begins = lines.where("_n = 0 AND _opens").select(*key)
    return found.withColumn("heading", F.coalesce("heading", F.lit(""))).unionByName(first.join(begins, list(key), "left_semi"))

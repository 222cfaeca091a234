"""Finding sources below a folder by what their files are called and begin with."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import get
from .ranges import heads

# fixed values: folders that are never descended, JSON files that belong to other ones
VENDORED = ("node_modules", "__pycache__", "site-packages", "venv", "dist", "build")
SIDECARS = ("manifest.json", "results.json", "run_metadata.json", "result.json", "package.json", "config.json")
MAX_DEPTH, HEAD_ROWS, HEAD_BYTES = 8, 40, 4_000_000
_BOOKKEEPING = ("queue-operation", "cost-state", "summary", "file-history-snapshot")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, modified, size): files below ``root`` that one of the formats claims.

    Spark lists the files and deals them out; of each only the head is read, which decides: at most 40 rows of at most
    4 MB up to the first that isn't JSON. Hidden and vendored folders, sidecars, and what lies deeper than eight
    folders are left out before that.
    """
    base = re.sub("^[a-z]+:(//)?", "", root.rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,json}").load(root)
    files = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    inner = F.regexp_replace(F.col("path"), "^[a-z]+:(//)?", "")
    files = files.withColumn("_inner", F.substring_index(inner, base, -1))
    folders = F.split("_inner", "/")
    files = files.where(~F.exists(folders, lambda f: f.isin(*VENDORED) | f.startswith(".")) & (F.size(folders) <= MAX_DEPTH + 2) & ~F.element_at(folders, -1).isin(*SIDECARS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (_, lines) in enumerate(heads(batch.column("path").to_pylist(), HEAD_ROWS, HEAD_BYTES)):
                file = batch.take(pa.array([n] * len(lines), pa.int64()))
                yield pa.RecordBatch.from_arrays([*file.columns, pa.array(lines, pa.string())], names=[*file.schema.names, "line"])

    head = files.select("path", "modified", "size").mapInArrow(read, "path string, modified timestamp, size long, line string").withColumn("v", F.try_parse_json("line"))
    whole = head.groupBy("path", "modified", "size").agg(
        F.bool_or(F.col("path").endswith(".jsonl") & get("v", "messages", "array<variant>").isNotNull()).alias("chat"),
        F.bool_or(get("v", "payload", "variant").isNotNull() & get("v", "type").isin("session_meta", "turn_context", "response_item", "event_msg", "compacted")).alias("rollout"),
        F.bool_or((get("v", "type").isin("user", "assistant") & get("v", "message", "variant").isNotNull()) | get("v", "type").isin(*_BOOKKEEPING) & get("v", "sessionId").isNotNull()).alias("session"),
        F.bool_or(get("v", "event_type").isNotNull() & get("v", "sequence", "long").isNotNull()).alias("attempts"),
        F.bool_or(F.col("line").rlike(r'"schema_version"\s*:\s*"ATIF')).alias("steps"),
    )
    kind = F.when(F.col("steps"), "steps").when(F.col("attempts"), "attempts").when(F.col("rollout"), "rollout").when(F.col("session"), "session").when(F.col("chat"), "chat")
    return whole.select("path", kind.alias("format"), "modified", "size").where("format IS NOT NULL")


def fingerprint(sources: DataFrame) -> DataFrame:
    """Sources with a digest of name, time and size, which changes when a file does."""
    name = F.element_at(F.split("path", "/"), -1)
    return sources.withColumn("fingerprint", F.sha2(F.concat_ws("|", name, F.unix_micros("modified"), "size").cast("binary"), 256))

"""Lines of large files by byte ranges, each with the offset at which it begins, as a data source of its own.

``spark.read.format("line_ranges").option("path", ...)`` gives (file, start, offset, value). A range has the lines that begin in
it, so that a file of any size is split. A filter on ``offset`` opens that place only, one on ``file`` that file.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

#: Bytes of a range, of a read, and of lines that are sent at once.
SPLIT, READ, SEND = 64_000_000, 1 << 20, 4_000_000
_SCHEMA = "file string, start long, offset long, value string"


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path and the path in it. Stores are those that Arrow knows by their scheme; without one, files."""
    if path.startswith("file:"):
        return stores.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return stores.FileSystem.from_uri(path) if ":/" in path else (stores.LocalFileSystem(), path)


def lines_of(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) for lines that begin at or after ``start`` and before ``stop``, without their ends."""
    at = max(0, start - 1)
    file.seek(at)
    # the range before has the line that the byte before this one belongs to
    rest, skip = b"", start > 0
    while at < stop:
        block = file.read(READ)
        pieces = (rest + block).split(b"\n")
        rest = pieces.pop() if block else b""
        for piece in pieces:
            if skip:
                skip = False
            elif at < stop:
                yield at, piece[:-1] if piece.endswith(b"\r") else piece
            at += len(piece) + 1
        if not block:
            return


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int) -> None:
        self.file, self.start, self.stop = file, start, stop


class LineRangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.suffix = options.get("suffix", "")
        self.offset = int(options["offset"]) if "offset" in options else None
        self.file: str | None = None

    def partitions(self) -> list[Range]:
        store, inner = opened(self.path)
        info = store.get_file_info(inner)
        found = [info] if info.is_file else store.get_file_info(stores.FileSelector(inner, recursive=True))
        hidden = lambda i: i.path.rpartition("/")[2].startswith(("_", "."))
        scheme = self.path[: self.path.index(inner)] if inner in self.path else ""
        ranges = []
        for i in sorted(found, key=lambda i: i.path):
            name = scheme + i.path
            if not i.is_file or hidden(i) or not i.path.endswith(self.suffix) or self.file not in (None, name):
                continue
            begins = range(0, i.size, self.split) if self.offset is None else [self.offset]
            ranges += [Range(name, b, b + (self.split if self.offset is None else 1)) for b in begins if b < i.size]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, inner = opened(partition.file)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]

        def batch(rows: list[tuple[int, str | None]]) -> pa.RecordBatch:
            offsets, values = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows)), pa.array([partition.start] * len(rows)), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=names)

        with store.open_input_file(inner) as file:
            rows, size = [], 0
            for offset, line in lines_of(file, partition.start, partition.stop):
                if not line.strip():
                    continue
                try:
                    rows.append((offset, line.decode()))
                except UnicodeDecodeError:
                    rows.append((offset, None))
                size += len(line)
                if size >= SEND:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class NarrowedReader(LineRangeReader):
    """The same where the session lets sources see filters; Spark takes no such reader elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("offset",):
                self.offset = f.value
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.file = f.value
            # they only narrow what is opened; Spark applies them to what is read
            yield f


class LineRanges(DataSource):
    """Options: ``path`` (a file, or a folder with all below it), ``split`` (bytes), ``suffix``, ``offset``, and ``filters`` (whether the
    session pushes filters down)."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> LineRangeReader:
        return NarrowedReader(self.options) if self.options.get("filters") == "true" else LineRangeReader(self.options)


def read_ranges(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file, start, offset, value): lines that aren't blank; null where one isn't UTF-8."""
    spark.dataSource.register(LineRanges)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("line_ranges").options(path=path, filters=filters, **options).load()


def with_rows(lines: DataFrame) -> DataFrame:
    """``lines`` with ``row``, from 0 in each file: the place within the range, and how many stand in ranges before. So no
    task has a whole file."""
    each = lines.groupBy("file", "start").agg(F.count("*").alias("_many"))
    # a row for each range
    before = each.withColumn("_before", F.coalesce(F.sum("_many").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_many")
    within = lines.withColumn("_nth", F.row_number().over(Window.partitionBy("file", "start").orderBy("offset")) - 1)
    return within.join(before, ["file", "start"]).withColumn("row", F.col("_before") + F.col("_nth")).drop("_before", "_nth")


def read_samples(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file, offset, row, key, sample_id, value): chat samples, as variants, with what finds them again.

    Lines that aren't JSON count in ``row`` but aren't samples. The key is the sample's id, or ``@offset`` if it has none or an
    earlier one in its file has it.
    """
    lines = with_rows(read_ranges(spark, path, **options)).withColumn("value", F.try_parse_json("value"))
    samples = lines.where(F.try_variant_get("value", "$.messages", "array<variant>").isNotNull())
    samples = samples.withColumn("sample_id", F.coalesce(F.try_variant_get("value", "$.id", "string"), F.lit("")))
    first = F.row_number().over(Window.partitionBy("file", "sample_id").orderBy("offset")) == 1
    key = F.when((F.col("sample_id") != "") & first, F.col("sample_id")).otherwise(F.concat(F.lit("@"), "offset"))
    return samples.withColumn("key", key).select("file", "offset", "row", "key", "sample_id", "value")


def read_sample(spark: SparkSession, file: str, offset: int, sample_id: str) -> DataFrame:
    """(file, offset, sample_id, value): the one sample at a place. Raises, when it is read, if another one stands there now."""
    line = read_ranges(spark, file, offset=offset).withColumn("value", F.try_parse_json("value"))
    found = F.coalesce(F.try_variant_get("value", "$.id", "string"), F.lit(""))
    same = F.when(found == sample_id, found).otherwise(F.raise_error(F.concat(F.lit("the file has changed: instead of "), F.lit(sample_id), F.lit(" it has "), found)).cast("string"))
    return line.select("file", "offset", same.alias("sample_id"), "value")


def heads(paths: Iterable[str], rows: int, most: int) -> Iterator[tuple[str, list[str]]]:
    """(path, head): of each JSONL file its first lines, at most ``rows`` of at most ``most`` bytes, up to the first that isn't JSON; of any
    other file its first bytes. Nothing behind is read."""
    for path in paths:
        store, inner = opened(path)
        with store.open_input_file(inner) as file:
            if not path.endswith(".jsonl"):
                yield path, [file.read(most).decode("utf-8", "replace")]
                continue
            head: list[str] = []
            for offset, line in lines_of(file, 0, most):
                if len(head) == rows or offset + len(line) > most:
                    break
                if line.strip():
                    try:
                        json.loads(line)
                    except ValueError:
                        break
                    head.append(line.decode())
            yield path, head

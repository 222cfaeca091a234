"""Summaries of records that are kept, and made anew only where what they are made from has changed.

Below ``path`` are ``rows/part=P/version=V`` and ``commits``. A part has the records with one hash. A refresh writes new versions of the
parts that have a changed record, and then a commit that says which version of each part holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

_COMMIT = "generation long, part int, version string, parts int"
_ROWS = "record string, key string, summary string, error string, part int, version string"


class Summaries:
    """The summaries at ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16) -> None:
        self.spark, self.path, self.parts = spark, path, parts

    def read(self) -> DataFrame:
        """(record, key, summary, error) as of the last refresh."""
        return self._rows(self._last()).drop("part", "version")

    def refresh(self, current: DataFrame, made_from: Sequence[str], summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Brings the summaries up to the records of ``current`` (record, ...), one row each, and returns them.

        A record whose ``made_from`` columns (fingerprints, status) are as before keeps its summary. ``summarize`` gets the others and
        returns (record, summary); one for which it returns nothing has an error instead. Records that are gone lose theirs.
        Only parts with a record of either kind are written; if there is none, nothing is.
        """
        key = F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in made_from])).cast("binary"), 256), 1, 16)
        keyed = current.withColumn("record", F.col("record").cast("string")).withColumn("key", key)
        last = self._last()
        held = self._rows(last)
        changed = keyed.join(held.select("record", "key"), ["record", "key"], "left_anti")
        changed = cut(changed.withColumn("part", self._part()))
        gone = cut(held.join(keyed.select("record"), "record", "left_anti").select("record", "part"))
        # as many rows at most as there are parts
        touched = sorted({r["part"] for r in changed.select("part").unionByName(gone.select("part")).distinct().collect()})
        if touched:
            made = summarize(changed.drop("part", "key")).select(F.col("record").cast("string").alias("record"), "summary")
            new = changed.select("record", "key", "part").join(made, "record", "left").withColumn("error", F.when(F.col("summary").isNull(), "no summary"))
            left = held.where(F.col("part").isin(*touched)).join(changed.select("record").unionByName(gone.select("record")), "record", "left_anti").drop("version")
            version = f"v{uuid.uuid4().hex}"
            rows = new.unionByName(left.select(new.columns)).withColumn("version", F.lit(version))
            rows.repartition("part").write.mode("append").partitionBy("part", "version").parquet(f"{self.path}/rows")
            generation = max((g for _, _, g in last), default=-1) + 1
            commit = [(generation, p, v, self.parts) for p, v, _ in last if p not in touched] + [(generation, p, version, self.parts) for p in touched]
            self.spark.createDataFrame(commit, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return self.read()

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("record"), F.lit(self.parts)).cast("int")

    def _last(self) -> list[tuple[int, str, int]]:
        """(part, version, generation) of the last commit."""
        try:
            commits = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        newest = commits.agg(F.max("generation").alias("newest"))
        return [(r["part"], r["version"], r["generation"]) for r in commits.join(F.broadcast(newest), F.col("generation") == F.col("newest")).collect()]

    def _rows(self, commit: list[tuple[int, str, int]]) -> DataFrame:
        if not commit:
            return self.spark.createDataFrame([], _ROWS)
        held = F.lit(False)
        for part, version, _ in commit:
            held = held | ((F.col("part") == part) & (F.col("version") == version))
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows").where(held)

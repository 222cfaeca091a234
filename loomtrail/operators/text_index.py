"""A text index that is kept: postings in buckets of terms, of which a search opens only its own.

Below ``path`` are ``postings/part=P/version=V/bucket=B``, ``gone/part=P/version=V`` and ``commits``. A part has the runs with one hash,
a bucket the terms with one, sorted within each file, so that the statistics of files skip most of a bucket too. Changed runs write a new
version of their parts with nothing but these runs, and their names under ``gone``, as no older version holds for them; a part of
``VERSIONS`` versions is written whole instead. A commit says which versions of each part hold, with the number and the size of the
steps that each adds. A reader sees the last commit, whole, and needs no other table for the ranking.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import search
from .lineage import cut

_COMMIT = "generation long, part int, version string, steps long, total long, parts int, buckets int, kind string, since long"
# of a part at once
VERSIONS = 8


class TextIndex:
    """The index at ``path``, a folder that all executors reach. ``keys`` name a step, the first of them its run."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("run_id", "step")) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def build(self, steps: DataFrame, text: str = "text", parts: int = 16, buckets: int = 64) -> None:
        """Makes the index anew from ``steps`` (keys, text)."""
        version = self._name()
        kind = self._write(version, self._rows(steps, text, parts), parts, buckets)
        new = [{**r.asDict(), "version": version, "since": 0} for r in self._added(version, kind, buckets).collect()]
        self._commit(0, new, [], parts, buckets, kind)

    def replace(self, steps: DataFrame, runs: DataFrame | None = None, text: str = "text") -> None:
        """The runs of ``steps`` have these steps from now on, and those of ``runs`` that aren't among them none.

        Only the parts that have such runs get a new version. Steps of one run that was indexed before go with it.
        """
        now = self._last()
        run, parts, buckets, generation = self.keys[0], now[0]["parts"], now[0]["buckets"], now[0]["generation"] + 1
        named = steps.select(run) if runs is None else steps.select(run).unionByName(runs.select(run))
        named = cut(named.distinct().withColumn("part", self._part(parts)))
        # as many rows at most as there are parts
        touched = {r["part"] for r in named.select("part").distinct().collect()}
        if not touched:
            return
        held = {p: [r for r in now if r["part"] == p] for p in touched}
        whole = [r for p in touched if len(held[p]) >= VERSIONS for r in held[p]]
        version = self._name()
        rows = self._rows(steps, text, parts)
        # of the types of both
        rows = self.spark.createDataFrame([], now[0]["kind"]).select(rows.columns).unionByName(rows)
        if whole:
            kept = self._postings(whole, F.col("term") != "").select(rows.columns).unionByName(self._sizes(whole).select(rows.columns))
            rows = rows.unionByName(kept.join(named.select(run), run, "left_anti").select(rows.columns))
        kind = self._write(version, rows, parts, buckets)
        left = [r for p in touched if len(held[p]) < VERSIONS for r in held[p]]
        lost = self._sizes(left).join(named.select(run), run, "left_semi").groupBy("part").agg((-F.count("*")).alias("steps"), (-F.sum("size")).alias("total"))
        names = named.select(F.col(run).cast(StructType.fromDDL(kind)[run].dataType).alias(run), "part", F.lit(version).alias("version"))
        names.hint("rebalance", "part").write.mode("append").partitionBy("part", "version").parquet(f"{self.path}/gone")
        change = self._added(version, kind, buckets).unionByName(lost).groupBy("part").agg(F.sum("steps").alias("steps"), F.sum("total").alias("total"))
        # a row for each part
        changed = {r["part"]: r for r in change.collect()}
        new = [{"part": p, "version": version, "steps": changed[p]["steps"] if p in changed else 0, "total": changed[p]["total"] if p in changed else 0, "since": generation} for p in sorted(touched)]
        self._commit(generation, new, [r for r in now if r not in whole], parts, buckets, kind)

    def search(self, query: str, limit: int = 50, digits: int | None = None) -> DataFrame:
        """(keys, score): the best steps with all phrases of the query, as ``search.search`` ranks and rounds them."""
        now = self._last()
        steps, total = sum(r["steps"] for r in now), sum(r["total"] for r in now)
        stats = self.spark.range(1).select(F.lit(steps).alias("steps"), F.lit(total / steps if steps else 0.0).alias("average"))
        wanted = sorted({t for p in search.query_phrases(query) for t in p})
        mine = F.lit(False)
        for term in wanted:
            mine = mine | (self._in_bucket(term, now[0]["buckets"]) & (F.col("term") == term))
        return search.search(self._postings(now, mine & (F.col("term") != "")), query, self.keys, limit, stats=stats, digits=digits)

    def _part(self, parts: int):
        return F.pmod(F.xxhash64(F.col(self.keys[0])), F.lit(parts)).cast("int")

    def _in_bucket(self, term: str, buckets: int) -> Column:
        # a constant, so that other buckets aren't listed
        return F.col("bucket") == F.pmod(F.xxhash64(F.lit(term)), F.lit(buckets)).cast("int")

    def _name(self) -> str:
        # not to be taken for a number
        return f"v{uuid.uuid4().hex}"

    def _rows(self, steps: DataFrame, text: str, parts: int) -> DataFrame:
        """Postings of the steps. Texts are dealt out by part, so that a task writes few files; their postings, which are larger, aren't."""
        dealt = steps.select(*self.keys, F.col(text).alias("_text")).withColumn("_part", self._part(parts)).hint("rebalance", "_part")
        return search.postings(dealt, self.keys, "_text", sized=True)

    def _write(self, version: str, rows: DataFrame, parts: int, buckets: int) -> str:
        """Writes a version of the parts of the postings; the types of its columns."""
        rows = rows.withColumn("part", self._part(parts)).withColumn("version", F.lit(version)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        # each task sorts its own, which leaves on disk only what the tasks at work don't hold in memory
        sorted_rows = rows.sortWithinPartitions("part", "bucket", "term", *self.keys)
        sorted_rows.write.mode("append").option("compression", "zstd").partitionBy("part", "version", "bucket").parquet(f"{self.path}/postings")
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def _added(self, version: str, kind: str, buckets: int) -> DataFrame:
        """(part, steps, total) of a version."""
        written = self.spark.read.schema(kind).parquet(f"{self.path}/postings").where((F.col("version") == version) & self._in_bucket("", buckets) & (F.col("term") == ""))
        return written.groupBy("part").agg(F.count("*").alias("steps"), F.sum("size").alias("total"))

    def _sizes(self, commit: list) -> DataFrame:
        """The empty terms of the steps of a commit, one of each."""
        if all(r["since"] is not None for r in commit):
            return self._postings(commit, self._in_bucket("", commit[0]["buckets"] if commit else 1) & (F.col("term") == ""))
        # versions of before had them only for steps without terms
        steps = self._postings(commit).groupBy("part", *self.keys).agg(F.first("size").alias("size"))
        return steps.withColumn("term", F.lit("")).withColumn("tf", F.lit(0).cast("long")).withColumn("positions", F.array().cast("array<int>"))

    def _commit(self, generation: int, new: list[dict], rest: list, parts: int, buckets: int, kind: str) -> None:
        rows = [(generation, r["part"], r["version"], r["steps"], r["total"], parts, buckets, kind, r["since"]) for r in [*rest, *new]]
        rows = rows or [(generation, 0, "", 0, 0, parts, buckets, kind, 0)]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append" if generation else "overwrite").parquet(f"{self.path}/commits")

    def _last(self) -> list:
        """What the last commit says: at most ``VERSIONS`` rows for each part, the oldest first."""
        commits = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")
        last = commits.agg(F.max("generation").alias("last"))
        found = commits.join(F.broadcast(last), F.col("generation") == F.col("last")).drop("last").collect()
        return sorted(found, key=lambda r: (r["part"], r["since"] or 0))

    def _postings(self, commit: list, wanted: Column | None = None) -> DataFrame:
        """The postings that hold of the versions that a commit names. Folders of other versions aren't opened."""
        kind = (commit or self._last())[0]["kind"]
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/postings").where(self._held(commit))
        rows = rows if wanted is None else rows.where(wanted)
        since = {r["version"]: r["since"] or 0 for r in commit}
        # only a part with an older version has something that is gone
        oldest = {p: min(r["since"] or 0 for r in commit if r["part"] == p) for p in {r["part"] for r in commit}}
        later = [r for r in commit if (r["since"] or 0) > oldest[r["part"]]]
        if not later:
            return rows
        run = self.keys[0]
        age = F.create_map(*[F.lit(x) for pair in since.items() for x in pair])[F.col("version")]
        gone = self.spark.read.schema(f"`{run}` {StructType.fromDDL(kind)[run].dataType.simpleString()}, part int, version string").parquet(f"{self.path}/gone")
        gone = gone.where(self._held(later)).groupBy(run).agg(F.max(age).alias("_gone"))
        return rows.join(gone, run, "left").where(age >= F.coalesce("_gone", F.lit(0))).select(rows.columns)

    def _held(self, commit: list) -> Column:
        held = F.lit(False)
        for version in sorted({r["version"] for r in commit}):
            held = held | ((F.col("version") == version) & F.col("part").isin(*[r["part"] for r in commit if r["version"] == version]))
        return held

"""Writes: upserts, replacement by fingerprint, cascades. Parquet has no merge, so that the latest row wins a union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; ``new`` has one row for each key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_fields(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fields of ``new`` that aren't null replace those of ``old``; rows of either side stay."""
    fields = [c for c in old.columns if c not in keys]
    b = new.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields if f in new.columns])
    joined = old.join(b, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(f"_new_{f}", f).alias(f) if f in new.columns else F.col(f) for f in fields])


def replace_source(old: DataFrame, new: DataFrame, carried: Sequence[str], source: str = "source_id", key: str = "run_id", fingerprint: str = "fingerprint") -> DataFrame:
    """All rows of the sources in ``new`` are replaced by it; ``carried`` columns stay where the fingerprint does."""
    kept = old.join(new.select(source).distinct(), source, "left_anti")
    before = old.select(key, fingerprint, *[F.col(c).alias(f"_old_{c}") for c in carried])
    fresh = new.join(before, [key, fingerprint], "left")
    return kept.unionByName(fresh.select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in carried else F.col(c) for c in new.columns]), allowMissingColumns=True)


def stale(current: DataFrame, cached: DataFrame, keys: Sequence[str], version: str, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows of ``current`` without a cached result of this version and fingerprint."""
    valid = cached.where(F.col("version") == version).select(*keys, fingerprint)
    return current.join(valid, [*keys, fingerprint], "left_anti")


def removal_preview(rows: DataFrame, collections: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """What a removal of collections would take, before it is done."""
    return rows.where(F.col("collection").isin(*collections)).groupBy("collection").agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])


def remove_collections(tables: Mapping[str, DataFrame], collections: Sequence[str], key: str = "run_id") -> dict[str, DataFrame]:
    """Tables without the runs of the collections; child tables lose the rows of those runs."""
    runs = tables["runs"]
    gone = runs.where(F.col("collection").isin(*collections)).select(key)
    return {name: t.where(~F.col("collection").isin(*collections)) if name == "runs" else t.join(gone, key, "left_anti") for name, t in tables.items()}


def prune_orphans(children: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Child rows of which the run is still there."""
    return children.join(runs.select(key).distinct(), key, "left_semi")

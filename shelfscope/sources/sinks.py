"""Sinks: how results replace, extend or expire what is stored. Each returns the new content or
writes it; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored with the rows of changed in place of those with equal keys, new keys added."""
    kept = stored.join(changed.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


def upsert_profile(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merges rows by key; a field that is null in the fresh row keeps its stored value."""
    rest = [c for c in stored.columns if c not in keys]
    new = fresh.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rest if c in fresh.columns))
    joined = stored.join(new, list(keys), "full_outer")
    return joined.select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) if c in fresh.columns else F.col(c) for c in rest))


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrites only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def delete_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df without the rows of the given keys; apply to every table for a cascade."""
    return df.join(keys.select(column), column, "left_anti")


def unexpired(df: DataFrame, at: str, days: float, as_of: Column) -> DataFrame:
    """Rows not older than a retention time; rows without a time never expire."""
    return df.where(F.col(at).isNull() | (F.col(at) >= as_of - F.make_interval(secs=F.lit(days * 86400.0))))


def purge(products: DataFrame, junk: Column, dry_run: bool = True) -> DataFrame:
    """Marks junk rows as gone: unavailable and last seen at the epoch. Dry runs only list them."""
    hit = F.coalesce(junk, F.lit(False))
    if dry_run:
        return products.where(hit)
    epoch = F.timestamp_seconds(F.lit(0))
    return products.withColumn("available", F.when(hit, F.lit(False)).otherwise(F.col("available"))).withColumn("last_seen_at", F.when(hit, epoch).otherwise(F.col("last_seen_at")))


def strip_payload(jobs: DataFrame, column: str, finished: Column, before: Column) -> DataFrame:
    """Drops a heavy column from jobs that ended before a time."""
    old = finished & (F.col("finished_at") < before)
    return jobs.withColumn(column, F.when(~F.coalesce(old, F.lit(False)), F.col(column)))


def newest(df: DataFrame, keys: Sequence[str], at: str, most: int, *ties: str) -> DataFrame:
    """The newest rows of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), *ties)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def retained_snapshots(snapshots: DataFrame, most: int = 10) -> DataFrame:
    """The newest snapshots of each origin and its newest full one."""
    newest_first = Window.partitionBy("origin").orderBy(F.desc("finished_at"))
    full_first = Window.partitionBy("origin", "full").orderBy(F.desc("finished_at"))
    ranked = snapshots.withColumn("_n", F.row_number().over(newest_first)).withColumn("_f", F.row_number().over(full_first))
    return ranked.where((F.col("_n") <= most) | (F.col("full") & (F.col("_f") == 1))).drop("_n", "_f")

"""Differences, retention, garbage and reuse between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import union


def multiset_diff(base: DataFrame, head: DataFrame, keys: list[str], compared: str, order: str) -> DataFrame:
    """(keys, change): rows added, removed or changed; equal keys are paired in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    a = base.withColumn("_n", place).select(*keys, "_n", F.col(compared).alias("_old"), F.lit(True).alias("_in_base"))
    b = head.withColumn("_n", place).select(*keys, "_n", F.col(compared).alias("_new"), F.lit(True).alias("_in_head"))
    both = a.join(b, [*keys, "_n"], "full_outer")
    change = F.when(F.col("_in_base").isNull(), "added").when(F.col("_in_head").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def architecture_diff(base: DataFrame, head: DataFrame, keys: list[str], compared: list[str], order: str, cap: int = 500) -> DataFrame:
    """(keys, change, total, truncated): the first ``cap`` rows of each change, in order of the keys, and how many there are.

    Equal keys are paired in order; a pair is changed if any compared column differs. Counts are taken of all rows.
    """
    found = multiset_diff(base.withColumn("_all", F.struct(*compared)), head.withColumn("_all", F.struct(*compared)), keys, "_all", order)
    total = found.groupBy("change").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("change").orderBy(*keys))
    top = found.withColumn("_n", place).where(F.col("_n") <= cap).drop("_n")
    return top.join(F.broadcast(total), "change").select(*keys, "change", "total", (F.col("total") > cap).alias("truncated"))  # three rows


def tree_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, change) from two listings of (path, blob)."""
    both = base.select("path", F.col("blob").alias("before")).join(head.select("path", F.col("blob").alias("after")), "path", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("path", change.alias("change"))


def retained(snapshots: DataFrame, keep: int) -> DataFrame:
    """Adds ``keep``: complete snapshots that are current or among a repository's newest ones."""
    place = F.row_number().over(Window.partitionBy("repository_id").orderBy(F.col("complete").desc(), F.desc("created_at"), "id"))
    return snapshots.withColumn("keep", F.col("complete") & (F.col("current") | (place <= keep)))


def previous(snapshots: DataFrame) -> DataFrame:
    """Adds ``base_id``, the snapshot before."""
    return snapshots.withColumn("base_id", F.lag("id").over(Window.partitionBy("repository_id").orderBy("created_at", "id")))


def orphans(artifacts: DataFrame, *references: DataFrame) -> DataFrame:
    """Artifacts whose digest no reference table holds."""
    used = references[0].select("digest")
    for table in references[1:]:
        used = union(used, table.select("digest"))
    return artifacts.join(used, "digest", "left_anti")


def reuse(new: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that the cache answers, with its values, and rows that are left to compute."""
    return new.join(cache, keys), new.join(cache.select(*keys), keys, "left_anti")


def stale_views(views: DataFrame, scanned_id: str) -> DataFrame:
    stale = (F.col("snapshot_id") != scanned_id) & ~F.col("state").isin("unavailable", "failed")
    return views.withColumn("state", F.when(stale, "stale").otherwise(F.col("state")))

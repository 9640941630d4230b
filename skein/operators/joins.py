"""Range-containment and ranked resolution joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.workspace import union


def smallest_enclosing(points: DataFrame, ranges: DataFrame, key: str, bucket: int) -> DataFrame:
    """Each point's smallest range [start, end) of the same key.

    Ranges are cut into buckets of positions, so the join is an equality on (key,
    bucket) and no position is compared with all ranges of its key. Of ranges with the
    same ends a position meets the first only.
    """
    ranges = ranges.groupBy(key, "start", "end").agg(F.min(F.struct("range_id"))["range_id"].alias("range_id"))
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    hits = points.withColumn("_b", F.floor(F.col("at") / bucket)).join(cut, [key, "_b"]).where("start <= at AND at < end")
    best = F.min_by(F.struct("range_id", "start", "end"), F.struct(F.col("end") - F.col("start"), "range_id"))
    return hits.groupBy(key, "at").agg(best.alias("r")).select(key, "at", "r.range_id", "r.start", "r.end")


def resolve(calls: DataFrame, targets: DataFrame, priority: Callable[[Column], Column]) -> DataFrame:
    """(call_id, target_id, candidates, confidence): each call's best target of the same name, and how many there are; ambiguous ones have half the confidence.

    Calls are (call_id, name, path), targets (name, target_id, there, ...). ``priority`` says how a target ranks where it is in the
    file of the call and where it isn't, in which case it must not rank better; equal ranks go by ``target_id``. So the best target of
    a name and that of a name in a file are found once, and no call meets all targets of its name.
    """
    best = lambda here: F.min(F.struct(priority(F.lit(here)).alias("rank"), "target_id"))
    named = targets.groupBy("name").agg(best(False).alias("any"), F.count("*").alias("candidates"))
    filed = targets.groupBy("name", F.col("there").alias("path")).agg(best(True).alias("here"))
    rows = calls.select("call_id", "name", "path").join(named, "name").join(filed, ["name", "path"], "left")
    return rows.select("call_id", F.least("any", "here")["target_id"].alias("target_id"), "candidates", F.when(F.col("candidates") > 1, 0.45).otherwise(0.9).alias("confidence"))


def prefer_first(first: DataFrame, second: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of the first table, then those of the second whose key it lacks."""
    a = first.withColumn("preference", F.lit(0).cast("long"))
    b = second.join(first.select(key), key, "left_anti").withColumn("preference", F.lit(1).cast("long"))
    return union(a, b).orderBy("preference", key).limit(limit)

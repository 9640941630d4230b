"""Retrieval metrics and paired statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(results: DataFrame, gold: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(case_id, recall_at_k ...) from (case_id, item, rank) and (case_id, item)."""
    first = results.groupBy("case_id", "item").agg(F.min("rank").alias("rank"))
    hits = gold.select("case_id", "item").distinct().join(first, ["case_id", "item"], "left")
    return hits.groupBy("case_id").agg(*[F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 9).alias(f"recall_at_{k}") for k in cutoffs])


def mrr_ndcg(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, mrr, ndcg); a gold item gains once, at its best rank."""
    first = results.groupBy("case_id", "item").agg(F.min("rank").alias("rank"))
    hits = first.join(gold.select("case_id", "item").distinct(), ["case_id", "item"])
    gained = hits.groupBy("case_id").agg(F.max(1.0 / F.col("rank")).alias("mrr"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    size = gold.select("case_id", "item").distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = size.join(gained, "case_id", "left")
    return rows.select("case_id", F.round(F.coalesce("mrr", F.lit(0.0)), 9).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 9).alias("ndcg"))


def bpref(results: DataFrame, judged: DataFrame, depth: int = 20) -> DataFrame:
    """(case_id, bpref) from (case_id, item, rank) and (case_id, item, relevant)."""
    seen = results.where(F.col("rank") <= depth).join(judged, ["case_id", "item"])
    over = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("bad", F.coalesce(F.sum((~F.col("relevant")).cast("int")).over(over), F.lit(0)))
    size = judged.groupBy("case_id").agg(F.count_if("relevant").alias("r"), F.count_if(~F.col("relevant")).alias("n"))
    part = 1 - F.least("bad", "r") / F.greatest(F.least("r", "n"), F.lit(1))
    sums = seen.where("relevant").join(size, "case_id").groupBy("case_id").agg(F.sum(F.greatest(part, F.lit(0.0))).alias("s"))
    return size.where("r > 0").join(sums, "case_id", "left").select("case_id", F.round(F.coalesce(F.col("s") / F.col("r"), F.lit(0.0)), 9).alias("bpref"))


def redundancy(results: DataFrame, k: int) -> DataFrame:
    """Share of the first k results whose path was seen above."""
    place = F.row_number().over(Window.partitionBy("case_id", "path").orderBy("rank"))
    top = results.withColumn("seen", place > 1).where(F.col("rank") <= k)
    return top.groupBy("case_id").agg(F.round(F.avg(F.col("seen").cast("double")), 9).alias("redundancy"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, p, adjusted, rejected) by the step-down procedure; one row per metric, so one window is small."""
    order = Window.orderBy("p", "metric")
    raw = F.least(F.lit(1.0), F.col("p") * (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1))
    adjusted = F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = tests.withColumn("raw", raw).withColumn("adjusted", F.round(adjusted, 9)).drop("raw")
    return rows.withColumn("rejected", F.col("adjusted") <= alpha)


def _replicated(rows: DataFrame, key: str, replicates: int, seed: int, signs: bool) -> DataFrame:
    """(key, r, total, weight) from (key, id, v): sums of each replicate, made in the tasks, so one row per key and replicate is shuffled.

    A row's draws come from a hash of its id, so a lost task draws the same again: Poisson weights, or signs.
    ``draws`` stands inside, so that workers get it with the task and need no package.
    """
    kind = rows.schema[key].dataType.simpleString()

    def draws(ids: np.ndarray, low: int, high: int, edges: np.ndarray) -> np.ndarray:
        x = ids[:, None] + np.arange(low, high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        if signs:
            return (x & np.uint64(1)).astype(np.float64) * 2 - 1
        return np.searchsorted(edges, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(np.float64)

    def run(batches):
        steps = np.arange(1, 24)
        edges = np.cumsum(np.exp(-1) / np.concatenate([[1.0], np.cumprod(steps.astype(float))]))  # of the Poisson distribution, to the last digit
        sums: dict = {}
        for batch in batches:
            keys, ids = batch.column(key).to_pylist(), batch.column("id").to_numpy().view(np.uint64)
            values = batch.column("v").to_numpy(zero_copy_only=False)
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            of = np.array([names[k] for k in keys])
            for k, i in names.items():
                mine = of == i
                total, weight = sums.setdefault(k, (np.zeros(replicates), np.zeros(replicates)))
                chosen, v = ids[mine], values[mine]
                for low in range(0, replicates, 256):
                    high = min(replicates, low + 256)
                    for at in range(0, len(chosen), 4096):
                        w = draws(chosen[at : at + 4096], low, high, edges)
                        total[low:high] += v[at : at + 4096] @ w
                        weight[low:high] += len(w) if signs else w.sum(0)
        for k, (total, weight) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * replicates), pa.array(np.arange(replicates)), pa.array(total), pa.array(weight)], [key, "r", "total", "weight"])

    base = rows.select(key, F.xxhash64("id", F.lit(seed)).alias("id"), F.col("v").cast("double").alias("v")).where("v IS NOT NULL")
    parts = base.mapInArrow(run, f"`{key}` {kind}, r long, total double, weight double")
    return parts.groupBy(key, "r").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def bootstrap(values: DataFrame, key: str, value: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(key, low, high): percentile interval of the mean by Poisson resampling of rows (key, id, value).

    For clusters of rows take their means first, one row each.
    """
    means = _replicated(values.select(key, "id", F.col(value).alias("v")), key, replicates, seed, False)
    means = means.where("weight > 0").select(key, (F.col("total") / F.col("weight")).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def permutation(pairs: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(metric, delta, p) from (metric, id, delta): random sign flips, p = (extreme + 1) / (n + 1)."""
    means = _replicated(pairs.select("metric", "id", F.col("delta").alias("v")), "metric", replicates, seed, True)
    means = means.select("metric", (F.col("total") / F.col("weight")).alias("m"))
    real = pairs.groupBy("metric").agg(F.avg("delta").alias("delta"))
    extreme = F.count_if(F.abs("m") >= F.abs("delta") - 1e-12)
    return means.join(real, "metric").groupBy("metric").agg(F.first("delta").alias("delta"), ((extreme + 1) / (F.count("*") + 1)).alias("p"))


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.round(F.percentile(value, F.lit(q)), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])


def cumulative_histogram(rows: DataFrame, key: str, value: str, edges: list[float]) -> DataFrame:
    counts = [F.count_if(F.col(value) <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    return rows.groupBy(key).agg(*counts, F.count("*").alias("le_inf"), F.round(F.sum(value), 4).alias("total"))


def adjudication_queue(results: DataFrame, judged: DataFrame, depth: int = 20) -> DataFrame:
    """(case_id, item, systems): pooled results that nobody has judged."""
    pool = results.where(F.col("rank") <= depth).groupBy("case_id", "item").agg(F.countDistinct("system").alias("systems"))
    return pool.join(judged.select("case_id", "item"), ["case_id", "item"], "left_anti")


def paired_effect(pairs: DataFrame, key: str) -> DataFrame:
    """(key, n, delta, effect) from (key, base, candidate): mean difference, and that over its deviation.

    Without at least two pairs, or without any deviation, the effect is null.
    """
    d = F.col("candidate") - F.col("base")
    rows = pairs.groupBy(key).agg(F.count(d).alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("s"))
    return rows.select(key, "n", F.round("delta", 9).alias("delta"), F.round(F.when(F.col("s") > 1e-12, F.col("delta") / F.col("s")), 9).alias("effect"))


def guardrails(base: DataFrame, candidate: DataFrame, lower_is_better: list[str], tolerance: float) -> DataFrame:
    """(metric, base, candidate, passed): no metric may get worse by more than ``tolerance``; a missing one fails."""
    both = base.withColumnRenamed("value", "base").join(candidate.withColumnRenamed("value", "candidate"), "metric", "left")
    loss = F.when(F.col("metric").isin(*lower_is_better), F.col("candidate") - F.col("base")).otherwise(F.col("base") - F.col("candidate"))
    return both.select("metric", "base", "candidate", F.coalesce(loss <= tolerance, F.lit(False)).alias("passed"))


def marginal_utility(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(route, found, only): gold items a route finds, and those that no other route finds."""
    hits = results.select("case_id", "item", "route").distinct().join(gold.select("case_id", "item").distinct(), ["case_id", "item"])
    alone = hits.groupBy("case_id", "item").agg(F.count("*").alias("n"), F.collect_set("route").alias("routes"))
    return alone.select("n", F.explode("routes").alias("route")).groupBy("route").agg(F.count("*").alias("found"), F.count_if(F.col("n") == 1).alias("only"))
